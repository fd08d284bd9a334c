r"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of
one role are merged into one block, from the places where the role changes, and the
blocks are concatenated:

    <|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n

``<|im_sep|>`` stands between the texts of a merged block, so the original turns can
be read back. Inside roles and texts every ``<``, any number of ``\`` and ``|`` get
one more ``\`` after the ``<``, which leaves no control string and can be undone.
Roles also have ``\`` and line ends escaped, since a line end closes the role.

The loss mask is a run-length code over the formatted string: ``mask`` holds
``struct<chars, loss>`` runs whose lengths add up to the length of ``formatted``. Runs of
control strings and of texts alternate, a run of control strings first and last.

No step rebuilds an array or walks a string from its start for each turn, so the time a
conversation takes is in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
RUNS = "array<struct<chars:int,loss:boolean>>"
#: What stands between two texts, before the first and after the last.
CONTROL = r"(?:<\|im_end\|>\n)?<\|im_start\|>[^\n]*\n|<\|im_sep\|>|<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """text without control strings; undone by unescape."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    r"""A role on one line: ``\`` becomes ``\s`` and a line end ``\n``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """The inverse of escape_role."""
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _merged(turns: str) -> Column:
    """Sorted turns, a column's name, as blocks: runs of turns of one role with their texts."""
    held = F.col(turns)
    places = F.sequence(F.lit(0), F.size(held) - 1)
    starts = F.filter(places, lambda i: ~F.get(held, i)["role"].eqNullSafe(F.get(held, i - 1)["role"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(held)))
    return F.zip_with(
        starts,
        ends,
        lambda start, end: F.struct(
            F.get(held, start)["role"].alias("role"),
            F.transform(F.slice(held, start + 1, end - start), lambda turn: turn["text"]).alias("texts"),
        ),
    )


def _runs(block: Column, number: Column, loss_role: str) -> Column:
    """The runs of one block's string: for each text the control strings before it, and itself."""

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))

    end = F.when(number > 0, len(END) + 1).otherwise(0)
    header = end + F.char_length(block["role"]) + len(START) + 1
    texts = F.transform(
        block["texts"],
        lambda text, i: F.array(
            run(F.when(i == 0, header).otherwise(len(SEP)), F.lit(False)),
            run(F.char_length(text), block["role"] == escape_role(F.lit(loss_role))),
        ),
    )
    return F.flatten(texts).cast(RUNS)


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask for the rows (conv_id, turn, role, text).

    Turns are sorted by (turn, role, text), a null turn first, so ties and repeated rows
    have one result; repeated rows are turns of their own. A null role or text is
    empty. Rows whose conv_id is null make one conversation. An empty table gives no
    rows, and other columns of the input are ignored. A conversation is one value of
    the result, so its turns meet in one row; nothing larger is ever gathered.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    escaped = F.transform(
        F.array_sort(F.collect_list("turn")),
        lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")),
    )
    blocks = (
        turns.select("conv_id", turn.alias("turn"))
        .groupBy("conv_id")
        .agg(escaped.alias("turns"))
        .select("conv_id", _merged("turns").alias("blocks"))
    )
    body = F.transform(
        "blocks",
        lambda block: F.concat(
            F.lit(START), block["role"], F.lit("\n"), F.array_join(block["texts"], SEP), F.lit(END + "\n")
        ),
    )
    last = F.array(F.struct(F.lit(len(END) + 1).alias("chars"), F.lit(False).alias("loss"))).cast(RUNS)
    return blocks.select(
        "conv_id",
        F.array_join(body, "").alias("formatted"),
        F.concat(F.flatten(F.transform("blocks", lambda block, i: _runs(block, i, loss_role))), last).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda block, i: i > 0)

    def turns(block: Column) -> Column:
        end = F.instr(block, "\n")
        role, rest = F.left(block, end - 1), F.substring(block, end + 1, F.char_length(block))
        texts = F.split(F.left(rest, F.char_length(rest) - len(END) - 1), r"<\|im_sep\|>", -1)
        return F.transform(
            texts, lambda text: F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss_text(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, run by run, unescaped and joined; a mask of another string is an error."""
    parts = F.split(formatted, CONTROL, -1)
    texts = F.slice(parts, F.lit(2), F.size(parts) - 2)
    wrong = F.raise_error(F.lit("the mask is not that of the string")).cast("string")
    read = F.zip_with(
        texts,
        F.filter(mask, lambda run, i: i % 2 == 1),
        lambda text, run: F.when(~F.char_length(text).eqNullSafe(run["chars"]), wrong)
        .when(run["loss"], unescape(text))
        .otherwise(""),
    )
    return F.array_join(read, "")
