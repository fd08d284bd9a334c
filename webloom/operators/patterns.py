"""Texts against a table of regular expressions.

Most expressions hold a string that any match must contain. One automaton of these strings proposes
the patterns of a text; each proposed pattern is then matched on its own, in time linear in the text, so
groups keep their numbers and no expression can run away. An expression that needs to go back
(references, looking around) is refused unless it is matched by an engine that knows how.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of one table at most, and characters of all of them: they are shipped to every task.
MOST_PATTERNS, MOST_CHARS = 100_000, 16 << 20
_REPEATED_GROUP = re.compile(r"\)[+*{]")
_PYTHON_ONLY = re.compile(r"\(\?\(|\(\?P>|\\N\{|\(\?[aLu]+[):]")


def is_linear(pattern: str) -> bool:
    """Whether the linear matcher takes a pattern."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
        return True
    except pa.ArrowInvalid:
        return False


def checked(patterns: list[str] | None) -> list[str]:
    """The patterns that are regular expressions; there is a warning for each of the others."""
    kept = []
    for pattern in patterns or []:
        try:
            re.compile(pattern)
            kept.append(pattern)
        except re.error as e:
            warnings.warn(f"not a regular expression: {pattern!r} ({e})", stacklevel=3)
    return kept


def for_java(pattern: str) -> str:
    """A pattern that goes back, in Java's syntax; an error if it repeats a group, which could run away, or has no such form."""
    if _REPEATED_GROUP.search(pattern):
        raise ValueError(f"{pattern!r} looks around or back and repeats a group, so its time has no bound")
    if _PYTHON_ONLY.search(pattern):
        raise ValueError(f"{pattern!r} has no form that the engine knows")
    names: dict[str, str] = {}
    name = lambda m: names.setdefault(m[1], f"g{len(names)}x")
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{name(m)}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{name(m)}>", out)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)


def matches(text: Column, patterns: list[str]) -> Column:
    """Whether a text has a match of any pattern, each matched on its own."""
    linear = [p for p in patterns if is_linear(p)]
    out = F.lit(False)
    for pattern in patterns:
        if pattern not in linear:
            out = out | text.rlike(for_java(pattern))
    if not linear:
        return out

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        hits = pc.match_substring_regex(texts, linear[0])
        for pattern in linear[1:]:
            hits = pc.or_(hits, pc.match_substring_regex(texts, pattern))
        return hits

    return out | found(text)


def required(pattern: str) -> str:
    """The longest string that a scan of the pattern finds in all its matches; empty if it sees none.

    Groups, classes and alternatives say nothing, nor does what may be left out.
    """
    if re.search(r"\(\?[a-zA-Z]*[ix]", pattern):
        return ""
    runs, run, at, depth = [], "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        literal, size = "", 1
        if c == "\\":
            escaped = pattern[at + 1 : at + 2]
            literal, size = ("" if escaped.isalnum() else escaped), 2
            if escaped in ("x", "u", "U", "p", "P", "Q", "N") or escaped.isdigit():
                return ""  # longer escapes
        elif c == "[":
            end = at + 1 + (pattern[at + 1 : at + 2] == "^")
            end += pattern[end : end + 1] == "]"
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            size = end - at + 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return ""
        elif c not in ".^$*+?{}|":
            literal = c
        after = pattern[at + size : at + size + 1]
        if c in "*+?" or c == "{":
            size = (pattern.find("}", at) - at + 1) if c == "{" and "}" in pattern[at:] else 1
        if depth or not literal or after in ("*", "?", "{"):
            runs, run = [*runs, run], ""
        else:
            run += literal
            if after == "+":
                runs, run = [*runs, run], ""
        at += size
    return max([*runs, run], key=len)


def _automaton(known: list[tuple[int, str]]):
    """(automaton of the required strings with the places of their patterns, places of patterns without one)."""
    import ahocorasick

    by_string: dict[str, list[int]] = {}
    always = []
    for place, (_, pattern) in enumerate(known):
        if string := required(pattern):
            by_string.setdefault(string, []).append(place)
        else:
            always.append(place)
    automaton = ahocorasick.Automaton()
    for string, places in by_string.items():
        automaton.add_word(string, places)
    if by_string:
        automaton.make_automaton()
    return (automaton if by_string else None), always


def matching(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """A row of texts and patterns for each pair that matches: the columns of both, those of patterns last.

    What is no regular expression is left out with a warning, one that the linear matcher doesn't take is an error before the job. Patterns
    are few beside texts: more than MOST_PATTERNS or MOST_CHARS of them are an error. Nulls match nothing. Character classes are those of ASCII.
    """
    rows = patterns.select(F.col(pattern).alias("p")).filter("p IS NOT NULL").distinct().limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS or sum(len(r.p) for r in rows) > MOST_CHARS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns, or {MOST_CHARS} characters of them")
    known = list(enumerate(sorted(checked([r.p for r in rows]))))
    if refused := [p for _, p in known if not is_linear(p)]:
        raise ValueError(f"not matched in linear time: {refused[:5]!r}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, always = _automaton(known)
        for batch in batches:
            column = batch.column("text")
            proposed: dict[int, list[int]] = {place: list(range(batch.num_rows)) for place in always}
            for row, one in enumerate(column.to_pylist() if automaton else []):
                for place in {p for _, places in automaton.iter(one or "") for p in places}:
                    proposed.setdefault(place, []).append(row)
            for place, own in proposed.items():
                chosen = pa.array(own, pa.int64())
                hit = pc.fill_null(pc.match_substring_regex(column.take(chosen), known[place][1]), False)
                hits = batch.take(chosen.filter(hit))
                if hits.num_rows:
                    yield pa.RecordBatch.from_arrays([hits.column("row"), pa.array([known[place][1]] * hits.num_rows)], ["row", "pattern"])

    asked = texts.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    schema = asked.select("row").schema.add("pattern", "string")
    found = asked.mapInArrow(find, schema)
    told = patterns.select(F.col(pattern).alias("own_pattern"), F.struct("*").alias("own"))
    return found.join(told, F.col("pattern") == F.col("own_pattern")).select("row.*", "own.*")
