"""Bodies of recorded responses: their size, their charset and their text."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte-order marks in hex, the longest first, and their charsets.
MARKS = (("EFBBBF", "utf-8"), ("FEFF", "utf-16-be"), ("FFFE", "utf-16-le"))
#: Bytes at the beginning of a page in which a meta element may name its charset.
PRESCAN = 1024


def body_error(body: Column, most: int, declared: Column | None = None) -> Column:
    """Why a body isn't taken: its declared or its real length in bytes is above ``most``; else null. A null body has no error."""
    early = F.when(F.coalesce(declared.try_cast("long") > most, F.lit(False)), "declared too large") if declared is not None else F.lit(None).cast("string")
    return F.coalesce(early, F.when(F.octet_length(body) > most, "too large"))


def charset_names(body: Column, content_type: Column) -> Column:
    """The charsets that a body goes by, the strongest first: its mark, the header, a meta element. Names may be unknown ones."""
    head = F.hex(F.substring(body, 1, 3))
    mark = F.lit(None).cast("string")
    for first, name in reversed(MARKS):
        mark = F.when(F.startswith(head, F.lit(first)), name).otherwise(mark)
    header = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?\s*([^\s;\"']+)", 1)
    page = F.decode(F.substring(body, 1, PRESCAN), "ISO-8859-1")
    meta = F.regexp_extract(F.regexp_replace(page, "(?s)<!--.*?-->", ""), r"(?i)<meta[^>]*?charset\s*=\s*[\"']?\s*([^\s;\"'/>]+)", 1)
    # A meta element that could be read as ASCII isn't in UTF-16.
    meta = F.when(F.lower(meta).rlike("^utf-?16"), "utf-8").otherwise(meta)
    return F.filter(F.array(mark, header, meta), lambda n: n.isNotNull() & (n != ""))


def _known(name: str) -> str | None:
    """The codec of a charset's name, None if there is none for text."""
    try:
        found = codecs.lookup(name.strip())
        return found.name if found._is_text_encoding else None
    except (LookupError, ValueError):
        return None


@F.arrow_udf(T.StringType())
def _first_known(names: pa.Array) -> pa.Array:
    codecs_: dict[str, str | None] = {}
    out = []
    for row in names.to_pylist():
        for name in row or []:
            if name not in codecs_:
                codecs_[name] = _known(name)
        out.append(next((codecs_[n] for n in row or [] if codecs_[n]), None))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _text(body: pa.Array, charset: pa.Array) -> pa.Array:
    out = []
    for data, name in zip(body, charset, strict=True):
        text = None if data.as_py() is None else data.as_py().decode(name.as_py(), "replace")
        # A lone surrogate has no place in a column of texts.
        out.append(text and text.removeprefix("﻿").encode("utf-8", "replace").decode("utf-8"))
    return pa.array(out, pa.string())


def decoded(responses: DataFrame, body: str = "body", content_type: str = "content_type", fallback: str = "utf-8") -> DataFrame:
    """responses with ``charset`` and ``html``, the text of their binary body; columns of these names are replaced.

    The charset is that of the byte-order mark, the header, a meta element in the first PRESCAN bytes, or the
    fallback: the first one that is known. Bytes that don't fit are replaced, marks are left out. A null body has a null text.
    """
    named = F.coalesce(_first_known(charset_names(F.col(body), F.col(content_type))), F.lit(fallback))
    kept = responses.drop("charset", "html").withColumn("charset", named)
    return kept.withColumn("html", _text(F.col(body), F.col("charset")))
