"""Parsers of recorded answers in binary protocols, as Arrow functions over binary columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _name_end(data: bytes, at: int) -> int:
    """The place behind a domain name that may end in a pointer."""
    while at < len(data):
        size = data[at]
        if size >= 0xC0:
            return at + 2
        at += 1 + size
        if not size:
            return at
    raise IndexError("name runs past the message")


def dns_txt(data: bytes | None) -> str | None:
    """The texts of the TXT answers of a DNS message, joined by spaces; null if it is broken or has none."""
    try:
        n_questions, n_answers = (int.from_bytes(data[i : i + 2], "big") for i in (4, 6))
        at = 12
        for _ in range(n_questions):
            at = _name_end(data, at) + 4
        found = []
        for _ in range(n_answers):
            at = _name_end(data, at)
            kind, size = int.from_bytes(data[at : at + 2], "big"), int.from_bytes(data[at + 8 : at + 10], "big")
            at += 10
            end = at + size
            while kind == 16 and at < end:
                found.append(data[at + 1 : at + 1 + data[at]].decode("utf-8", "replace"))
                at += 1 + data[at]
            at = end
        return " ".join(found) or None
    except (IndexError, TypeError):
        return None


def _ber(data: bytes, at: int) -> tuple[int, int, int]:
    """Tag, first and end of the value at a place."""
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return tag, at, at + size


def snmp_text(data: bytes | None) -> str | None:
    """The first octet string after the community in an SNMP answer; null if there is none."""
    try:
        _, at, _ = _ber(data, 0)
        for _ in range(2):  # version and community
            _, _, at = _ber(data, at)
        todo = [(at, len(data))]
        while todo:
            at, end = todo.pop()
            while at < end:
                tag, first, last = _ber(data, at)
                if tag == 0x04:
                    return data[first:last].decode("utf-8", "replace")
                if tag & 0x20:
                    todo.append((last, end))
                    todo.append((first, min(last, end)))
                    break
                at = last
        return None
    except (IndexError, TypeError):
        return None


def banner_service(data: bytes | None) -> str | None:
    """``service version`` of a binary greeting: MySQL's handshake of protocol 10 or PostgreSQL's error; else null."""
    if not data:
        return None
    if len(data) > 5 and data[4] == 10 and b"\0" in data[5:]:
        return "mysql " + data[5 : data.index(b"\0", 5)].decode("latin-1")
    return "postgresql " if data[:3] == b"E\0\0" else None


def decoded_banner(data: bytes | None) -> str | None:
    """A banner as UTF-8, else as Latin-1."""
    if data is None:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def apply(function, column: Column) -> Column:
    """One of these parsers over a binary column, batch by batch."""

    @F.pandas_udf("string")
    def over(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(bytes(v) if v is not None else None))

    return over(column)
