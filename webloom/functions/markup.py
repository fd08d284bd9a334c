"""A tolerant scanner of HTML and XML text, for use inside Arrow functions.

It yields tags and character data in document order and never fails: a ``<`` that
opens no tag is text, a tag cut off at the end of the input is dropped, and the
content of raw-text elements runs to their own end tag.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements whose content is text to the parser, by the published HTML specification.
RAW_TEXT = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(
    r"<!--(?:>|->|(?s:.*?)(?:--!?>|\Z))"
    r"|<!\[CDATA\[(?P<cdata>(?s:.*?))(?:\]\]>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
)
_OPEN_END = re.compile(r"<[A-Za-z/!?][^<]*\Z")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW_TEXT}


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of each, character references decoded."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def scan(source: str, raw_text: bool = True) -> Iterator[tuple[str, str, str]]:
    """Events ("open" | "close" | "empty", name, attributes) and ("text", raw text, "") in order.

    Names keep their case. ``raw_text`` False treats script, title and so on as other
    elements, which is right for XML. CDATA sections come as ("cdata", text, "").
    """
    at, size = 0, len(source)
    while at < size:
        tag = _TAG.search(source, at)
        if not tag:
            rest = source[at:]
            if end := _OPEN_END.search(rest):
                rest = rest[: end.start()]
            if rest:
                yield "text", rest, ""
            return
        if tag.start() > at:
            yield "text", source[at : tag.start()], ""
        at = tag.end()
        if name := tag["name"]:
            if tag["close"]:
                yield "close", name, ""
                continue
            attrs = tag["attrs"]
            if attrs.endswith("/"):
                yield "empty", name, attrs[:-1]
            else:
                yield "open", name, attrs
            if raw_text and (low := name.lower()) in RAW_TEXT:
                end = _RAW_END[low].search(source, at)
                inner = source[at : end.start() if end else size]
                if inner:
                    yield "text", inner, ""
                at = end.start() if end else size
        elif tag["cdata"] is not None:
            yield "cdata", tag["cdata"], ""


def decoded(text: str) -> str:
    """Character data with its references decoded."""
    return html.unescape(text) if "&" in text else text
