"""Blocks and cells of one page by plain recursion, for comparison with the DataFrame operators."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from webloom.functions import fixed
from webloom.sources.dom import parse

HIDDEN = frozenset({"mw-editsection", "mw-jump-link", "sr-only", "visually-hidden", "noprint"})
_ACTION = re.compile(r"(?:^|/)(?:vote|hide|flag|upvote)\?")
_LANGUAGE = re.compile(r"(?:^|\s)(?:language-|lang-|highlight-)([\w+#.-]+)")
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "s": "~~", "del": "~~", "strike": "~~", "sub": "sub", "sup": "sup"}
BOXES = {"ul": "BulletList", "ol": "OrderedList", "li": "ListItem", "blockquote": "BlockQuote", "dl": "DefinitionList", "dt": "DefinitionTerm", "dd": "Definition",
         "figure": "Figure", "figcaption": "Caption", "caption": "Caption", "table": "Table"}
ITEMS = ("ListItem", "DefinitionTerm", "Definition", "Caption")
PLAIN = "p address article aside body div fieldset footer form header html main nav section tbody thead tfoot tr td th".split()


def _tree(source: str) -> list:
    """Elements as [tag, attrs, skipped, children, nid]; texts as strings."""
    events: list = []
    parse(source, events)
    top: list = ["", {}, False, [], -1]
    stack = [top]
    for what, value in events:
        if what == "text":
            stack[-1][3].append(value)
        elif what == "open":
            one = [value["tag"], dict(value["attrs"]), value["skipped"], [], value["nid"]]
            stack[-1][3].append(one)
            stack.append(one)
        else:
            stack.pop()
    return top


def _target(url: str, href: str) -> str:
    return "" if not href.strip() or re.match(rf"\s*({'|'.join(fixed.UNSAFE_SCHEMES)}):", href, re.IGNORECASE) else urljoin(url, href.strip())


def _shown(run: list[tuple]) -> str:
    """The markdown of (text, markdown, path) pieces."""
    out, open_, space = "", [], False
    for text, md, path in run:
        shown = md if md is not None else text
        core = shown.strip()
        space |= shown != shown.lstrip() or not core
        if not core:
            continue
        while open_ and open_[-1] not in path:
            _, mark, href = open_.pop()
            out += f"]({href})" if mark == "[" else f"</{mark}>" if mark in ("sub", "sup") else mark
        out += " " if space and out else ""
        for entry in path[len(open_) :]:
            out += f"<{entry[1]}>" if entry[1] in ("sub", "sup") else entry[1]
            open_.append(entry)
        out += " ".join(core.split())
        space = shown != shown.rstrip()
    for _, mark, href in reversed(open_):
        out += f"]({href})" if mark == "[" else f"</{mark}>" if mark in ("sub", "sup") else mark
    return out


class _Page:
    def __init__(self, url: str, skip: frozenset[str]) -> None:
        self.url, self.skip = url, skip
        self.run: list[tuple] = []
        self.out: list[dict] = []

    def flush(self, box: dict, kind: str, level=None, language=None) -> None:
        run, self.run = self.run, []
        raw, md = "".join(r[0] for r in run), _shown(run)
        text = raw.strip("\n") if kind == "CodeBlock" else " ".join(raw.split())
        if not text.strip() and not md:
            return
        md = {"Heading": "#" * (level or 0) + " " + md, "CodeBlock": f"```{language or ''}\n{text}\n```"}.get(kind, md)
        if kind == "Paragraph" and box["node_type"] in ITEMS and not box["children"]:
            box |= {"text": text, "own": md}
            box["children"].append(None)
        else:
            box["children"].append({"node_type": kind, "depth": level, "text": text, "own": md, "language": language, "children": []})

    def gone(self, el: list) -> bool:
        tag, attrs, skipped = el[:3]
        return skipped or tag in ("head", *self.skip) or (tag == "a" and bool(_ACTION.search(attrs.get("href", "")))) or bool(HIDDEN & set(attrs.get("class", "").split()))

    def walk(self, el: list, box: dict, kind: str, path: tuple, state: dict) -> None:
        """The children of el into box; state: level and language of the kind, lists around."""
        def flush() -> None:
            self.flush(box, kind, state.get("level"), state.get("language"))

        for child in el[3]:
            if isinstance(child, str):
                self.run.append((child, None, path))
                continue
            if self.gone(child):
                continue
            tag, attrs = child[0], child[1]
            code = kind == "CodeBlock"
            if tag == "br":
                self.run.append(("\n" if code else " ", None, path))
            elif tag == "img":
                source = _target(self.url, attrs.get("data-src") or attrs.get("src") or "")
                if source and not code:
                    self.run.append(("", f"![{' '.join(attrs.get('alt', '').split())}]({source})", path))
            elif tag == "hr":
                flush()
                box["children"].append({"node_type": "ThematicBreak", "text": "", "own": "---", "children": []})
            elif re.fullmatch("h[1-6]", tag):
                flush()
                self.walk(child, box, "Heading", path, state | {"level": int(tag[1])})
                self.flush(box, "Heading", int(tag[1]))
            elif tag == "pre":
                flush()
                found = _LANGUAGE.search(attrs.get("class", ""))
                inner = state | {"level": None, "language": attrs.get("data-lang") or (found[1] if found else None)}
                self.walk(child, box, "CodeBlock", (), inner)
                self.flush(box, "CodeBlock", None, inner["language"])
            elif tag == "p":
                flush()
                self.walk(child, box, "Paragraph", path, state | {"level": None, "language": None})
                self.flush(box, "Paragraph")
            elif tag in BOXES:
                flush()
                self.box(child, box, path, state)
            elif tag in PLAIN:
                flush()
                self.walk(child, box, kind, path, state)
                flush()
            elif code and tag == "code":
                found = _LANGUAGE.search(attrs.get("class", ""))
                state["language"] = state.get("language") or (found[1] if found else None)
                self.walk(child, box, kind, path, state)
            else:
                self.walk(child, box, kind, self.inner(child, path, code), state)

    def inner(self, el: list, path: tuple, code: bool) -> tuple:
        tag, attrs = el[0], el[1]
        mark, href = ("[", _target(self.url, attrs.get("href", ""))) if tag == "a" else (MARKS.get(tag), None)
        if code or not mark or href == "" or any(e[1] in (mark, "`") for e in path):
            return path
        return (*path, (el[4], mark, href))

    def box(self, el: list, box: dict, path: tuple, state: dict) -> None:
        tag, attrs = el[0], el[1]
        own: dict = {"node_type": BOXES[tag], "text": "", "own": "", "children": []}
        inner = state | {"level": None, "language": None}
        if tag in ("ul", "ol"):
            first = int(attrs["start"]) if tag == "ol" and attrs.get("start", "").isdigit() else 1
            own |= {"list_type": "ordered" if tag == "ol" else "bullet", "number": first}
            inner |= {"lists": state.get("lists", 0) + 1, "list": [own["list_type"], first - 1]}
        elif tag == "li":
            counter = state.get("list") or ["bullet", 0]
            counter[1] += 1
            own |= {"list_type": counter[0], "number": counter[1], "depth": max(state.get("lists", 0), 1)}
        elif tag == "dl":
            inner["groups"] = ["", 0]
        elif tag in ("dt", "dd"):
            groups = state.get("groups") or ["", 0]
            groups[1] += 1 if (tag == "dt" and groups[0] != "dt") or not groups[1] else 0
            groups[0] = tag
            own["number"] = groups[1]
        if tag == "table":
            self.table(el, own, path, inner)
        else:
            self.walk(el, own, "Paragraph", path, inner)
            self.flush(own, "Paragraph")
        if own["children"] or own["own"]:
            own["children"] = [c for c in own["children"] if c]
            box["children"].append(own)

    def table(self, el: list, own: dict, path: tuple, state: dict) -> None:
        """Cells by rows; what else stands in the table goes below it."""
        rows: list[list[tuple]] = [[]]
        later: list[tuple] = []

        def rows_of(one: list, head: bool) -> None:
            for child in one[3]:
                if isinstance(child, str):
                    self.run.append((child, None, path))
                elif self.gone(child):
                    continue
                elif child[0] in ("td", "th"):
                    self.flush(own, "Paragraph")
                    pieces: list[tuple] = []
                    self.cell(child, pieces, path, own, state)
                    span = child[1].get("colspan", "1")
                    raw = " ".join("".join(p[0] for p in pieces).split())
                    rows[-1].append((head or child[0] == "th", int(span) if span.isdigit() and int(span) else 1, raw, _shown(pieces).replace("|", "\\|")))
                elif child[0] in ("tbody", "thead", "tfoot", "tr"):
                    self.flush(own, "Paragraph")
                    if child[0] == "tr" and rows[-1]:
                        rows.append([])
                    rows_of(child, head or child[0] == "thead")
                else:
                    self.walk(["", {}, False, [child], -1], own, "Paragraph", path, state)
                    self.flush(own, "Paragraph")

        rows_of(el, False)
        self.flush(own, "Paragraph")
        own["children"] += later
        rows = [r for r in rows if r]
        if any(c[3] for r in rows for c in r):
            width = max(sum(c[1] for c in r) for r in rows)
            lines = []
            for r in rows:
                filled = [x for c in r for x in [c[3], *[""] * (c[1] - 1)]]
                lines.append("| " + " | ".join(filled + [""] * (width - len(filled))) + " |")
            rule, empty = "|" + " --- |" * width, "|" + "  |" * width
            lines = [lines[0], rule, *lines[1:]] if all(c[0] for c in rows[0]) else [empty, rule, *lines]
            own |= {"text": "\n".join(" | ".join(c[2] for c in r) for r in rows), "own": "\n".join(lines)}

    def cell(self, el: list, pieces: list[tuple], path: tuple, own: dict, state: dict) -> None:
        """All text of a cell as one run; blocks in it are parted by a space, tables in it are blocks of their own."""
        for child in el[3]:
            if isinstance(child, str):
                pieces.append((child, None, path))
            elif not self.gone(child):
                tag, attrs = child[0], child[1]
                parts = tag in BOXES or tag in PLAIN or tag in ("hr", "pre") or bool(re.fullmatch("h[1-6]", tag))
                pieces += [(" ", None, path)] if parts else []
                if tag == "br":
                    pieces.append((" ", None, path))
                elif tag == "img" and (source := _target(self.url, attrs.get("data-src") or attrs.get("src") or "")):
                    pieces.append(("", f"![{' '.join(attrs.get('alt', '').split())}]({source})", path))
                elif tag == "table":
                    self.box(child, own, (), state)
                else:
                    self.cell(child, pieces, self.inner(child, path, False), own, state)
                pieces += [(" ", None, path)] if parts else []


def page_blocks(source: str, skip: frozenset[str] = frozenset(), url: str = "u") -> list[dict]:
    """The blocks of a page in order. Elements named in ``skip`` are left out with all they hold."""
    page, top = _Page(url, skip), {"node_type": "", "children": []}
    page.walk(_tree(source), top, "Paragraph", (), {})
    page.flush(top, "Paragraph")
    out: list[dict] = []

    def told(block: dict, parent: int | None, boxes: list[dict]) -> None:
        if block["own"]:
            around = [*boxes, block] if block["node_type"] == "ListItem" else boxes
            items = [b for b in around if b["node_type"] == "ListItem"]
            first = rest = ""
            for b in around:
                if b["node_type"] == "BlockQuote":
                    first, rest = first + "> ", rest + "> "
                elif b["node_type"] == "ListItem":
                    marks = b is items[-1] and not b.get("marked")
                    first, rest = first + ((f"{b['number']}. " if b["list_type"] == "ordered" else "- ") if marks else "  "), rest + "  "
            for b in around:
                b["marked"] = True
            md = first + block["own"].replace("\n", "\n" + rest)
        else:
            md = ""
        fields = {k: block.get(k) for k in ("node_type", "depth", "list_type", "number", "text", "language")}
        if block["node_type"] in ("Table", "Caption"):
            fields["number"] = None
        number = len(out)
        out.append(fields | {"md": md, "block_idx": number, "parent_idx": parent})
        for child in block["children"]:
            if child:
                told(child, number, [*boxes, block])

    for block in top["children"]:
        told(block, None, [])
    return out


def page_cells(source: str) -> list[dict]:
    """The cells of a page's tables; a row is a head row if it stands in thead or holds th only."""
    events: list = []
    parse(source, events)
    out: list[dict] = []
    tables: list[dict] = []
    n_tables = 0
    cell: list | None = None
    for what, value in events:
        if what == "text":
            if cell is not None:
                cell[1].append(value)
            continue
        tag = value["tag"]
        if what == "open":
            if tag == "table":
                tables.append({"table_idx": n_tables, "row": -1, "head": False})
                n_tables += 1
            elif tables and tag == "thead":
                tables[-1]["head"] = True
            elif tables and tag == "tr":
                tables[-1] |= {"row": tables[-1]["row"] + 1, "col": 0}
            elif tables and tag in ("td", "th"):
                span = dict(value["attrs"]).get("colspan", "1")
                cell = [{"table_idx": tables[-1]["table_idx"], "row": max(tables[-1]["row"], 0), "col": tables[-1].get("col", 0), "is_head": tables[-1]["head"] or tag == "th", "col_span": int(span) if span.isdigit() and int(span) else 1}, []]
        elif tables and tag in ("td", "th") and cell is not None:
            out.append(cell[0] | {"text": " ".join("".join(cell[1]).split())})
            tables[-1]["col"] = cell[0]["col"] + cell[0]["col_span"]
            cell = None
        elif tables and tag == "thead":
            tables[-1]["head"] = False
        elif tables and tag == "table":
            tables.pop()
    return out
