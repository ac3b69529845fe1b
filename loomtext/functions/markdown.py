"""Markdown as block and inline node tables.

A document is cut into lines; frontmatter and reference definitions are taken out first;
blocks are then read top down at a minimum indent, nested quotes and list items by the
same reader; leaf blocks hand their text to the inline scanner.  An unclosed fence fails
the document.  Standalone headings, links, images and code blocks, and frontmatter, are
regular and need no Python.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.nodes import as_column, node_function
from loomtext.result import FAILURE, error_row

_BLANK = " \t"
#: Characters that a backslash makes literal.
_ESCAPABLE = r"\\*_`\[\]()!~|"
_HASHES = re.compile(r"(#{1,6}) (.*)", re.S)
_FENCE = re.compile(r"(`{3,}|~{3,})(.*)", re.S)
_MARKER = re.compile(r"(?:[-*+]|([0-9]+)[.)]) (.*)", re.S)
_TASK = re.compile(r"\[([ xX])\] ")
_HTML = re.compile(r"[ \t]*<[A-Za-z/!]")
_RULE = re.compile(r" *([-*_])(?: *\1){2,} *")
_UNDERLINE = re.compile(r"==+|--+")
_ALIGNMENT = re.compile(r"(?=(?:[^-]*-){3})[-: ]+")
_PIPE = re.compile(r"\\.|[`|]", re.S)
_INLINE = re.compile(rf"  \n|\\\n|\\[{_ESCAPABLE}]|!?\[|<|~~|\*\*?|_|`|https?://|www\.")
_URL = re.compile(r"[^ \n\t)\]]*")
_LABEL_SPACE = re.compile(r"[ \t\n]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_PAIRED = {"~~": "strikethrough", "**": "strong", "*": "emphasis", "_": "emphasis"}

BLOCK = (
    "struct<node_id: int, parent_id: int, depth: int, ord: int, kind: string, level: int, info: string, raw: string, list_kind: string, list_start: decimal(20,0),"
    " loose: boolean, task: string, align: array<string>, row_no: int, cell_no: int>"
)
INLINE = "struct<block_node_id: int, node_id: int, parent_id: int, depth: int, ord: int, kind: string, text: string, href: string, title: string>"
_ERROR = "struct<kind: string, message: string, line: bigint, col: bigint, record: bigint>"
RESULT = f"struct<blocks: array<{BLOCK}>, inlines: array<{INLINE}>, error: {_ERROR}>"


class MarkdownError(Exception):
    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line, self.message = line, message


class Inline(NamedTuple):
    kind: str
    text: str | None = None
    children: tuple = ()
    href: str | None = None
    title: str | None = None


class Block(NamedTuple):
    kind: str
    children: tuple = ()
    inlines: tuple | None = None
    level: int | None = None
    info: str | None = None
    raw: str | None = None
    list_start: int | None = None
    loose: bool | None = None
    task: str | None = None
    align: tuple | None = None
    row_no: int | None = None
    cell_no: int | None = None
    list_kind: str | None = None


# inlines
@lru_cache(maxsize=16)
def _closer(needle: str) -> re.Pattern:
    return re.compile(rf"\\[{_ESCAPABLE}]|({re.escape(needle)})")


def _until(s: str, at: int, needle: str) -> int:
    """Place of the nearest unescaped needle, or -1."""
    for m in _closer(needle).finditer(s, at):
        if m.group(1):
            return m.start()
    return -1


def _target(raw: str) -> tuple[str, str | None]:
    """(href, title) of what stands in a link's parentheses."""
    parts = re.split(r"[ \t]", raw.strip(_BLANK), maxsplit=1)
    if len(parts) == 1 or not parts[1]:
        return parts[0], None
    title = parts[1].strip(_BLANK)
    if title[:1] in ('"', "'"):
        end = title.find(title[0], 1)
        title = title[1:end] if end > 0 else title[1:]
    return parts[0], title


def _label(raw: str) -> str:
    return _LABEL_SPACE.sub(" ", raw.strip(_BLANK).translate(_LOWER)).strip(" \n") if raw else ""


class _Closers:
    """Nearest closing marks of one text; a mark that was found, or is known to be missing, is not looked for again."""

    def __init__(self, s: str):
        self.s, self.known = s, {}

    def __call__(self, at: int, needle: str) -> int:
        since, place = self.known.get(needle, (at + 1, -1))
        if at < since or -1 < place < at:
            place = _until(self.s, at, needle)
            self.known[needle] = (at, place)
        return place


def _linked(s: str, at: int, label: str, refs: dict, until: _Closers) -> tuple[tuple[str, str | None], int] | None:
    """Target and end of what follows a label's bracket: (target), [], [label] or nothing."""
    if s.startswith("(", at):
        end = until(at + 1, ")")
        return (_target(s[at + 1 : end]), end + 1) if end >= 0 else None
    if s.startswith("[]", at):
        key, end = label, at + 2
    elif s.startswith("[", at):
        close = until(at + 1, "]")
        if close < 0:
            return None
        key, end = s[at + 1 : close], close + 1
    else:
        key, end = label, at
    found = refs.get(_label(key)) if refs else None
    return (found, end) if found else None


def inlines(s: str, refs: dict | None = None) -> tuple[Inline, ...]:
    """Inline nodes of a text; what opens without closing is text."""
    refs, out, text, at, until = refs or {}, [], [], 0, _Closers(s)

    def add(node: Inline):
        if kept := "".join(text):
            out.append(Inline("text", kept))
        text.clear()
        out.append(node)

    while m := _INLINE.search(s, at):
        text.append(s[at : m.start()])
        mark, start, at = m.group(), m.start(), m.end()
        if mark in ("  \n", "\\\n"):
            add(Inline("hard_break"))
        elif mark[0] == "\\":
            text.append(mark[1])
        elif mark in ("[", "!["):
            close = until(at, "]")
            # only a reference needs the label
            found = _linked(s, close + 1, s[at:close] if refs else "", refs, until) if close >= 0 else None
            if found is None:
                # after a failed image the bracket may still open a link
                text.append(mark[0])
                at = start + 1
            else:
                (href, title), end = found
                add(Inline("image" if mark[0] == "!" else "link", children=inlines(s[at:close], refs), href=href, title=title))
                at = end
        elif mark == "<":
            close = s.find(">", at)
            if close < 0:
                text.append(mark)
                continue
            inside = s[at:close]
            if inside.startswith(("http://", "https://")):
                add(Inline("link", children=(Inline("text", inside),), href=inside))
            elif "@" in inside and "." in inside:
                add(Inline("link", children=(Inline("text", inside),), href=f"mailto:{inside}"))
            else:
                add(Inline("html_inline", f"<{inside}>"))
            at = close + 1
        elif mark in _PAIRED or mark == "`":
            close = until(at, mark)
            if close < 0:
                text.append(mark)
            elif mark == "`":
                add(Inline("code", s[at:close]))
                at = close + 1
            else:
                add(Inline(_PAIRED[mark], children=inlines(s[at:close], refs)))
                at = close + len(mark)
        else:
            at = _URL.match(s, start).end()
            url = s[start:at]
            add(Inline("link", children=(Inline("text", url),), href=url))
    text.append(s[at:])
    if kept := "".join(text):
        out.append(Inline("text", kept))
    return tuple(out)


# lines
def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _is_blank(line: str) -> bool:
    return not line.strip(_BLANK)


def _without_closing(raw: str) -> str:
    text = raw.strip(_BLANK)
    bare = text.rstrip("#")
    return text if bare == text else bare.strip(_BLANK)


def _join(lines: list[str]) -> str:
    """Paragraph lines as one text: a blank between lines, or a line feed after a hard-break mark."""
    out, last = [], ""
    for line in lines:
        if out:
            out.append("\n" if last.endswith(("\\", "  ")) else " ")
            last = out[-1] + line if len(line) < 2 else line
            out.append(line)
        elif line:
            out.append(line)
            last = line
    return "".join(out)


def _cells(line: str) -> list[str] | None:
    """Cells of a table line, or None without a pipe outside code and escapes."""

    def cuts(s: str) -> list[int]:
        found, code = [], False
        for m in _PIPE.finditer(s):
            if m.group() == "`":
                code = not code
            elif m.group() == "|" and not code:
                found.append(m.start())
        return found

    if not cuts(line):
        return None
    inner = line.strip(_BLANK)
    inner = inner.removeprefix("|").strip(_BLANK)
    inner = inner.removesuffix("|").rstrip(" ") if inner.endswith("|") else inner
    places = [-1, *cuts(inner), len(inner)]
    return [inner[a + 1 : b] for a, b in zip(places, places[1:])]


def _alignments(cells: list[str]) -> tuple[str, ...] | None:
    out = []
    for cell in (c.strip(_BLANK) for c in cells):
        if not _ALIGNMENT.fullmatch(cell):
            return None
        left, right = cell.startswith(":"), cell.endswith(":")
        out.append("center" if left and right else "left" if left else "right" if right else "default")
    return tuple(out)


class _Reader:
    """Blocks from lines ``self.lines`` on, starting at ``self.at``."""

    def __init__(self, lines: list[str], refs: dict, first_line: int = 1):
        self.lines, self.refs, self.at, self.first_line = lines, refs, 0, first_line

    def content(self, at: int, least: int) -> str | None:
        """A line past the minimum indent, or None if it stands further left."""
        line = self.lines[at]
        return line[least:] if _indent(line) >= least else None

    def starts_block(self, at: int, least: int) -> bool:
        c = self.content(at, least)
        if c is None:
            return False
        return bool(_HASHES.match(c) or _FENCE.match(c) or _HTML.match(c) or c.startswith(">") or (not c.startswith(" ") and (_RULE.fullmatch(c) or _MARKER.match(c))))

    def blocks(self, least: int) -> tuple[Block, ...]:
        out = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if _is_blank(line):
                self.at += 1
            elif _indent(line) < least:
                break
            else:
                out.append(self.block(least))
        return tuple(out)

    def take(self, least: int, stop_at_blocks: bool) -> list[str]:
        """Lines up to a blank one, one further left, or (if asked) one that starts a block."""
        out = []
        while self.at < len(self.lines) and not _is_blank(self.lines[self.at]):
            c = self.content(self.at, least)
            if c is None or (stop_at_blocks and self.starts_block(self.at, least)):
                break
            out.append(c)
            self.at += 1
        return out

    def block(self, least: int) -> Block:
        at, c = self.at, self.content(self.at, least)
        if at + 1 < len(self.lines) and not self.starts_block(at, least):
            under = self.content(at + 1, least)
            if under is not None and not under.startswith(" ") and _UNDERLINE.fullmatch(under.strip(_BLANK)):
                self.at += 2
                return Block("heading", inlines=inlines(c, self.refs), level=1 if under.startswith("=") else 2)
        if c.startswith("    "):
            return self.indented(least)
        if m := _HASHES.match(c):
            self.at += 1
            return Block("heading", inlines=inlines(_without_closing(m.group(2)), self.refs), level=len(m.group(1)))
        if m := _FENCE.match(c):
            return self.fenced(least, m.group(1), m.group(2).strip(_BLANK))
        if _RULE.fullmatch(c) and not c.startswith(" "):
            self.at += 1
            return Block("thematic_break")
        if table := self.table(least):
            return table
        if _HTML.match(c):
            return Block("html", raw="".join(x + "\n" for x in self.take(least, False)))
        if c.startswith(">"):
            return self.quote(least)
        if _MARKER.match(c):
            return self.list(least)
        return Block("paragraph", inlines=inlines(_join(self.take(least, True)), self.refs))

    def indented(self, least: int) -> Block:
        out = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if _is_blank(line):
                out.append("")
            elif _indent(line) >= least + 4:
                out.append(line[least + 4 :])
            else:
                break
            self.at += 1
        return Block("code", info="", raw="".join(x + "\n" for x in out))

    def fenced(self, least: int, fence: str, info: str) -> Block:
        opened, out = self.at, []
        for i in range(opened + 1, len(self.lines)):
            c = self.content(i, least)
            bare = c.strip(_BLANK) if c is not None else ""
            if len(bare) >= len(fence) and not bare.strip(fence[0]):
                self.at = i + 1
                return Block("code", info=info, raw="".join(x + "\n" for x in out))
            out.append(self.lines[i] if c is None else c)
        raise MarkdownError(self.first_line + opened, "expected a closing code fence")

    def quote(self, least: int) -> Block:
        start, out = self.at, []
        while self.at < len(self.lines):
            c = self.content(self.at, least)
            if c is not None and c.startswith(">"):
                out.append(c[1:].removeprefix(" "))
            elif _is_blank(self.lines[self.at]):
                out.append("")
            else:
                break
            self.at += 1
        return Block("blockquote", children=_Reader(out, self.refs, self.first_line + start).blocks(0))

    def table(self, least: int) -> Block | None:
        if self.at + 1 >= len(self.lines):
            return None
        pair = [self.content(i, least) for i in (self.at, self.at + 1)]
        if None in pair or not all(cells := [_cells(c) for c in pair]):
            return None
        align = _alignments(cells[1])
        if align is None or len(align) != len(cells[0]):
            return None
        self.at += 2

        def row(number: int, found: list[str], kind: str) -> list[Block]:
            return [Block(kind, inlines=inlines(c.strip(_BLANK), self.refs), row_no=number, cell_no=i) for i, c in enumerate(found)]

        out, number = row(0, cells[0], "table_header_cell"), 0
        while self.at < len(self.lines) and not _is_blank(self.lines[self.at]):
            c = self.content(self.at, least)
            found = None if c is None or self.starts_block(self.at, least) else _cells(c)
            if found is None:
                break
            number += 1
            out += row(number, found, "table_cell")
            self.at += 1
        return Block("table", children=tuple(out), align=align)

    def marker(self, at: int, least: int) -> re.Match | None:
        c = self.content(at, least)
        return _MARKER.match(c) if c is not None and not c.startswith(" ") else None

    def list(self, least: int) -> Block:
        first = self.marker(self.at, least)
        items, loose = [], False
        while self.at < len(self.lines) and (m := self.marker(self.at, least)) and (m.group(1) is None) == (first.group(1) is None):
            item, spaced = self.item(least, m)
            items.append(item)
            loose = loose or spaced
        start = None if first.group(1) is None else int(first.group(1).lstrip("0")[:21] or "0")
        return Block("list", children=tuple(items), list_kind="unordered" if start is None else "ordered", list_start=start, loose=loose)

    def item(self, least: int, m: re.Match) -> tuple[Block, bool]:
        text, task = m.group(2), "none"
        if t := _TASK.match(text):
            text, task = text[t.end() :], "unchecked" if t.group(1) == " " else "checked"
        inside = least + 2 + (len(m.group(1)) if m.group(1) else 0)
        self.at += 1
        own = _join([text, *self.take(inside, True)])
        loose = False
        if self.at < len(self.lines) and _is_blank(self.lines[self.at]):
            after = self.at
            while after < len(self.lines) and _is_blank(self.lines[after]):
                after += 1
            loose = after < len(self.lines) and (_indent(self.lines[after]) >= inside or self.marker(after, least) is not None)
        children = self.blocks(inside)
        if own.strip(_BLANK):
            children = (Block("paragraph", inlines=inlines(own, self.refs)), *children)
        return Block("list_item", children=children, task=task), loose


def _definition(line: str) -> tuple[str, tuple[str, str | None]] | None:
    text = line.strip(_BLANK)
    at = text.find("]:", 1) if text.startswith("[") else -1
    target = text[at + 2 :].strip(_BLANK) if at >= 0 else ""
    return (_label(text[1:at]), _target(target)) if target else None


def parse(text: str) -> tuple[Block, ...]:
    """Blocks of a document."""
    lines = re.split(r"\r?\n", text)
    front: tuple[Block, ...] = ()
    if lines[0] == "---" and "---" in lines[1:]:
        end = lines.index("---", 1)
        front = (Block("frontmatter", raw="".join(x + "\n" for x in lines[1:end])),)
        lines = lines[end + 1 :]
    refs: dict[str, tuple] = {}
    kept = []
    for line in lines:
        found = _definition(line) if "]:" in line else None
        if found:
            refs.setdefault(*found)
        else:
            kept.append(line)
    return front + _Reader(kept, refs).blocks(0)


# node tables
def _inline_rows(block: int, nodes: tuple[Inline, ...], out: list[dict]) -> None:
    stack = [(n, None, 0, i) for i, n in reversed(list(enumerate(nodes)))]
    base = len(out)
    while stack:
        n, parent, depth, order = stack.pop()
        me = len(out) - base
        out.append({"block_node_id": block, "node_id": me, "parent_id": parent, "depth": depth, "ord": order, "kind": n.kind, "text": n.text, "href": n.href, "title": n.title})
        stack += [(c, me, depth + 1, i) for i, c in reversed(list(enumerate(n.children)))]


def rows(blocks: tuple[Block, ...]) -> tuple[list[dict], list[dict]]:
    """Block rows in pre-order, and the inline rows of each leaf."""
    out: list[dict] = []
    inner: list[dict] = []
    stack = [(b, None, 0, i) for i, b in reversed(list(enumerate(blocks)))]
    while stack:
        b, parent, depth, order = stack.pop()
        me = len(out)
        start = None if b.list_start is None or b.list_start >= 1 << 64 else Decimal(b.list_start)
        out.append(
            {"node_id": me, "parent_id": parent, "depth": depth, "ord": order, "kind": b.kind, "level": b.level, "info": b.info, "raw": b.raw, "list_kind": b.list_kind}
            | {"list_start": start, "loose": b.loose, "task": b.task, "align": None if b.align is None else list(b.align), "row_no": b.row_no, "cell_no": b.cell_no}
        )
        if b.inlines is not None:
            _inline_rows(me, b.inlines, inner)
        stack += [(c, me, depth + 1, i) for i, c in reversed(list(enumerate(b.children)))]
    return out, inner


# debug text
_LEVELS = ("One", "Two", "Three", "Four", "Five", "Six")
_TASKS = {"none": "NoTask", "unchecked": "Unchecked", "checked": "Checked"}
_NAMES = {"strong": "Strong", "emphasis": "Emphasis", "strikethrough": "Strikethrough", "text": "Text", "code": "InlineCode", "html_inline": "HtmlInline"}


def _show(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _show_all(items, show) -> str:
    return "[" + ", ".join(map(show, items)) + "]"


def inline_debug(n: Inline) -> str:
    if n.kind == "hard_break":
        return "HardBreak"
    if n.kind in ("link", "image"):
        title = "None" if n.title is None else f"Some({_show(n.title)})"
        name, label = ("Link", "label") if n.kind == "link" else ("Image", "alt")
        return f"{name}({{ {label}: {_show_all(n.children, inline_debug)}, target: {{ href: {_show(n.href)}, title: {title} }} }})"
    return f"{_NAMES[n.kind]}({_show(n.text) if n.text is not None else _show_all(n.children, inline_debug)})"


def block_debug(b: Block) -> str:
    content = lambda x: _show_all(x.inlines or (), inline_debug)
    if b.kind == "heading":
        return f"Heading({{ level: {_LEVELS[b.level - 1]}, content: {content(b)} }})"
    if b.kind == "paragraph":
        return f"Paragraph({content(b)})"
    if b.kind == "blockquote":
        return f"Blockquote({_show_all(b.children, block_debug)})"
    if b.kind == "list":
        kind = "Unordered" if b.list_kind == "unordered" else f"Ordered({{ start: {b.list_start} }})"
        items = _show_all(b.children, lambda i: f"{{ task: {_TASKS[i.task]}, blocks: {_show_all(i.children, block_debug)} }}")
        return f"ListBlock({{ kind: {kind}, loose: {b.loose}, items: {items} }})"
    if b.kind == "code":
        return f"Code({{ info: {_show(b.info)}, pre: {_show(b.raw)} }})"
    if b.kind == "table":
        header = _show_all([c for c in b.children if c.kind == "table_header_cell"], content)
        numbers = sorted({c.row_no for c in b.children if c.kind == "table_cell"})
        lines = _show_all(numbers, lambda k: _show_all([c for c in b.children if c.kind == "table_cell" and c.row_no == k], content))
        return f"Table({{ header: {header}, align: {_show_all(b.align, str.capitalize)}, rows: {lines} }})"
    if b.kind == "html":
        return f"HtmlBlock({_show(b.raw)})"
    if b.kind == "frontmatter":
        return f"Frontmatter({{ raw: {_show(b.raw)} }})"
    return "ThematicBreak"


# rendering back to plain text
def render_inlines(nodes: tuple[Inline, ...]) -> str:
    wrap = {"strong": "**", "emphasis": "*", "strikethrough": "~~"}
    out = []
    for n in nodes:
        if n.kind in wrap:
            out.append(wrap[n.kind] + render_inlines(n.children) + wrap[n.kind])
        elif n.kind in ("link", "image"):
            out.append(("!" if n.kind == "image" else "") + f"[{render_inlines(n.children)}]({n.href})")
        elif n.kind == "code":
            out.append(f"`{n.text}`")
        else:
            out.append("\\n" if n.kind == "hard_break" else n.text)
    return "".join(out)


def render(blocks: tuple[Block, ...]) -> str:
    """One line a block, as an outline of the document."""
    out = []
    for b in blocks:
        said = render_inlines(b.inlines or ())
        if b.kind == "heading":
            out.append(f"HEADING: {_LEVELS[b.level - 1]} {said}\n")
        elif b.kind == "paragraph":
            out.append(f"PARAGRAPH: {said}\n")
        elif b.kind == "blockquote":
            out.append("BLOCKQUOTE:\n" + render(b.children))
        elif b.kind == "list":
            kind = "unordered" if b.list_kind == "unordered" else f"ordered:{b.list_start}"
            out.append(f"LIST {kind} loose={str(b.loose).lower()}:\n" + "".join(f"- {i.task}\n{render(i.children)}" for i in b.children))
        elif b.kind == "code":
            out.append(f"CODE: info: {_show(b.info)}, pre: {_show(b.raw)}\n")
        elif b.kind == "table":
            numbers = sorted({c.row_no for c in b.children})
            lines = ["|".join(render_inlines(c.inlines) for c in b.children if c.row_no == k) for k in numbers]
            out.append(f"TABLE: {lines[0]} | {','.join(b.align)} | {';'.join(lines[1:])}\n")
        elif b.kind == "html":
            out.append(f"HTML: {_show(b.raw)}\n")
        elif b.kind == "frontmatter":
            out.append(f"FRONTMATTER: {_show(b.raw)}\n")
        else:
            out.append("THEMATIC BREAK\n")
    return "".join(out)


def _guarded(text: str, make):
    try:
        return make(parse(text)), None
    except MarkdownError as e:
        return None, error_row(FAILURE, e.message, e.line, 1)
    except RecursionError:
        return None, error_row(FAILURE, "nested too deeply", 1, 1)


@lru_cache(maxsize=32)
def _parser(kinds: tuple[str, ...] | None, max_depth: int | None, want: str):
    def parse_row(text: str) -> dict:
        found, error = _guarded(text, rows)
        if found is None:
            return {"blocks": None, "inlines": None, "error": error}
        keep = lambda x: (not kinds or x["kind"] in kinds) and (max_depth is None or x["depth"] <= max_depth)
        blocks, inner = ([x for x in part if keep(x)] if want in ("both", name) else None for name, part in zip(("blocks", "inlines"), found))
        return {"blocks": blocks, "inlines": inner, "error": None}

    return node_function(parse_row, RESULT)


_DEBUG = node_function(lambda text: _guarded(text, lambda b: _show_all(b, block_debug))[0], "string")
_RENDER = node_function(lambda text: _guarded(text, render)[0], "string")


def md_parse(column: Column | str, *, kinds: tuple[str, ...] | None = None, max_depth: int | None = None, want: str = "both") -> Column:
    """``struct<blocks, inlines, error>``; ``want`` (both, blocks, inlines), ``kinds`` and ``max_depth`` leave rows out before they reach Spark."""
    return _parser(tuple(kinds) if kinds else None, max_depth, want)(as_column(column))


def md_blocks(df: DataFrame, column: str, *keys: str, kinds: tuple[str, ...] | None = None, max_depth: int | None = None) -> DataFrame:
    """One row a block beside ``keys``; list items and table cells are blocks too."""
    from loomtext.operators.tables import node_rows

    return node_rows(df, md_parse(column, kinds=kinds, max_depth=max_depth, want="blocks"), keys, nodes="blocks")


def md_inlines(df: DataFrame, column: str, *keys: str, kinds: tuple[str, ...] | None = None, max_depth: int | None = None) -> DataFrame:
    """One row an inline node beside ``keys``."""
    from loomtext.operators.tables import node_rows

    return node_rows(df, md_parse(column, kinds=kinds, max_depth=max_depth, want="inlines"), keys, nodes="inlines")


def md_has_marks(column: Column | str) -> Column:
    """Whether a text can hold any inline node but text: a filter to put before ``md_inlines``."""
    return as_column(column).rlike(r"[*_`\[<\\]|~~|https?://|www\.|  \n")


def md_debug(column: Column | str) -> Column:
    """Debug text of the blocks; null where the document fails."""
    return _DEBUG(as_column(column))


def md_render(column: Column | str) -> Column:
    """Plain outline of the document; null where it fails."""
    return _RENDER(as_column(column))


# regular parts: built-in expressions only
def md_heading(column: Column | str) -> Column:
    """``struct<level, content>`` of a text that is one ATX or two-line heading as a whole."""
    c = as_column(column)
    hashes, two = r"\A(#{1,6}) ([^\n\r]*+)\z", r"\A([^\n\r]*+)\r?\n(==++|--++)\z"
    trimmed = F.trim(F.regexp_extract(c, hashes, 2), F.lit(_BLANK))
    bare = F.regexp_replace(trimmed, "#+$", "")
    content = F.when(bare == trimmed, trimmed).otherwise(F.trim(bare, F.lit(_BLANK)))
    under = F.regexp_extract(c, two, 2)
    return F.when(c.rlike(hashes), F.struct(F.length(F.regexp_extract(c, hashes, 1)).alias("level"), content.alias("content"))).when(
        c.rlike(two), F.struct(F.when(under.startswith("="), 1).otherwise(2).alias("level"), F.regexp_extract(c, two, 1).alias("content"))
    )


def _link(column: Column | str, mark: str) -> Column:
    c = as_column(column)
    pattern = rf"(?s)\A{mark}\[([^\]]*+)\]\(([^)]*+)\)\z"
    target = F.trim(F.regexp_extract(c, pattern, 2), F.lit(_BLANK))
    rest = F.trim(F.regexp_extract(target, r"(?s)\A[^ \t]*+[ \t](.*)\z", 1), F.lit(_BLANK))
    quoted = r"(?s)\A(?:\"([^\"]*+)|'([^']*+))"
    title = F.when(rest.startswith('"'), F.regexp_extract(rest, quoted, 1)).when(rest.startswith("'"), F.regexp_extract(rest, quoted, 2)).otherwise(rest)
    return F.when(
        c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("label"), F.regexp_extract(target, r"\A([^ \t]*+)", 1).alias("href"), F.when(rest != "", title).alias("title"))
    )


def md_link(column: Column | str) -> Column:
    """``struct<label, href, title>`` of a text that is one link as a whole."""
    return _link(column, "")


def md_image(column: Column | str) -> Column:
    """``struct<label, href, title>`` of a text that is one image as a whole."""
    return _link(column, "!")


def md_code(column: Column | str) -> Column:
    """``struct<info, pre>`` of a text that is one block between triple backticks, closed by the first ones after it."""
    c = as_column(column)
    pattern = r"(?s)\A```(?>([^\n\r]*+)\r?\n|)((?:(?!```).)*+)```\z"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("info"), F.regexp_extract(c, pattern, 2).alias("pre")))


def md_frontmatter(column: Column | str) -> Column:
    """Raw text of the frontmatter, each line ended by a line feed; null without one.  Feeds ``yaml_parse``."""
    c = as_column(column)
    pattern = r"(?s)\A---\r?\n((?:(?!---\r?(?:\n|\z))[^\n]*+\n)*+)---(?:\r?\n|\z)"
    return F.when(c.rlike(pattern), F.replace(F.regexp_extract(c, pattern, 1), F.lit("\r\n"), F.lit("\n")))
