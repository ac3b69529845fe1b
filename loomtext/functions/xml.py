"""XML documents (elements, attributes, text, CDATA) as node tables.

The subset: names of letters, ``: _ - .``; attribute values raw; no entities, comments,
processing instructions or doctype; an end tag's name is not compared with its start.
Parsing keeps an explicit stack, so depth costs no recursion.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.nodes import as_column, node_function
from loomtext.result import FAILURE, INCOMPLETE, error_column, error_row, position

_WS = r"[ \t\r\n]*+"
_NAME = r"[A-Za-z:_][A-Za-z:_.-]*+"
_DECLARATION = re.compile(
    rf"<\?xml[ \t\r\n]++version{_WS}={_WS}(?:\"1\.([0-9]++)\"|'1\.([0-9]++)')"
    rf"(?:[ \t\r\n]++encoding{_WS}={_WS}(?:\"([A-Za-z][A-Za-z0-9._-]*+)\"|'([A-Za-z][A-Za-z0-9._-]*+)'))?+{_WS}\?>"
)
_SPACE = re.compile(_WS)
_OPEN = re.compile(rf"<({_NAME})")
_ATTRIBUTE = re.compile(rf"{_WS}({_NAME}){_WS}={_WS}(?:\"([^\"]*+)\"|'([^']*+)')")
_CLOSE = re.compile(rf"</{_NAME}{_WS}>")
_CHARACTERS = re.compile(r"[^<&]++")
_CDATA = "<![CDATA["

NODE = (
    "struct<node_id: int, parent_id: int, depth: int, ord: int, path: string, kind: string, name: string, attrs: array<struct<name: string, value: string>>, text: string>"
)
RESULT = f"struct<version_minor: smallint, encoding: string, nodes: array<{NODE}>, error: struct<kind: string, message: string, line: bigint, col: bigint, record: bigint>>"


class _Bad(Exception):
    def __init__(self, at: int, message: str, kind: str = FAILURE):
        self.at, self.message, self.kind = at, message, kind


def _start_tag(s: str, at: int) -> tuple[str, list[dict], bool, int]:
    """(name, attributes, whether it ends itself, end)."""
    m = _OPEN.match(s, at)
    if m is None:
        raise _Bad(at, "expected an element")
    name, at, attributes = m.group(1), m.end(), []
    while m := _ATTRIBUTE.match(s, at):
        attributes.append({"name": m.group(1), "value": m.group(2) if m.group(2) is not None else m.group(3)})
        at = m.end()
    at = _SPACE.match(s, at).end()
    if s.startswith(">", at):
        return name, attributes, False, at + 1
    if s.startswith("/>", at):
        return name, attributes, True, at + 2
    raise _Bad(at, "expected an attribute or the end of the tag")


def parse_document(s: str) -> dict:
    """Declaration and nodes in pre-order, or an error."""
    version = encoding = None
    nodes: list[dict] = []
    stack: list[tuple[int, str, list[int]]] = []  # node, path, number of children so far

    def add(kind: str, name: str | None, attributes: list[dict] | None, text: str | None) -> str:
        parent, path, count = stack[-1] if stack else (None, "", [0])
        own = f"{path}/{count[0]}"
        nodes.append({"node_id": len(nodes), "parent_id": parent, "depth": len(stack), "ord": count[0], "path": own, "kind": kind, "name": name, "attrs": attributes, "text": text})
        count[0] += 1
        return own

    try:
        at = 0
        if m := _DECLARATION.match(s):
            at = m.end()
            version, encoding = int(m.group(1) or m.group(2)) % 256, m.group(3) or m.group(4)
        at = _SPACE.match(s, at).end()
        while True:
            if not stack or (s.startswith("<", at) and not s.startswith(("</", _CDATA), at)):
                name, attributes, ended, at = _start_tag(s, at)
                own = add("element", name, attributes, None)
                if not ended:
                    stack.append((len(nodes) - 1, own, [0]))
            elif s.startswith(_CDATA, at):
                end = s.find("]]>", at + len(_CDATA))
                if end < 0:
                    raise _Bad(at, "expected the end of a CDATA section")
                add("text", None, None, s[at + len(_CDATA) : end])
                at = end + 3
            elif m := _CHARACTERS.match(s, at):
                add("text", None, None, m.group())
                at = m.end()
            elif m := _CLOSE.match(s, at):
                stack.pop()
                at = m.end()
            else:
                raise _Bad(at, "expected text, an element or an end tag")
            if not stack:
                break
        at = _SPACE.match(s, at).end()
        if at < len(s):
            raise _Bad(at, "input was left over", INCOMPLETE)
    except _Bad as bad:
        return {"version_minor": None, "encoding": None, "nodes": None, "error": error_row(bad.kind, bad.message, *position(s, bad.at))}
    return {"version_minor": version, "encoding": encoding, "nodes": nodes, "error": None}


@lru_cache(maxsize=32)
def _parser(kinds: tuple[str, ...] | None, max_depth: int | None):
    def parse(s: str) -> dict:
        out = parse_document(s)
        if out["nodes"] is not None and (kinds or max_depth is not None):
            out["nodes"] = [n for n in out["nodes"] if (not kinds or n["kind"] in kinds) and (max_depth is None or n["depth"] <= max_depth)]
        return out

    return node_function(parse, RESULT)


def xml_parse(column: Column | str, *, kinds: tuple[str, ...] | None = None, max_depth: int | None = None) -> Column:
    """``struct<version_minor, encoding, nodes, error>``; ``kinds`` and ``max_depth`` leave nodes out before they reach Spark.

    A text that does not begin like XML is an error without a Python call.
    """
    text = as_column(column)
    likely = text.rlike(r"\A(?:<\?xml|[ \t\r\n]*+<[A-Za-z:_])")
    parsed = _parser(tuple(kinds) if kinds else None, max_depth)(F.when(likely, text))
    nothing = lambda kind: F.lit(None).cast(kind)
    unlikely = F.struct(
        nothing("smallint").alias("version_minor"), nothing("string").alias("encoding"), nothing(f"array<{NODE}>").alias("nodes"), error_column(FAILURE, "expected an element", line=1, col=1).alias("error")
    )
    return F.when(text.isNull(), None).when(likely, parsed).otherwise(unlikely)


def xml_nodes(df: DataFrame, column: str, *keys: str, kinds: tuple[str, ...] | None = None, max_depth: int | None = None) -> DataFrame:
    """One row a node beside ``keys``; a bad document is one row of kind ``error``."""
    from loomtext.operators.tables import node_rows

    return node_rows(df, xml_parse(column, kinds=kinds, max_depth=max_depth), keys)


def xml_decl(column: Column | str) -> Column:
    """``struct<version_minor, encoding>`` of the declaration, null without one; no Python runs."""
    text = as_column(column)
    pattern = rf"\A{_DECLARATION.pattern}"
    group = lambda k: F.regexp_extract(text, pattern, k)
    either = lambda a, b: F.when(group(a) != "", group(a)).when(group(b) != "", group(b))
    return F.when(text.rlike(pattern), F.struct((either(1, 2).try_cast("decimal(38,0)") % 256).cast("smallint").alias("version_minor"), either(3, 4).alias("encoding")))


def nodes_dsl(nodes: list[dict]) -> str:
    """A tree as nested calls: name, bracketed attributes, bracketed children, four blanks a level."""
    boxed = lambda lines, pad: "[\n" + ",\n".join(lines) + f"\n{pad}]" if lines else "[]"
    inside: dict[int | None, list[str]] = {}
    for n in reversed(nodes):  # children come after their parent
        pad = "    " * n["depth"]
        if n["kind"] == "element":
            given = [f'{pad}    {a["name"]} "{a["value"]}"' for a in n["attrs"] or ()]
            line = f"{pad}{n['name']} {boxed(given, pad)} {boxed(inside.pop(n['node_id'], [])[::-1], pad)}"
        else:
            line = f'{pad}text "{n["text"]}"'
        inside.setdefault(n["parent_id"], []).append(line)
    return inside[nodes[0]["parent_id"]][-1]


@lru_cache(maxsize=1)
def _dsl():
    def render(s: str) -> str | None:
        nodes = parse_document(s)["nodes"]
        return nodes_dsl(nodes) if nodes else None

    return node_function(render, "string")


def xml_dsl(column: Column | str) -> Column:
    """The document's tree as text of nested calls; null where it fails."""
    return _dsl()(as_column(column))
