"""Main text of web pages by composite text density.

Every node of the parsed page gets a density: characters per tag, lowered where
characters sit in links.  The subtree with the largest sum of child densities is the
content; the least density on its path to the body is the threshold below which other
subtrees are left out.  Elements that are never article text (scripts, menus) are cut off
before; forms and what its name calls an advert, a notice or comments only where they hold
no article and little of the text around them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import map_arrow, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|</[^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head script style textarea title noscript template iframe noembed noframes nav footer aside button select option input svg canvas object audio video map dialog menu".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend", "summary"}
#: What bounds the search for an open paragraph, and what may stand in a head that is not closed.
_BOUNDS_P = frozenset("p button td th table article section div li".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Tag -> tags that its start ends, as far as the tag that bounds the search.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead"
    " comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended recommendations trending outbrain taboola widget widgets pagination pager skip complementary contentinfo search toolbar copyright".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words of place and shape: a name is one of the above if it has no other words than these beside it.
_BESIDE = frozenset(
    "site main page global primary secondary left right top bottom inner outer wrap wrapper container box block bar area zone slot unit panel section list item items link links row column grid group"
    " form field button buttons icon icons title heading text body author meta post posts article articles stories the this of by us div gpt".split()
)
#: A named subtree or a form with more than this share of the text around it is left to the densities; comments, and what stands beside an article, may outweigh it.
LITTLE, LITTLE_BESIDE = 1 / 3, 0.9
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("children", "density", "link_chars", "link_tags", "named", "parent", "skip", "slug", "sum", "tag", "tags", "chars")

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.children: list = []
        self.named = self.slug = ""


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m.group(1).lower(), unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return out


def _chrome(name: str) -> str:
    """What a whole name says: 'comments', 'name' (an advert, a menu, a notice) or ''."""
    said = ""
    for part in re.split(r"[^A-Za-z]+", name):
        for w in [part] if part.lower() in _WORDS else _CAMEL.findall(part):
            w = w.lower()
            if w in _COMMENTS:
                said = "comments"
            elif w in _WORDS:
                said = said or "name"
            elif len(w) > 1 and w not in _BESIDE:
                return ""
    return said


def _named_chrome(tag: str, attributes: dict[str, str]) -> tuple[str, str]:
    """What the names of an element say, and the id if only that says it; an article can only be comments."""
    if tag in _HEADINGS or tag in ("html", "body", "main"):
        return "", ""
    said = {_chrome(n) for n in (*attributes.get("class", "").split(), *attributes.get("role", "").split(), attributes.get("aria-label", ""))}
    by_id = _chrome(attributes.get("id", "")) if tag != "p" else ""
    only = attributes.get("id", "") if by_id and said == {""} else ""
    for kind in ("comments",) if tag == "article" else ("comments", "name"):
        if kind in said or kind == by_id:
            return kind, only
    return "", ""


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", "")))


def _text(n: Node) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += reversed(x.children)
    return "".join(out)


def _cut_named(root: Node) -> None:
    """Cuts named subtrees and forms that hold no article and little of the text around them.

    The text around is that of the nearest article or main, else of the page; text in links
    does not count.  Comments go first.  Where no article stands elsewhere on the page, names
    whose subtrees together hold more than half of that text say nothing; a section whose id
    is the slug of its heading is text.
    """
    for kinds in (("comments",), ("name", "form")):
        order, stack = [], [root]
        while stack:
            n = stack.pop()
            order.append(n)
            stack += [c for c in n.children if isinstance(c, Node)]
        plain, links, articles = {}, {}, {}  # articles: how many with text
        for n in reversed(order):
            i = id(n)
            plain[i] = links[i] = articles[i] = 0
            for c in n.children:
                if isinstance(c, Node):
                    plain[i] += plain[id(c)]
                    links[i] += links[id(c)]
                    articles[i] += articles[id(c)] or int(c.tag in ("article", "main") and c.named != "comments" and plain[id(c)] > 0)
                else:
                    plain[i] += len(c.strip())
            if n.tag == "a":
                plain[i], links[i] = 0, links[i] + plain[i]
        cuts: dict[int, list[Node]] = {}
        stack = [(root, root)]
        while stack:
            n, around = stack.pop()
            beside = n.named == "comments" or (n.named == "name" and around is root and articles[id(root)])
            little = LITTLE_BESIDE if beside else LITTLE
            if n.named in kinds and not articles[id(n)] and plain[id(n)] <= little * plain[id(around)]:
                if not (n.slug and n.named == "name" and n.tag in ("section", "div") and plain[id(n)] > links[id(n)] and _slug_of_heading(n)):
                    cuts.setdefault(id(around), []).append(n)
                    continue
            if n.tag in ("article", "main") and n.named != "comments":
                around = n
            stack += [(c, around) for c in n.children if isinstance(c, Node)]
        for around, each in cuts.items():
            trusted = kinds == ("comments",) or (around == id(root) and articles[around]) or 2 * sum(plain[id(n)] for n in each) <= plain[around]
            for n in each:
                if trusted or links[id(n)] >= plain[id(n)]:
                    n.skip, n.children = True, []


def _slug_of_heading(n: Node) -> bool:
    stack = [n]
    while stack:
        x = stack.pop()
        if x.tag in _HEADINGS:
            return "-".join(re.findall(r"\w+", _text(x).lower())) == "-".join(re.findall(r"\w+", n.slug.lower()))
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return False


class _Open:
    """The open elements, with the places of each tag, of blocks and of what bounds a paragraph.

    Each element is opened and closed once and every question is answered from the ends of
    these lists, so unmatched tags cost nothing more.
    """

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.bounds: list[int] = []

    def push(self, n: Node) -> None:
        at = len(self.stack)
        self.stack.append(n)
        self.places.setdefault(n.tag, []).append(at)
        if n.tag in _BLOCK:
            self.blocks.append(at)
        if n.tag in _BOUNDS_P:
            self.bounds.append(at)

    def close(self, at: int) -> None:
        """Close the element at place ``at`` and all inside."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()
        for kept in (self.blocks, self.bounds):
            while kept and kept[-1] >= at:
                kept.pop()

    def last(self, tag: str) -> int:
        """Place of the innermost open element of that tag; 0 if there is none."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def outermost(self, tags, after: int) -> int:
        """Place of the outermost open element of those tags inside place ``after``; 0 if there is none."""
        found = []
        for t in tags:
            own = self.places.get(t, ())
            i = bisect_right(own, after)
            found += own[i : i + 1]
        return min(found, default=0)


def parse(html: str) -> Node:
    """A tolerant tree; cut subtrees are marked ``skip`` and hold nothing."""
    root = Node("html", None, False)
    open_nodes = _Open(root)
    stack = open_nodes.stack
    at, place, size = 0, 0, len(html)
    tags_end = html.rfind(">") + 1  # no tag ends later
    doubtful = False

    def text(a: int, b: int):
        if b <= a:
            return
        if stack[-1].tag == "head" and not html[a:b].isspace():  # text ends a head
            open_nodes.close(open_nodes.last("head"))
        if not stack[-1].skip:
            stack[-1].children.append(unescape(html[a:b]) if html.find("&", a, b) >= 0 else html[a:b])

    while at < size:
        m = _TOKEN.search(html, at, max(at, tags_end))
        if m is None:
            break
        text(place, m.start())
        at = place = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                text(m.start() + 9, m.end() - 3 * m.group().endswith("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            found = open_nodes.last(tag)
            # an inline end tag never ends a block around it
            if found and (tag in _BLOCK or not open_nodes.blocks or open_nodes.blocks[-1] < found):
                open_nodes.close(found)
            continue
        if (head := open_nodes.last("head")) and tag not in _IN_HEAD:
            open_nodes.close(head)
        if tag in ("html", "body") and len(stack) > 1:
            continue
        if tag in _CLOSES_P and open_nodes.bounds and stack[open_nodes.bounds[-1]].tag == "p":
            open_nodes.close(open_nodes.bounds[-1])
        if tag in _ENDS:
            ended, bounds = _ENDS[tag]
            if found := open_nodes.outermost(ended, max(map(open_nodes.last, bounds))):
                open_nodes.close(found)
        around = stack[-1]
        attributes = m.group(3)
        named = _attributes(attributes) if attributes else {}
        site_header = tag == "header" and not open_nodes.last("article") and not open_nodes.last("main")
        node = Node(tag, around, around.skip or tag in _DROP or site_header or (bool(named) and _hidden(named)))
        if not node.skip:
            if named:
                node.named, node.slug = _named_chrome(tag, named)
            if tag == "form":
                node.named = node.named or "form"
        doubtful = doubtful or bool(node.named)
        if not around.skip:
            around.children.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(html, at, max(at, tags_end))
            at = place = end.end() if end else size
        elif tag not in _VOID and not attributes.endswith("/"):
            open_nodes.push(node)
    text(place, size)
    if doubtful:
        _cut_named(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Fill in the densities; nodes in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
            else:
                n.chars += len(c.strip())
        if n.tag == "a":
            n.link_chars = n.chars
    body_c, body_lc = max(1, root.chars), root.link_chars
    for n in order:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, max(1, n.link_tags)
        if not c:
            n.density = 0.0
            continue
        base = math.log(c / max(1, c - lc) * lc + body_lc / body_c * c + math.e)
        n.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t * math.log(max(math.e, c * t))
    for n in order:
        n.sum = sum(c.density for c in n.children if isinstance(c, Node)) if any(isinstance(c, Node) for c in n.children) else n.density
    return order


def _blocks(picked: list[Node]) -> list[str]:
    out, buffer = [], []

    def flush():
        if buffer:
            line = " ".join("".join(buffer).split())
            if line:
                out.append(line)
            buffer.clear()

    for top in picked:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                buffer.append(x)
            elif not x.skip:
                if x.tag == "br":
                    buffer.append(" ")
                    continue
                block = x.tag in _BLOCK or x is top
                if block:
                    flush()
                    stack.append(None)
                stack += reversed(x.children)
        flush()
    return out


def extract(html: str | None) -> str:
    """Main text: blocks in page order joined by a line feed, white space inside a block one blank.

    Null, empty and contentless pages give ''.  Nothing kept is cut short.
    """
    root = parse(html or "")
    order = _measure(root)
    if not root.chars:
        return ""
    best = max(order, key=lambda n: n.sum)  # the first of equals
    path, n = [], best
    while n is not None:
        path.append(n.density)
        n = n.parent
    threshold = min(path)
    marked = {id(best)}
    above, around, n = set(), {"article": [], "main": []}, best
    while n is not None:  # an article is taken whole; without one, main is
        above.add(id(n))
        around.get(n.tag, []).append(n)
        n = n.parent
    marked.update(id(n) for n in around["article"] or around["main"])
    if not any(id(n) in above for n in order if n.tag in ("article", "main")):
        # subtrees reached through nodes at or over the threshold each give their largest sum
        top: dict[int, Node] = {}
        for n in reversed(order):
            top[id(n)] = max([n, *(top[id(c)] for c in n.children if isinstance(c, Node))], key=lambda x: x.sum)
        stack = [root]
        while stack:
            n = stack.pop()
            if n.density >= threshold and n.chars:
                marked.add(id(top[id(n)]))
                stack += [c for c in n.children if isinstance(c, Node)]
    picked, covered = [], set()
    for n in order:  # parents come first
        if n.parent is not None and id(n.parent) in covered:
            covered.add(id(n))
        elif id(n) in marked:
            covered.add(id(n))
            picked.append(n)
    return "\n".join(_blocks(picked))


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: key, url, ``text``, ``n_chars`` (code points).  Repeated rows repeat; an empty table gives none; other columns are not read."""
    types = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def run(_, keys, urls, texts):
        found = [extract(t) for t in texts]
        yield {"__key": keys, "__url": urls, "text": found, "n_chars": [len(t) for t in found]}

    out = map_arrow(pages, [key, url, html], run, f"__key {types[0]}, __url {types[1]}, text string, n_chars bigint")
    return out.withColumnRenamed("__key", key).withColumnRenamed("__url", url)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
