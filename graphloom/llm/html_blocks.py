"""Leaf blocks of an HTML page: the text between two block boundaries, with the path of elements that it stands in.

The page is cut by one regular expression that cannot go back on itself, so time grows with the page. Elements that may be left open
(p, li, cells and so on) end where a browser would end them; an end tag closes its element and what is open inside it, and is
ignored where nothing of that name is open. Formatting elements (b, span, a and so on) make no block of their own, nor do formulas
and objects, whose text stays. Drawings and media without an end tag end where a block element starts, a template without one is passed over
like an unknown tag; scripts, styles and other plain content without one reach to the end of the page, as in a browser.

Open elements are linked nodes, each with what it adds to its parent's path, so nesting of any depth costs no more than the same tags side by side.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from html import unescape

import numpy as np

#: Rows of the table of path vectors.
PATHS = 4096

#: Elements of the HTML standard by how they take part in blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
INLINE |= frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics object".split())
UNSEEN = frozenset("script style template svg annotation annotation-xml iframe noembed noframes canvas audio video head title".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
ENDS_ITS_LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
ENDS_ITS_LIKE |= {"thead": ENDS_ITS_LIKE["tbody"], "tfoot": ENDS_ITS_LIKE["tbody"]}
#: An element left open is looked for no further up than these.
FENCES = frozenset("ul ol dl table td th select div section article aside main nav header footer form body html".split())

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""",
    re.S,
)
#: One attribute after the other, so that neither a longer name nor another value is taken for one of SHOWN.
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>]++)))?+""")
SHOWN = frozenset("class id role hidden aria-hidden style".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements of UNSEEN that a page may leave open with text behind them.
OPEN_ENDED = frozenset("svg canvas audio video annotation annotation-xml".split())
_BLOCK_START = re.compile(rf"<(?:{'|'.join(sorted(ENDS_P | frozenset(ENDS_ITS_LIKE)))})(?=[\s/>])", re.I)
_SVG_PARTS = re.compile(rf"<(?:(?P<end>/?)(?P<name>svg|foreignobject)(?=[\s/>])[^>]*+|(?P<block>{_BLOCK_START.pattern[1:]}))", re.I)
_TEMPLATE = re.compile(r"<(?P<end>/?)template(?=[\s/>])[^>]*+>", re.I)
_raw_ends: dict[str, re.Pattern] = {}


class Node:
    """An open element: ``rows`` are those of the path table that its parent's path lacks. ``vector`` is for whoever adds them up."""

    __slots__ = ("parent", "tag", "rows", "vector")

    def __init__(self, parent: Node | None, tag: str, rows: tuple[int, ...]):
        self.parent, self.tag, self.rows = parent, tag, rows
        self.vector: np.ndarray | None = None


@dataclass
class Block:
    """A text with the innermost element that it stands in; ``leaf`` is a further row of the path table for it (none: empty), ``linked`` counts characters in links."""

    node: Node | None
    leaf: tuple[int, ...]
    text: str
    linked: int


def row_of(token: str) -> int:
    return zlib.crc32(token.encode()) % PATHS


def _words_of(tag: str, attrs: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role; ``hidden`` if it isn't shown."""
    out = [tag]
    if attrs:
        for m in _ATTRIBUTE.finditer(attrs):
            key = m[1].lower()
            if key not in SHOWN:
                continue
            value = m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                out += [x.lower() for x in _NAMES.findall(value)]
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("hidden")
    return tuple(out)


_rows: dict[tuple[str, str, str], tuple[int, ...]] = {}


def _element_rows(parent: str, tag: str, attrs: str) -> tuple[int, ...]:
    """Rows of the path table that an element says: its words, and its tag in that of its parent. A bounded number of answers is kept."""
    key = (parent, tag, attrs)
    found = _rows.get(key)
    if found is None:
        if len(_rows) >= 20_000:
            _rows.clear()
        tokens = {*_words_of(tag, attrs), f"{parent}>{tag}"} if parent else set(_words_of(tag, attrs))
        found = tuple(sorted(set(map(row_of, tokens))))
        if len(attrs) < 200:
            _rows[key] = found
    return found


def _templates(html: str) -> dict[int, int]:
    """For the start tags of templates that are closed: where the tag ends, and where its end tag does."""
    found: dict[int, int] = {}
    open_: list[int] = []
    for m in _TEMPLATE.finditer(html):
        if not m["end"]:
            open_.append(m.end())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def _after(html: str, tag: str, at: int) -> int:
    """Where the content of an element that holds plain characters ends: behind its end tag, or at the end of the page."""
    if tag not in _raw_ends:
        _raw_ends[tag] = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I)
    m = _raw_ends[tag].search(html, at)
    return m.end() if m else len(html)


def _after_open_ended(html: str, tag: str, at: int, plain: set[str]) -> int:
    """Where an element of OPEN_ENDED ends: behind its end tag or, if it has none, before the next block element, or else at the end of the page.

    Blocks inside a foreignObject belong to their drawing. ``plain`` remembers that a drawing reached the end of the page, so that none behind it reads as far again.
    """
    if tag == "svg":
        depth, foreign, block = 1, 0, None
        for m in _SVG_PARTS.finditer(html, at):
            if m["block"]:
                block = m.start() if block is None else block
                if not foreign or tag in plain:
                    return block
            elif m["name"].lower() == "foreignobject":
                foreign = max(0, foreign - 1) if m["end"] else foreign + (m[0][-1] != "/")
            elif m["end"]:
                depth -= 1
                if not depth:
                    return min(len(html), m.end() + 1)
            elif m[0][-1] != "/":
                depth += 1
        plain.add(tag)
    else:
        name = f"<{tag}"
        if name not in _raw_ends:
            _raw_ends[name] = re.compile(rf"<(?P<end>/?){tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)
        m = _raw_ends[name].search(html, at) if tag not in plain else None
        if m and m["end"]:
            return m.end()
        if not m:
            plain.add(tag)
        b = _BLOCK_START.search(html, at)
        block = b.start() if b else None
    return len(html) if block is None else block


def blocks(html: str | None) -> list[Block]:
    """Blocks with any text, in page order; none for a null or empty page. What stands in head or is never shown is left out."""
    found: list[Block] = []
    if not html:
        return found
    stack: list[tuple[str, Node, tuple[int, ...]]] = []
    held: dict[int, int] = {}  # how many open elements say a row
    templates: dict[int, int] | None = None
    text: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(html)
    plain: set[str] = set()

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                leaf = row_of(f"leaf:{stack[-1][0] if stack else ''}")
                found.append(Block(stack[-1][1] if stack else None, () if held.get(leaf) else (leaf,), whole, linked))
            text.clear()
        linked = 0

    def pop(names: set[str] | frozenset[str], fences: frozenset[str]) -> None:
        """Close the highest open element of these names, if no fence stands before it, with all in it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                for _, _, rows in stack[i:]:
                    for r in rows:
                        held[r] -= 1
                del stack[i:]
                return
            if stack[i][0] in fences:
                return

    while at < n:
        m = _TAG.search(html, at)
        to = m.start() if m else n
        if to > at:
            part = html[at:to]
            text.append(part)
            if in_link:
                linked += len(part.strip())
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        tag = name.lower()
        if m["end"]:
            if tag == "a":
                in_link = False
            elif tag == "br":
                text.append(" ")
            elif tag not in INLINE:
                close()
                pop({tag}, frozenset())
            continue
        if tag in ("script", "style", "title", "iframe", "noembed", "noframes", "textarea"):
            at = _after(html, tag, at)
        elif tag == "head":
            continue
        elif tag == "template":
            templates = _templates(html) if templates is None else templates
            at = templates.get(at, at)
        elif tag in UNSEEN:
            if not m["attrs"].rstrip().endswith("/"):
                at = _after_open_ended(html, tag, at, plain) if tag in OPEN_ENDED else _after(html, tag, at)
        elif tag == "a":
            in_link = True
        elif tag == "br":
            text.append(" ")
        elif tag in INLINE or tag in VOID and tag != "hr":
            continue
        else:
            close()
            if tag in ENDS_P:
                pop({"p"}, FENCES)
            if tag in ENDS_ITS_LIKE:
                pop(ENDS_ITS_LIKE[tag], FENCES - ENDS_ITS_LIKE[tag] - {"div"})
                if tag in ("tr", "tbody", "thead", "tfoot"):
                    pop(ENDS_ITS_LIKE[tag] - {"td", "th"}, FENCES - {"td", "th", "div"})
            if tag not in VOID:
                rows = _element_rows(stack[-1][0] if stack else "", tag, m["attrs"])
                node = Node(stack[-1][1] if stack else None, tag, tuple([r for r in rows if not held.get(r)]))
                for r in rows:
                    held[r] = held.get(r, 0) + 1
                stack.append((tag, node, rows))
    close()
    return found
