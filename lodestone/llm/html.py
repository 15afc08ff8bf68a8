"""HTML as a tree of blocks: tokens, implied ends, character references, and what is never article text."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

# Elements by their role in a page.
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address hr details summary head title center".split()
)
RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "select", "object", "canvas", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("head title nav footer aside form fieldset button label dialog menu script style noscript template iframe svg select textarea object canvas math audio video".split())
BOILERPLATE = re.compile(
    r"(^|[-_\s])(ads?|adverts?|advertisement|adsense|banner|sponsor(ed)?|cookies?|consent|notices|sidebar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"comments?|commentlist|comment[-_]?list|respond|replies|disqus|footer|masthead|site[-_]?header|page[-_]?header|topbar|newsletter|subscribe|signup|popup|overlay|"
    r"toolbar|pagination|pager|hidden)($|[-_\s])",
    re.I,
)
# Words that boilerplate bears as often as articles do: the host's wrapper decides.
DOUBTFUL = re.compile(r"(^|[-_\s])(promo|promotion|notice|alert|side|share|sharing|social|related|recommended|modal|widget|skip|legal|copyright)($|[-_\s])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_CLOSED_BY_BLOCK = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSED_BY_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "article", "section", "main", "div"))


class Node:
    """A block: its sign (tag and first class), whether it can hold article text (0 yes, 1 in doubt, 2 no), and its pieces in order: blocks, or (text, is a link's)."""

    __slots__ = ("tag", "sign", "skip", "pieces")

    def __init__(self, tag: str, sign: str, skip: int) -> None:
        self.tag, self.sign, self.skip, self.pieces = tag, sign, skip, []


def _attributes(tag: str, text: str, inside_article: bool) -> tuple[str, int]:
    """The element's sign, and whether it is boilerplate."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text else {}
    names = found.get("class", "").split()
    sign = tag + ("." + re.sub(r"\d+", "0", names[0]) if names else "")
    if tag in NOT_TEXT or (tag == "header" and not inside_article):
        return sign, 2
    if not found or tag in ("html", "body"):
        return sign, 0
    label = " ".join([*names, found.get("id", "")])
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or BOILERPLATE.search(label):
        return sign, 2
    return sign, int(bool(DOUBTFUL.search(label)))


def parse(html: str) -> Node:
    """The page's tree of blocks; anything parses."""
    root = Node("", "", 0)
    stack, at, links, articles = [root], 0, 0, 0
    matches = _TOKEN.finditer(html)
    skip_to = 0
    open_: Counter[str] = Counter()
    endless: set[str] = set()

    def end_of(tag: str, at: int) -> int | None:
        close = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
        if close is None:
            endless.add(tag)  # nor will later ones end
            return None
        return close.end()

    def leave() -> Node:
        nonlocal articles
        gone = stack.pop()
        open_[gone.tag] -= 1
        articles -= gone.tag in ("article", "main")
        return gone

    for m in matches:
        if m.start() < skip_to:
            continue
        if m.start() > at:
            stack[-1].pieces.append((unescape(html[at : m.start()]), links > 0))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS and open_[tag]:
                while leave().tag != tag:
                    pass
            continue
        if tag in RAW:
            at = skip_to = end_of(tag, at) or len(html)
            stack[-1].pieces.append((" ", False))
            continue
        if tag == "a":
            links += not m[3].endswith("/")
        elif tag == "br":
            stack[-1].pieces.append((" ", False))
        elif tag in BLOCKS or tag in NOT_TEXT:
            if tag in VOID:
                stack[-1].pieces.append(Node(tag, tag, 0))
                continue
            sign, skip = _attributes(tag, m[3], articles > 0)
            if tag in BLOCKS:
                links = 0
                while stack[-1].tag in _CLOSED_BY_BLOCK:
                    leave()
                closes = _CLOSED_BY_SELF.get(tag, ())
                while closes and stack[-1].tag in closes and stack[-1].tag not in _SCOPE:
                    leave()
                node = Node(tag, sign, skip)
                stack[-1].pieces.append(node)
                stack.append(node)
                open_[tag] += 1
                articles += tag in ("article", "main")
            else:  # an inline element whose content is no text, such as a button
                at = skip_to = end_of(tag, at) or at
        elif m[3]:
            sign, skip = _attributes(tag, m[3], articles > 0)
            if skip == 2:  # an inline advert or hidden span
                at = skip_to = end_of(tag, at) or at
    if at < len(html):
        stack[-1].pieces.append((unescape(html[at:]), links > 0))
    return root


class Block(NamedTuple):
    """A block's text, white space made single; the signs of the elements around it, whether they are boilerplate, and how many characters are links'."""

    path: tuple[str, ...]
    skip: int
    text: str
    links: int


#: Signs of a path; deeper elements, and runs of equal ones, do not tell blocks apart.
DEPTH = 64


def blocks(root: Node) -> list[Block]:
    """The page's blocks of text in page order, but for those that are boilerplate for certain."""
    out: list[Block] = []
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            path, skip = around[-1]
            out.append(Block(path, skip, text, sum(len(" ".join(t.split())) for t, link in held if link)))
        held.clear()

    todo: list = [iter(root.pieces)]
    around: list[tuple[tuple[str, ...], int]] = [((), 0)]
    while todo:
        piece = next(todo[-1], None)
        if piece is None:
            flush()
            todo.pop()
            around.pop()
        elif isinstance(piece, tuple):
            held.append(piece)
        else:
            flush()
            if piece.skip < 2:
                path, skip = around[-1]
                if len(path) < DEPTH and path[-1:] != (piece.sign,):
                    path = (*path, piece.sign)
                todo.append(iter(piece.pieces))
                around.append((path, max(skip, piece.skip)))
    return out
