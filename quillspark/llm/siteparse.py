"""A small tolerant HTML tree builder: blocks of text with the style path that leads to them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, and those among them that hold text to read.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li option select summary tbody td tfoot th thead tr".split())
#: An opening tag closes these if they are open inside the given scope.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}


@dataclass
class Node:
    name: str
    attrs: dict[str, str]
    parent: Node | None
    #: Text pieces and nodes, in order.
    items: list = field(default_factory=list)

    @property
    def style(self) -> str:
        """What a site's pages share of an element: its tag, classes and role, with numbers levelled."""
        marks = [self.attrs[k] for k in ("id", "class", "role") if self.attrs.get(k)]
        return self.name + "".join("|" + re.sub(r"\d+", "0", x).lower() for x in marks)


def parse(text: str) -> Node:
    """The root of the tree of a page, however broken its markup is."""
    root = Node("#root", {}, None)
    here, at, n = root, 0, len(text)
    while at < n:
        opening = text.find("<", at)
        if opening < 0:
            opening = n
        if opening > at:
            here.items.append(text[at:opening])
        if opening == n:
            break
        found = _TOKEN.match(text, opening)
        if not found:
            here.items.append("<")
            at = opening + 1
            continue
        at = found.end()
        if found["cdata"] is not None:
            here.items.append(found["cdata"])
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["close"] or found["close2"]:
            here = _close(here, name)
            continue
        attrs = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(found["attrs"] or found["attrs2"] or "")}
        here = _before(here, name)
        node = Node(name, attrs, here)
        here.items.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            node.items.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID:
            here = node
    return root


def _before(here: Node, name: str) -> Node:
    """Where a new element goes, after the elements that it ends."""
    if name in _ENDS_P:
        node = here
        while node.parent is not None and node.name not in ("table", "td", "th", "button", "object"):
            if node.name == "p":
                return _before(node.parent, name)
            if node.name in BLOCK:
                break
            node = node.parent
    if name in _CLOSES:
        ends, scope = _CLOSES[name]
        last, node = None, here
        while node.parent is not None and node.name not in scope:
            if node.name in ends:
                last = node
            node = node.parent
        if last is not None:
            return last.parent
    return here


def _close(here: Node, name: str) -> Node:
    node = here
    while node.parent is not None:
        if node.name == name:
            return node.parent
        if name not in BLOCK and node.name in BLOCK:
            return here  # an inline end tag doesn't end a block
        node = node.parent
    return here


@dataclass
class Block:
    text: str
    #: The element that the block's text begins in, and whether that or one above it is of the given names.
    node: Node
    inside: bool


def blocks(root: Node, skip, names: frozenset[str] | tuple[str, ...] = ()) -> list[Block]:
    """Text blocks in page order, without the branches for which ``skip(node)`` holds."""
    out: list[Block] = []
    held: list[str] = []
    own, inside, said = root, False, False

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            out.append(Block(text, own, inside))
        held.clear()

    stack: list[tuple[Node, int, bool]] = [(root, 0, root.name in names)]
    while stack:
        node, at, within = stack.pop()
        if at == len(node.items):
            if node.name in BLOCK:
                flush()
                said = False
            continue
        stack.append((node, at + 1, within))
        item = node.items[at]
        if isinstance(item, str):
            if not said:  # only white space so far
                own, inside, said = node, within, bool(item.strip())
            held.append(item)
        elif item.name == "br":
            held.append(" ")
        elif not skip(item):
            if item.name in BLOCK:
                flush()
                said = False
            if item.name not in VOID:
                stack.append((item, 0, within or item.name in names))
    flush()
    return out
