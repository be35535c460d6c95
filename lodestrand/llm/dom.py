"""A small HTML tree builder: elements, their direct text, and where blocks begin and end."""

from __future__ import annotations

import re
from html import unescape

# Element names of HTML by how they lay out or parse.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe textarea select title head".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}
NEVER = frozenset()

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """An element. parts holds its direct texts and its children in order."""

    __slots__ = ("tag", "attributes", "parent", "parts", "depth", "index")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.parts: list = []
        self.depth = 0 if parent is None else parent.depth + 1
        self.index = -1


def attribute_text(source: str) -> str:
    """class, id and role of a tag, as one lower-case text."""
    if not source or "=" not in source:
        return ""
    return " ".join((a or b or c) for _, a, b, c in _ATTRIBUTE.findall(source)).lower()


def parse(html: str) -> list[Node]:
    """Elements in document order, the root first; unclosed and misnested tags are taken as browsers mostly do."""
    root = Node("#root", "", None)
    nodes = [root]
    now = root
    at, n = 0, len(html)
    search = _TOKEN.search
    while at < n:
        m = search(html, at)
        if m is None:
            now.parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            now.parts.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            x = now
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                now = x.parent
            elif tag == "p" or tag == "br":
                now.parts.append(" ")
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            now = _closed(now, tag, root)
        child = Node(tag, attribute_text(m.group(3)), now)
        now.parts.append(child)
        child.index = len(nodes)
        nodes.append(child)
        if tag in VOID or m.group(3).endswith("/") and tag not in CLOSES_P and tag not in INLINE:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        now = child
    root.index = 0
    return nodes


def _closed(now: Node, tag: str, root: Node) -> Node:
    """The open element that a start tag goes into, after what it implies to be closed."""
    shut, scope = CLOSED_BY.get(tag, NEVER), SCOPES.get(tag, NEVER)
    x, into = now, now
    while x is not root:
        if x.tag in scope:
            break
        if x.tag in shut or (x.tag == "p" and tag in CLOSES_P):
            into = x.parent
        elif x.tag not in INLINE and x.tag not in shut and x.tag != "p" and not scope:
            break
        x = x.parent
    return into
