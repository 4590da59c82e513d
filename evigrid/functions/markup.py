"""Small HTML helper used inside Arrow tasks: one document in, a node list out.

Selectors: tag, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr="x"]``, descendant, child
(``>``) and comma lists. Unclosed ``p`` and list items are closed where a browser would;
formatting elements are not re-opened.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
                     "ol p pre section table ul".split())
P_BARRIERS = ("button", "td", "th", "#document")
SAME_CLOSES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr",),
               "th": ("tr",), "option": ("select",)}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "pos")

    def __init__(self, tag, attrs, parent, pos):
        self.tag, self.attrs, self.parent, self.children, self.pos = tag, attrs, parent, [], pos

    @property
    def classes(self):
        return (self.attrs.get("class") or "").split()

    def text(self):
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#document", {}, None, -1)
        self.nodes = []

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close("p", P_BARRIERS)
        if tag in SAME_CLOSES:
            self._close(tag, SAME_CLOSES[tag])
        values = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        node = Node(tag, values, self.here, len(self.nodes))
        self.nodes.append(node)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close(tag, ())

    def handle_data(self, data):
        self.here.children.append(data)

    def _close(self, tag, barriers):
        self.here = _closed(self.here, tag, barriers)


# What HTMLParser reads alike in every version: plain tags, text, scripts, and little else. The attributes' group is empty for a bare tag.
_NAME = r"[A-Za-z][A-Za-z0-9]*"
_ATTRIBUTE = r"""[ \t\n]+([A-Za-z_][\w-]*)(?:=(?:"([^"&<>]*)"|'([^'&<>]*)'|([A-Za-z0-9_.-]+)(?![^ \t\n>])))?"""
_GROUPLESS = re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE).replace(r"[\w-]*)", r"[\w-]*+)")
_RAW = "|".join(rf"(?<=<{t}>)((?:(?!</|<!--).|</(?!\s*(?i:{t})))*+)(?=</{t}>)" for t in ("script", "style"))
_TOKEN = re.compile(
    rf"(([^<]+)|</({_NAME})>|<({_NAME})((?:{_GROUPLESS})*+)[ \t\n]*>(?:{_RAW}|(?<=<title>)([^<]+)(?=</title>))?"
    rf"|<!DOCTYPE[^<>]*>|<!--[^-<>]*(?:-[^-<>]+)*-->)", re.DOTALL | re.ASCII)
_ATTRIBUTES = re.compile(_ATTRIBUTE, re.ASCII)
#: Elements whose content is read by rules of their own.
_SPECIAL = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())


def _parse_plain(markup: str) -> list[Node] | None:
    """``parse`` of a document of plain tokens, several times as fast; None where there is any other."""
    tokens = _TOKEN.findall(markup)
    if sum(len(t[0]) for t in tokens) != len(markup):
        return None
    nodes = []
    here = Node("#document", {}, None, -1)
    for _, text, closing, tag, attributes, script, style, title in tokens:
        if text:
            here.children.append(unescape(text) if "&" in text else text)
        elif tag:
            tag = tag.lower()
            content = script or style or unescape(title)
            if tag in _SPECIAL and not content:
                return None
            if tag in CLOSES_P:
                here = _closed(here, "p", P_BARRIERS)
            if tag in SAME_CLOSES:
                here = _closed(here, tag, SAME_CLOSES[tag])
            values = {}
            if attributes:
                for name, *value in _ATTRIBUTES.findall(attributes):
                    values.setdefault(name.lower(), "".join(value))
            node = Node(tag, values, here, len(nodes))
            nodes.append(node)
            here.children.append(node)
            if tag not in VOID:
                here = node
            if content:
                node.children.append(content)
        elif closing:
            here = _closed(here, closing.lower(), ())
    return nodes


def _closed(here: Node, tag: str, barriers: tuple[str, ...]) -> Node:
    """The open element once the innermost open ``tag`` is closed, if there is one inside the barriers."""
    node = here
    while node is not None and node.tag != tag:
        if node.tag in barriers:
            return here
        node = node.parent
    return node.parent if node is not None and node.parent is not None else here


def parse(markup: str) -> list[Node]:
    """All elements in document order."""
    nodes = _parse_plain(markup)
    if nodes is not None:
        return nodes
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.nodes


_SIMPLE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:=[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]")


_COMPILED: dict = {}


def compile_selector(selector: str):
    """Comma list of [(combinator, tests)], rightmost step last."""
    if selector not in _COMPILED:
        _COMPILED[selector] = _compile(selector)
    return _COMPILED[selector]


_TAGS: dict = {}


def _last_tags(selector: str) -> frozenset[str] | None:
    """Tags of the elements a selector can match, None where it may be any."""
    if selector not in _TAGS:
        named = [[t[0].lower() for t in chain[-1][1] if t[0] and t[0] != "*"][:1] for chain in compile_selector(selector)]
        _TAGS[selector] = frozenset(n[0] for n in named) if all(named) else None
    return _TAGS[selector]


def _compile(selector: str):
    chains = []
    for part in selector.split(","):
        steps, link = [], " "
        for word in re.findall(r">|[^\s>]+", part.strip()):
            if word == ">":
                link = ">"
                continue
            tests, end = [], 0
            for m in _SIMPLE.finditer(word):
                if m.start() != end:
                    break
                end = m.end()
                tests.append((m["tag"], m["cls"], m["id"], m["attr"], m["val"]))
            if end != len(word):
                raise ValueError("unsupported_selector")
            steps.append((link, tests))
            link = " "
        if not steps:
            raise ValueError("unsupported_selector")
        chains.append(steps)
    return chains


def _passes(node, tests):
    for tag, cls, ident, attr, val in tests:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if cls and cls not in node.classes:
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr and (attr not in node.attrs or (val is not None and node.attrs[attr] != val)):
            return False
    return True


def _matches(node, steps):
    link, tests = steps[-1]
    if not _passes(node, tests):
        return False
    if len(steps) == 1:
        return True
    up = node.parent
    while up is not None and up.parent is not None:
        if _matches(up, steps[:-1]):
            return True
        if link == ">":
            return False
        up = up.parent
    return False


def select(nodes: list[Node], selector: str, root: Node | None = None, first: bool = False) -> list[Node]:
    """Matching elements in document order, below ``root`` where given."""
    chains, tags, found = compile_selector(selector), _last_tags(selector), []
    for node in nodes:
        if (tags is not None and node.tag not in tags) or (root is not None and not _inside(node, root)):
            continue
        if any(_matches(node, chain) for chain in chains):
            found.append(node)
            if first:
                break
    return found


def _inside(node, root):
    if node.pos <= root.pos:
        return False
    up = node.parent
    while up is not None:
        if up is root:
            return True
        up = up.parent
    return False


def ends(nodes: list[Node]) -> list[int]:
    """For each element the position behind its last descendant, in one pass from the end."""
    out = [n.pos + 1 for n in nodes]
    for node in reversed(nodes):
        if node.parent is not None and 0 <= node.parent.pos < len(out):
            out[node.parent.pos] = max(out[node.parent.pos], out[node.pos])
    return out


def subtree(nodes: list[Node], root: Node, stops: list[int] | None = None) -> list[Node]:
    """Elements below ``root``: the run after it up to where it ends (``stops``: see ``ends``)."""
    return nodes[root.pos + 1:(ends(nodes) if stops is None else stops)[root.pos]]


def value(nodes: list[Node], selector: str | None, attribute: str) -> str | None:
    """Text or attribute of the first match, None where nothing matches."""
    hit = select(nodes, selector, first=True) if selector else []
    if not hit:
        return None
    return hit[0].text().strip() if attribute == "text" else hit[0].attrs.get(attribute)
