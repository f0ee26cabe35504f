"""A small document tree over the standard HTML parser, with the selectors that the extraction tables use.

Steps of a selector: a tag, classes, an identifier, attribute tests (present, equal, ending in, containing); joined by a
blank (inside), ``+`` (next to) or ``~`` (after, same parent).  Several selectors may be joined by commas.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_ITSELF = frozenset(("p", "li", "td", "th", "tr", "option"))
_UNSEEN = ("script", "style")


class Page:
    """All nodes of a page in document order, their texts, and the places of each tag, class, identifier and attribute.

    The nodes below one are a run of places and its texts a run of texts: a selector is sought once a page, only where its rarest
    test holds, and what it found below a node is a slice, as is a text.
    """

    __slots__ = ("index", "known", "matched", "nodes", "pieces")

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.pieces: list[str] = []
        self.index: dict[str, dict[str, list[int]]] = {kind: defaultdict(list) for kind in ("tag", "class", "id", "attr")}
        self.matched: dict[str, list[int]] = {}
        self.known: dict[int, bool] = {}  # what a caller found out about the node at a place

    def add(self, node: Node) -> None:
        at, index = len(self.nodes), self.index
        node.at, node.end = at, at + 1
        node.texts = node.texts_end = len(self.pieces)
        self.nodes.append(node)
        index["tag"][node.tag].append(at)
        for k in node.attrs:
            index["attr"][k].append(at)
            if k == "class":
                for c in node.classes if len(node.classes) < 2 else dict.fromkeys(node.classes):
                    index["class"][c].append(at)
            elif k == "id":
                index["id"][node.attrs[k]].append(at)

    def matching(self, selector: str) -> list[int]:
        """The places of all nodes that match, found once: a match does not depend on the node below which it is sought."""
        places = self.matched.get(selector)
        if places is None:
            paths = _compiled(selector)
            places = self._of_path(paths[0]) if len(paths) == 1 else sorted({at for path in paths for at in self._of_path(path)})
            self.matched[selector] = places
        return places

    def _of_path(self, path: list) -> list[int]:
        """Of the tests on a node the rarest tells where to look; a step that nothing passes ends the search."""
        places: list[int] | range = range(1, len(self.nodes))
        for k, (_, _, keys) in enumerate(path):
            for kind, name in keys:
                found = self.index[kind].get(name)
                if found is None:
                    return []
                if k == len(path) - 1 and len(found) < len(places):
                    places = found
        return [at for at in places if _matches(self.nodes[at], path, len(path) - 1)]

    def close(self) -> None:
        """Let each node know where what is below it ends."""
        for node in reversed(self.nodes):
            above = node.parent
            if above is not None:
                if above.end < node.end:
                    above.end = node.end
                if above.texts_end < node.texts_end:
                    above.texts_end = node.texts_end


class Node:
    __slots__ = ("at", "attrs", "children", "classes", "end", "page", "parent", "place", "tag", "texts", "texts_end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, page: Page) -> None:
        self.tag, self.attrs, self.parent, self.page, self.children = tag, attrs, parent, page, []
        self.place = len(parent.children) if parent is not None else 0
        self.classes = attrs["class"].split() if "class" in attrs else ()
        page.add(self)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def strings(self) -> Iterator[str]:
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in _UNSEEN:
                todo += reversed(x.children)

    def text(self, between: str = "") -> str:
        """The stripped pieces of text, joined."""
        if self.tag in _UNSEEN:
            return between.join(t for s in self.strings() if (t := s.strip()))
        return between.join(self.page.pieces[self.texts : self.texts_end])

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def select(self, selector: str) -> list[Node]:
        """The nodes below that match, in document order."""
        places = self.page.matching(selector)
        return [self.page.nodes[at] for at in places[bisect_right(places, self.at) : bisect_left(places, self.end)]] if places else []

    def first(self, selector: str) -> Node | None:
        places = self.page.matching(selector)
        if not places:
            return None
        k = bisect_right(places, self.at)
        return self.page.nodes[places[k]] if k < len(places) and places[k] < self.end else None

    def firsts(self, selectors: tuple[str, ...]) -> list[Node]:
        """The first match of each selector that has one, in the order of the selectors."""
        return [n for s in selectors if (n := self.first(s)) is not None]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.root = self.at = Node("", {}, None, self.page)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES_ITSELF and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.page)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at, self.page))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        at = self.at
        at.children.append(data)
        if at.tag not in _UNSEEN and (piece := data.strip()):  # the parser gives no nodes inside such ones
            self.page.pieces.append(piece)
            at.texts_end = len(self.page.pieces)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.page.close()
    return builder.root


_STEP = re.compile(r"""\s*([+~]?)\s*((?:[\w*-]+|\.[\w-]+|\#[\w-]+|\[[\w-]+(?:[*$]?=(?:'[^']*'|"[^"]*"|[^\]]*))?\])+)""")
_TEST = re.compile(r"""([\w*-]+)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:([*$]?)=['"]?([^'"\]]*)['"]?)?\]""")


@lru_cache(maxsize=512)
def _compiled(selector: str) -> list[list[tuple[str, Callable[[Node], bool], list[tuple[str, str]]]]]:
    steps = [[(m[1] or " ", [t.groups() for t in _TEST.finditer(m[2])]) for m in _STEP.finditer(path)] for path in re.split(r",(?![^\[]*\])", selector)]
    return [[(joint, _tests(tests), _keys(tests)) for joint, tests in path] for path in steps]


def _keys(tests: list[tuple]) -> list[tuple[str, str]]:
    """The entries of a page's index that hold every node which passes the tests."""
    keys = []
    for tag, cls, name, attr, _, _ in tests:
        kind = ("class", cls) if cls else ("id", name) if name else ("attr", attr) if attr else ("tag", tag)
        if kind != ("tag", "*"):
            keys.append(kind)
    return keys


def _test(tag: str | None, cls: str | None, name: str | None, attr: str | None, how: str | None, value: str | None) -> Callable[[Node], bool]:
    if cls:
        return lambda n: cls in n.classes
    if name:
        return lambda n: n.attrs.get("id", "") == name
    if not attr:
        return lambda n: tag in ("*", n.tag)
    if value is None:
        return lambda n: attr in n.attrs
    passes = {"": str.__eq__, "*": str.__contains__, "$": str.endswith}[how or ""]
    return lambda n: (own := n.attrs.get(attr)) is not None and passes(own, value)


def _tests(groups: list[tuple]) -> Callable[[Node], bool]:
    """Whether a node passes all tests of a step."""
    each = [_test(*g) for g in groups]
    return each[0] if len(each) == 1 else lambda n: all(t(n) for t in each)


def _matches(node: Node, path: list, i: int) -> bool:
    joint, passes, _ = path[i]
    if not passes(node):
        return False
    if i == 0:
        return True
    above = node.parent
    if joint == " ":
        while above is not None:
            if _matches(above, path, i - 1):
                return True
            above = above.parent
        return False
    if above is None:
        return False
    for k in range(node.place - 1, -1, -1):
        other = above.children[k]
        if isinstance(other, Node):
            if _matches(other, path, i - 1):
                return True
            if joint == "+":
                return False
    return False
