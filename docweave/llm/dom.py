"""A small tolerant HTML tree: block elements and the text blocks they hold."""

from __future__ import annotations

import html
import re

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)[^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+|[0-9]+")

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
HIDDEN = frozenset("head script style textarea title noscript iframe object svg math select button option template audio video canvas xmp noembed noframes datalist".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption tbody thead tfoot tr td th ul".split())
CLOSES_P = BLOCK - frozenset("html body li dd dt tbody thead tfoot tr td th caption summary figcaption".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table html body article section div td th form aside main nav header footer blockquote menu".split())


class Node:
    __slots__ = ("tag", "parent", "tokens", "children", "blocks", "depth", "label", "link", "first")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset, label: str):
        self.tag, self.parent, self.tokens, self.label = tag, parent, tokens, label
        self.children: list[Node] = []
        self.blocks: list[int] = []
        self.depth = parent.depth + 1 if parent else 0


class Page:
    """Block elements in page order (nodes) and text blocks: text, links' characters, links."""

    def __init__(self, source: str):
        self.root = Node("html", None, frozenset(), "")
        self.nodes = [self.root]
        self.blocks: list[tuple[str, int, int, Node]] = []
        self.text: list[tuple[str, bool]] = []
        self.links = 0
        # open elements: tag, block node it lies in (its own, if a block), hidden, inside a link
        self.open: list[tuple[str, Node, bool, bool]] = [("#root", self.root, False, False)]
        at = 0
        while m := TAG.search(source, at):
            self.add(source[at : m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            name = name.lower()
            if m.group(1) or m.group(4):
                self.end(name)
            else:
                self.start(name, m.group(3) or "")
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    at = close.start() if close else len(source)
        self.add(source[at:])
        self.flush()

    def add(self, raw: str) -> None:
        _, _, hidden, link = self.open[-1]
        if raw and not hidden:
            self.text.append((html.unescape(raw) if "&" in raw else raw, link))

    def flush(self) -> None:
        """Ends the text block under way."""
        if self.text:
            s = " ".join("".join(t for t, _ in self.text).split())
            if s:
                node = self.open[-1][1]
                node.blocks.append(len(self.blocks))
                self.blocks.append((s, sum(len(t) for t, link in self.text if link), self.links, node))
        self.text, self.links = [], 0

    def start(self, name: str, attrs: str) -> None:
        if name == "br":
            self.text.append((" ", False))
            return
        if name in VOID and name != "hr":
            return
        if name in CLOSES_P:
            self.close_until("p", SCOPE)
        if name in SIBLINGS:
            for tag in SIBLINGS[name]:
                self.close_until(tag, SCOPE)
        if name in ("html", "body") and any(o[0] == name for o in self.open):
            return
        _, node, hidden, link = self.open[-1]
        hidden = hidden or name in HIDDEN
        if name in BLOCK:
            self.flush()
            if name == "hr":
                return
            tokens, label = frozenset(), ""
            if attrs:
                words = []
                for key, a, b, c in ATTR.findall(attrs):
                    if key == "data-y":
                        label = a or b or c
                    else:
                        words += PART.findall((a or b or c).lower())
                tokens = frozenset(words)
            if not hidden and name not in ("html",):
                child = Node(name, node, tokens, label)
                node.children.append(child)
                self.nodes.append(child)
                node = child
        elif name == "a":
            link = True
            self.links += 1
        self.open.append((name, node, hidden, link))

    def close_until(self, tag: str, stop: frozenset) -> None:
        """Closes the innermost open `tag`, unless an element of `stop` stands between."""
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == tag:
                self.flush()
                del self.open[i:]
                return
            if name in stop:
                return

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == name:
                if any(o[0] in BLOCK for o in self.open[i:]):
                    self.flush()
                del self.open[i:]
                return
            if name not in BLOCK and self.open[i][0] in BLOCK:
                return
