"""Main text of web pages by a tree-structured graphical model.

Each block element of a page, and each other element with a class, id or role, is a node that is content or not. Its
tag, the words of its names and its own text give a node potential; how often children of content are content gives a
potential for each edge. Messages go up from the leaves to the root and down again, which on a tree
makes the marginals exact; text in nodes whose marginal for content is a half or more is the main text. All
potentials come from labelled pages; a word that none of them has speaks neither for nor against.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from reelshelf.llm.labelled_pages import PAGES
from reelshelf.llm.runtime import python_ready

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_LABEL = re.compile(r"(?:^|\s)(keep|drop)(?=\s|$)")
_WORD = re.compile(r"[^\W\d_a-z]?[^\W\d_A-Z]+|[^\W\d_a-z]+")

#: Elements without text of the page, void ones, and those that don't break a line.
_UNSEEN = set("script style noscript template svg iframe object title select textarea canvas audio video annotation annotation-xml".split())
#: Those of them whose inside isn't markup, those that no block can be in, and elements that leave the head open.
_RAW = set("script style title textarea iframe".split())
_NO_BLOCKS = set("title textarea select svg".split())
_IN_HEAD = set("head title base basefont bgsound link meta style script noscript noframes template".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_MATH = set(
    """math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub
    msubsup msup mtable mtd mtext mtr munder munderover semantics""".split()
)
_INLINE = _MATH | set(
    "annotation annotation-xml a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
) | {"img", "input"}
#: A paragraph ends where one of these begins.
_ENDS_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An element ends where one of its like begins, if none of the second set is between.
_ENDS_LIKE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set()}
_LIKES = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements whose meaning depends on what they lie in: an article's header is text, a site's isn't.
_BY_PARENT = {"header", "footer", "aside", "nav", "section"}


def _named(attributes: str) -> list[str]:
    """Features of class, id, role and label: of each name the word that it ends with and its first letters, and the words before it."""
    found: dict[str, None] = {}
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORD.findall(name)]
            for word in words[:-1]:
                found[f"before:{word}"] = None
            if words:
                found[f"name:{words[-1]}"] = None
                if len(words[-1]) > 5:
                    found[f"like:{words[-1][:5]}"] = None
    return list(found)


class Page:
    """The tree of a page: parents (a parent comes before its children), tags, features and labels of nodes, and blocks of text by node."""

    def __init__(self, source: str):
        self.parent, self.tag, self.features, self.label = [-1], ["root"], [[]], [0]
        self.chars, self.linked = [0], [0]
        #: Pieces of one block follow each other without a space.
        self.blocks: list[list[tuple[int, str]]] = []
        self._read(source)
        for node, named in enumerate(self.features):
            named += self._of_text(node)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("root", 0, False)]  # tag, node, whether its begin and end break the text
        opened: Counter = Counter()  # of the stack's tags
        buffer: list[tuple[int, str]] = []
        links, at, node = 0, 0, 0
        hidden, ends_at_block, in_head = 0, False, False  # depth of the unseen element that is open, 0 none
        last_end: dict[str, int] = {}

        def closes(tag: str) -> bool:
            """Whether an end tag of the name is still to come, and of elements that no block can be in, before they begin again."""
            if tag not in last_end:
                last_end[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\s*>", source, re.I)), default=-1)
            if last_end[tag] < at or tag not in _NO_BLOCKS:
                return last_end[tag] >= at
            return bool(re.compile(rf"<(/?){tag}[\s/>]", re.I).search(source, at)[1])

        def flush() -> None:
            if buffer:
                self.blocks.append(buffer.copy())
                buffer.clear()

        def add(text: str) -> None:
            if hidden:
                return
            buffer.append((node, text))
            size = len(text.strip())
            self.chars[node] += size
            if links:
                self.linked[node] += size

        def enter(tag: str, breaks: bool) -> None:
            stack.append((tag, node, breaks))
            opened[tag] += 1

        def leave(depth: int) -> None:
            nonlocal node, links, hidden
            while len(stack) > depth:
                tag, _, breaks = stack[-1]
                if breaks:
                    flush()
                stack.pop()
                opened[tag] -= 1
                node = stack[-1][1]
                if hidden < len(stack):
                    links -= tag == "a" and not hidden
                else:
                    hidden = 0

        n = len(source)
        while at < n:
            found = _TAG.search(source, at)
            if not found:
                add(source[at:])
                break
            if found.start() > at:
                add(source[at : found.start()])
            at = found.end()
            closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                in_head = in_head and tag != "head"
                if tag == "head" and hidden:
                    leave(hidden)
                if not opened[tag]:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        leave(depth)
                        break
                continue
            if hidden and (tag == "body" or ends_at_block and tag in _ENDS_P and not opened["foreignobject"]):
                leave(hidden)
            if hidden:
                if tag not in _VOID and not attributes.endswith("/"):
                    enter(tag, False)
                continue
            if tag == "head":
                flush()
                in_head = True
                continue
            ends_at_block = in_head or tag in _NO_BLOCKS
            in_head = in_head and tag in _IN_HEAD
            if tag in _UNSEEN:
                if tag not in _INLINE:
                    flush()
                if attributes.endswith("/"):
                    continue
                closed = closes(tag)
                if closed and tag in _RAW:
                    at = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at).end()
                    continue
                ends_at_block = ends_at_block and not closed
                hidden = len(stack)
                enter(tag, False)
                continue
            if tag in _VOID:
                if tag in ("br", "hr"):
                    flush()
                continue
            if tag in _ENDS_P and opened["p"]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        leave(depth)
                        break
                    if stack[depth][0] not in _INLINE:
                        break
            elif tag in _ENDS_LIKE and any(opened[x] for x in _LIKES.get(tag, (tag,))):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in _LIKES.get(tag, (tag,)):
                        leave(depth)
                        break
                    if stack[depth][0] in _ENDS_LIKE[tag]:
                        break
            named = _named(attributes) if attributes else []
            label = _LABEL.search(attributes) if attributes else None
            breaks = tag not in _INLINE
            links += tag == "a"
            if breaks:
                flush()
            if breaks or named or label:
                self.parent.append(node)
                self.tag.append(tag)
                self.features.append([f"tag:{tag}", *named])
                self.label.append(self.label[node] if not label else int(label[1] == "keep"))
                self.chars.append(0)
                self.linked.append(0)
                node = len(self.parent) - 1
            enter(tag, breaks)
        leave(1)
        flush()

    def _of_text(self, node: int) -> list[str]:
        chars = self.chars[node]
        if not chars:
            return ["text:none"]
        share = self.linked[node] / chars
        size = "short" if chars < 30 else "line" if chars < 90 else "long"
        return [f"text:{size}", f"links:{'none' if share == 0 else 'some' if share < 0.5 else 'most'}"]

    def wrapper(self, node: int, known: set[str]) -> bool:
        """Whether a node only groups parts that can be of different kinds, as the page itself does: it has no text and no name that is known."""
        tag = self.tag[node]
        return tag in _WRAPPERS or tag in _GROUPS and not self.chars[node] and known.isdisjoint(self.features[node][1:])


_WRAPPERS = {"root", "html", "body"}
_GROUPS = {"div", "section", "table", "tbody", "tr", "td", "center"}


class Model:
    """Potentials from labelled pages: edges by counts, nodes by raising the likelihood of the labels step by step."""

    def __init__(self, pages: list[str] = PAGES, rounds: int = 200, rate: float = 0.3, fade: float = 0.0005):
        read = [Page(p) for p in pages]
        self.known = {f for page in read for named in page.features for f in named if f.startswith(("name:", "like:", "before:"))}
        edges: Counter = Counter()
        for page in read:
            for node in range(1, len(page.parent)):
                up = page.parent[node]
                edges[self._kind(page, node), page.label[up], page.label[node]] += 1
        few = 0.1  # added to each count
        #: P(child's label | parent's label), by whether the parent is a wrapper and what the child is
        self.edge = {
            kind: [[(edges[kind, up, down] + few) / (edges[kind, up, 0] + edges[kind, up, 1] + 2 * few) for down in (0, 1)] for up in (0, 1)]
            for kind in [(wrapper, tag) for wrapper in (False, True) for tag in ("", *sorted(_BY_PARENT))]
        }
        self.weight: dict[str, float] = {}
        for _ in range(rounds):
            # the slope of the likelihood: labels less marginals, summed by feature
            for page in read:
                for node, odds in enumerate(self.marginals(page)):
                    if not page.wrapper(node, self.known):
                        slope = page.label[node] - 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
                        for f in page.features[node]:
                            before = self.weight.get(f, 0.0)
                            self.weight[f] = before + rate * (slope - fade * before)

    def _kind(self, page: Page, node: int) -> tuple[bool, str]:
        """What the edge from its parent to a node is."""
        tag = page.tag[node]
        return page.wrapper(page.parent[node], self.known), tag if tag in _BY_PARENT else ""

    def marginals(self, page: Page) -> list[float]:
        """Of each node the log odds that it is content, by one pass of messages up and one down."""
        weight, parent = self.weight, page.parent
        n = len(parent)
        edge = [self.edge[self._kind(page, i)] if i else None for i in range(n)]
        belief = [0.0 if page.wrapper(i, self.known) else sum(weight.get(f, 0.0) for f in page.features[i]) for i in range(n)]
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            (p00, p01), (p10, p11) = edge[i]
            odds = math.exp(min(50.0, max(-50.0, belief[i])))
            sent[i] = math.log((odds * p11 + p10) / (odds * p01 + p00))
            belief[parent[i]] += sent[i]
        for i in range(1, n):
            (p00, p01), (p10, p11) = edge[i]
            odds = math.exp(min(50.0, max(-50.0, belief[parent[i]] - sent[i])))
            belief[i] += math.log((odds * p11 + p01) / (odds * p10 + p00))
        return belief

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        belief = self.marginals(page)
        found = (" ".join(html.unescape("".join([text for node, text in block if belief[node] >= 0])).split()) for block in page.blocks)
        return " ".join(text for text in found if text)


def extract_texts(pages: DataFrame) -> DataFrame:
    """Per row page_id, url, text, n_chars: the main text of html.

    A null or empty html, and a page without main text, give the empty text. White space within a block is
    one space, blocks follow each other in page order with a space between, character references are decoded. Markup
    that isn't closed ends with the page, an unseen element that isn't closed with its parent, or where a block begins that can't be in it. Repeated rows give equal rows, an empty table none; other columns are not read.
    """
    python_ready(pages.sparkSession)

    def texts(batches):
        model = Model()
        for batch in batches:
            found = [model.text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
