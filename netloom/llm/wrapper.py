"""Main-text extraction by wrapper induction.

A page is parsed into a tree. Its skeleton keeps block elements with a hash of their subtree; neighbouring paragraphs or
list items of one kind are one iterator, a set of items. A host's wrapper is a set of reference skeletons, and every page
is aligned with them by simple tree matching. What the alignment tells decides the text:

* a node equal in at least ``QUORUM`` of the references whose parent node is aligned is constant, hence template, and
  goes; paragraphs and lists need ``PASSAGE_VOTES`` such references, since some pages may quote the same passage;
* varying nodes are slots. From the root on, the slot that holds more text than its siblings together, on average over the
  page and the references, is followed down to the element that holds the paragraphs: the content. Slots beside it go.

Elements that are never main text (``DROPPED``) are left out of the skeleton. ``article`` and ``main`` raise a slot's
weight, and whole class, id or role words such as ``sidebar`` lower it: they break ties, and decide where no reference
tells anything. Pages whose largest run of paragraphs is the same are copies and don't judge each other.

References are one skeleton for each of ``SLOTS`` hash classes of contents, for the whole host and for each of its most
common layouts (sets of label paths), found by aggregates that keep one row for each class and task: a host with a third
of all pages needs no large group. They reach the pages as a broadcast of checked size, or beyond it by a salted join.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.urls import host_of
from netloom.plans.durable import durable

#: References of a host, and of each of its layouts, come from so many classes of pages.
SLOTS = 5
QUORUM = 0.75
PASSAGE_VOTES = 4
#: Layouts of a host with references of their own; pages of rarer ones are aligned with the host's.
LAYOUTS = 8
LAYOUT_DEPTH = 4
#: Bytes of all references up to which they are sent to every worker.
SENT_BYTES = 48 << 20
#: Beyond it: a host with more than this share of all pages is joined in so many parts.
HOT_SHARE, SALTS = 0.001, 64
#: Pairs of children that one alignment weighs exactly, after equal ends are paired off; what is longer is cut at equal blocks before.
CELLS = 40_000
#: Weights of a matched node, and of the equality of its subtree.
NODE, SAME = 4, 1
#: Factor of a slot's weight for an article or main element in it, and the inverse for a word that marks boilerplate.
HINT = 4.0
#: A slot beside the content is kept from this share of the largest one's weight on.
MINOR = 1 / 3
#: A block whose text is in links to at least this share is a menu.
LINK_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are no main text.
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas audio video dialog menu map title link meta base xmp noembed noframes".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
#: Prose elements that may hold the page's structure instead, and the children that tell so.
LOOSE = frozenset("li blockquote td th dd dt figcaption".split())
STRUCTURE = frozenset("div section article main table header".split())
#: Elements that belong to the text around them; content is never narrowed to one of them.
LISTS = frozenset("ul ol dl table tbody thead tfoot tr figure blockquote details".split())
CONTAINERS = frozenset(("article", "main"))
#: Whole class, id or role words that mark boilerplate, with - for _ and in lower case.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot ad-box ad-slot ad-banner banner-ad sponsor sponsored promo promotion nav navbar nav-bar navigation site-nav main-nav main-menu menu menubar breadcrumb breadcrumbs "
    "sidebar side-bar widget widgets related related-posts recommended footer site-footer page-footer masthead site-header topbar top-bar toolbar cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup login share sharing social social-share comment comments comment-list commentlist comments-area reply replies respond disqus disqus_thread "
    "search search-form pager pagination complementary contentinfo skip skip-link banner".split()
)
#: Which tags end an open element of the second kind.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
P_FENCES = ("button", "td", "th", "article", "section", "table")

_TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_DIGITS = re.compile(r"\d+")


class Node:
    """``drop`` is set on nodes that the text leaves out: 1 for template and minor slots, 2 for marked ones."""

    __slots__ = ("tag", "attributes", "children", "drop")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.drop = 0


class _Open:
    """The open elements, with the places of each tag among them, so that no step walks the stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def place(self, tags: tuple[str, ...]) -> int:
        """Of the innermost open element of these tags; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags: tuple[str, ...], fences: tuple[str, ...] = ()) -> None:
        at = self.place(tags)
        if at and at > self.place(fences):
            for node in reversed(self.stack[at:]):
                self.places[node.tag].pop()
            del self.stack[at:]


def parse(html: str) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers mostly do, text runs are kept as written."""
    root = Node("#root")
    open_ = _Open(root)
    at = 0
    size = len(html)
    while at < size:
        found = _TAG.search(html, at)
        if not found:
            open_.stack[-1].children.append(html[at:])
            break
        if found.start() > at:
            open_.stack[-1].children.append(html[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            open_.close((tag,))
            continue
        if tag in BLOCKS:
            open_.close(("p",), P_FENCES)
        if tag in ENDS:
            open_.close(ENDS[tag], FENCES.get(tag, ("table",)))
        if tag in ("html", "body") and open_.place((tag,)):
            continue
        if tag == "body":
            open_.close(("head",))
        node = Node(tag, found[3] or found[6] or "")
        open_.stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else size
            node.children.append(html[at:stop])
            close = html.find(">", stop) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        open_.push(node)
    return root


def _values(node: Node) -> dict[str, str]:
    found: dict[str, str] = {}
    if "=" in node.attributes:
        for m in _ATTRIBUTE.finditer(node.attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def is_marked(node: Node) -> bool:
    """Whether a whole word of class, id or role marks boilerplate; headings and containers are never marked by words."""
    if "=" not in node.attributes or node.tag in ("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
        return False
    return any(not MARKS.isdisjoint(v.lower().replace("_", "-").split()) for v in _values(node).values())


def _label(node: Node) -> str:
    """Tag and class; numbers in classes mostly name single pages and count as equal."""
    name = _values(node).get("class") if "=" in node.attributes else None
    return f"{node.tag}.{_DIGITS.sub('#', name)}" if name else node.tag


def clean(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((unescape(text) if "&" in text else text).split())


def _gather(node: Node, parts: list[str], dropped: int = 3) -> int:
    """Appends the text below ``node``, with a blank at each border of a block, and counts the characters in links.

    Left out are nodes whose ``drop`` is at least 1 and at most ``dropped``. Without recursion, for deep trees.
    """
    todo: list = [node]
    links = depth = 0
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            if depth:
                links += len(x)
        elif x is None:
            depth -= 1
        elif x is node or not (0 < x.drop <= dropped or x.tag in DROPPED):
            if x.tag == "a":
                depth += 1
                todo.append(None)
            elif x.tag not in INLINE:
                parts.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.children))
    return links


def plain(node: Node) -> str:
    """All text of a subtree as blocks joined by blanks."""
    parts: list[str] = []
    _gather(node, parts, 0)
    return clean(parts)


class Shape:
    """A skeleton node: label, hash of its subtree, characters of text and of text in links, block children, the hashes of
    an iterator's items (else None) and the tree nodes that it stands for; then what the alignments tell of it.
    """

    __slots__ = ("label", "hash", "size", "links", "own", "children", "items", "nodes", "count", "aligned", "equal", "mass", "votes")

    def __init__(self, label: str, hash_: int, size: int, links: int, children: list[Shape], items: list[int] | None, nodes: list[Node], own: int = 0):
        self.label, self.hash, self.size, self.links, self.children, self.items, self.nodes, self.own = label, hash_, size, links, children, items, nodes, own
        self.count = 1 + sum(c.count for c in children)
        self.aligned = self.equal = 0
        self.mass = 0.0
        self.votes: list[int] = [0] * len(items) if items else []

    def prose(self) -> int:
        return max(0, self.size - self.links)


def _crc(text: str, start: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), start)


def _chained(start: int, hashes: list[int]) -> int:
    for h in hashes:
        start = zlib.crc32(h.to_bytes(4, "big"), start)
    return start


def _is_leaf(node: Node) -> bool:
    return node.tag in PROSE and not (node.tag in LOOSE and any(isinstance(c, Node) and c.tag in STRUCTURE for c in node.children))


def _add(children: list[Shape], one: Shape) -> None:
    last = children[-1] if children else None
    if one.items and last and last.items and last.label == one.label:
        last.items += one.items
        last.nodes += one.nodes
        last.hash = _chained(last.hash, one.items)
        last.size, last.links = last.size + one.size, last.links + one.links
        last.votes += one.votes
    else:
        children.append(one)


def skeleton(root: Node) -> Shape:
    """Every text is read once; the hash of a node covers its label, its own inline text and its children's hashes."""
    frames: list[tuple[Node, Iterator, list[Shape], list[str], list[int]]] = [(root, iter(root.children), [], [], [0])]
    while True:
        node, rest, children, own, links = frames[-1]
        for x in rest:
            if isinstance(x, str):
                own.append(x)
            elif x.tag in DROPPED or x.tag in VOID:
                own.append(" ")
            elif x.tag in INLINE:
                links[0] += _gather(x, own)
            elif _is_leaf(x):
                parts: list[str] = []
                in_links = _gather(x, parts)
                text = clean(parts)
                h = _crc(text)
                label = _label(x)
                _add(children, Shape(label, _chained(_crc(label), [h]), len(text), in_links, [], [h], [x]))
            else:
                frames.append((x, iter(x.children), [], [], [0]))
                break
        else:
            frames.pop()
            text = clean(own) if own else ""
            label = _label(node)
            if not text and len(children) == 1 and children[0].items is None and children[0].label == label:
                # a box in a box of the same kind is one node
                children[0].nodes = [node]
                one = children[0]
                if not frames:
                    return one
                _add(frames[-1][2], one)
                continue
            total = _chained(_crc(text, _crc(label)), [c.hash for c in children])
            one = Shape(label, total, len(text) + sum(c.size for c in children), links[0] + sum(c.links for c in children), children, None, [node], max(0, len(text) - links[0]))
            if not frames:
                return one
            _add(frames[-1][2], one)


def every(shape: Shape) -> Iterator[Shape]:
    """All skeleton nodes, parents first, in the order of the page."""
    todo = [shape]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(reversed(x.children))


def content_of(shape: Shape) -> int:
    """The hash of the run of prose with the most text outside links: pages where it is the same are copies. 0 if there is none."""
    best, found = 0, 0
    for x in every(shape):
        if x.items and x.prose() > best:
            best, found = x.prose(), _chained(0, x.items)
    return found


def layout_of(shape: Shape) -> int:
    """A hash of the set of label paths of the blocks down to ``LAYOUT_DEPTH``."""
    paths, todo = set(), [(shape, "", 0)]
    while todo:
        x, path, depth = todo.pop()
        if x.items is None and depth <= LAYOUT_DEPTH:
            path = f"{path}/{x.label}"
            paths.add(path)
            todo.extend((c, path, depth + 1) for c in x.children)
    return _crc("\n".join(sorted(paths)))


# --- references ----------------------------------------------------------------------------------------------------------


def packed(shape: Shape, content: int | None = None) -> str:
    """A skeleton as text, one line for each node, parents first: number of children, hash, size, links, items, label; before them the content's hash."""
    lines = [str(content_of(shape) if content is None else content)]
    for x in every(shape):
        label = x.label.replace("\n", " ")
        lines.append(f"{len(x.children)} {x.hash} {x.size} {x.links} {','.join(map(str, x.items)) if x.items else '-'} {label}")
    return "\n".join(lines)


@lru_cache(maxsize=512)
def unpacked(text: str) -> tuple[int, Shape]:
    """(content hash, skeleton without tree nodes)."""
    content, *lines = text.split("\n")
    nodes: list[tuple[int, Shape]] = []
    for line in lines:
        n, h, size, links, items, label = line.split(" ", 5)
        nodes.append((int(n), Shape(label, int(h), int(size), int(links), [], None if items == "-" else [int(i) for i in items.split(",")], [])))
    ready: list[Shape] = []
    for n, one in reversed(nodes):
        for _ in range(n):
            one.children.append(ready.pop())
        one.count = 1 + sum(c.count for c in one.children)
        ready.append(one)
    return int(content), ready[0]


# --- alignment -----------------------------------------------------------------------------------------------------------


class Alignment:
    """Simple tree matching of a reference and a page: the heaviest mapping that keeps labels, parents and order.

    A matched node weighs NODE, and SAME more if its subtree is equal; an equal subtree has all its nodes matched. Two
    iterators are one matched node each; their items are compared as sets.
    """

    def __init__(self, ref: Shape, shape: Shape):
        self.chosen: dict[tuple[int, int], list[tuple[Shape, Shape]]] = {}
        self.known: dict[tuple[int, int], int] = {}
        deepest = sys.getrecursionlimit()
        try:
            sys.setrecursionlimit(max(deepest, 4 * min(_depth(ref), _depth(shape)) + 2000))
            self.weight = self._match(ref, shape)
        finally:
            sys.setrecursionlimit(deepest)
        self.root = (ref, shape)

    def _match(self, a: Shape, b: Shape) -> int:
        if a.label != b.label:
            return 0
        if a.hash == b.hash:
            return (NODE + SAME) * min(a.count, b.count)
        if not a.children or not b.children:
            return NODE
        key = (id(a), id(b))
        if key not in self.known:
            self.known[key] = NODE + self._lists(key, a.children, b.children)
        return self.known[key]

    def _lists(self, key: tuple[int, int], a: list[Shape], b: list[Shape]) -> int:
        pairs: list[tuple[Shape, Shape]] = []
        self.chosen[key] = pairs
        total = 0
        for x, y in _cut(a, b):
            if len(x) == len(y) == 1:
                w = self._match(x[0], y[0])
                if w:
                    pairs.append((x[0], y[0]))
                    total += w
            elif x and y:
                total += self._table(x, y, pairs)
        return total

    def _table(self, a: list[Shape], b: list[Shape], pairs: list[tuple[Shape, Shape]]) -> int:
        best = [[0] * (len(b) + 1)]
        for x in a:
            above, row = best[-1], [0]
            for j, y in enumerate(b):
                w = self._match(x, y) if x.label == y.label else 0
                row.append(max(row[j], above[j + 1], above[j] + w))
            best.append(row)
        i, j = len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((a[i], b[j]))
        return best[-1][-1]

    def pairs(self) -> Iterator[tuple[Shape, Shape, bool]]:
        """The matched nodes, with the nodes of equal subtrees one by one."""
        if not self.weight:
            return
        todo = [self.root]
        while todo:
            a, b = todo.pop()
            same = a.hash == b.hash
            yield a, b, same
            todo.extend(zip(a.children, b.children, strict=False) if same else self.chosen.get((id(a), id(b)), ()))


def _depth(shape: Shape) -> int:
    most, todo = 0, [(shape, 1)]
    while todo:
        x, n = todo.pop()
        most = max(most, n)
        todo.extend((c, n + 1) for c in x.children)
    return most


def _cut(a: list[Shape], b: list[Shape]) -> Iterator[tuple[list[Shape], list[Shape]]]:
    """Parts of two lists to be aligned each: equal ends one by one, then the middle.

    Pairing equal ends off loses no weight. A middle of more than CELLS pairs is cut at equal blocks that both have once,
    and parts that are still too long are paired by the k-th block of each label.
    """
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo].hash == b[lo].hash:
        yield [a[lo]], [b[lo]]
        lo += 1
    tail = 0
    while tail < most - lo and a[-1 - tail].hash == b[-1 - tail].hash:
        tail += 1
        yield [a[-tail]], [b[-tail]]
    a, b = a[lo : len(a) - tail], b[lo : len(b) - tail]
    if len(a) * len(b) <= CELLS:
        yield a, b
        return
    for (p, q), (r, s) in pairwise([(-1, -1), *_anchors(a, b), (len(a), len(b))]):
        if p >= 0:
            yield [a[p]], [b[q]]
        x, y = a[p + 1 : r], b[q + 1 : s]
        if len(x) * len(y) <= CELLS:
            yield x, y
        else:
            yield from _in_order(x, y)


def _anchors(a: list[Shape], b: list[Shape]) -> list[tuple[int, int]]:
    """The longest ascending row of blocks that each list has once."""
    in_a, in_b = Counter(x.hash for x in a), Counter(y.hash for y in b)
    place = {x.hash: i for i, x in enumerate(a) if in_a[x.hash] == 1}
    pairs = [(place[y.hash], j) for j, y in enumerate(b) if in_b[y.hash] == 1 and y.hash in place]
    tops: list[int] = []
    row: list[int] = []
    before: list[int] = []
    for n, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        before.append(row[at - 1] if at else -1)
        tops[at : at + 1] = [i]
        row[at : at + 1] = [n]
    out = []
    n = row[-1] if row else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _in_order(a: list[Shape], b: list[Shape]) -> Iterator[tuple[list[Shape], list[Shape]]]:
    places: dict[str, list[int]] = {}
    for k, x in enumerate(a):
        places.setdefault(x.label, []).append(k)
    used: Counter[str] = Counter()
    after = 0
    for y in b:
        row = places.get(y.label, ())
        k = max(used[y.label], bisect_left(row, after))
        used[y.label] = k + 1
        if k < len(row):
            yield [a[row[k]]], [y]
            after = row[k] + 1


# --- text ----------------------------------------------------------------------------------------------------------------


def _judge(shape: Shape, refs: list[Shape]) -> None:
    """Fills in what the alignments with the references tell, and marks template nodes and items."""
    for s in every(shape):
        s.mass = s.prose()
    for ref in refs:
        for a, b, same in Alignment(ref, shape).pairs():
            b.aligned += 1
            b.equal += same
            b.mass += a.prose()
            if b.items and a.items:
                known = set(a.items)
                for k, item in enumerate(b.items):
                    b.votes[k] += item in known
    todo = [(shape, shape.aligned)]
    while todo:
        s, judges = todo.pop()
        s.mass /= 1 + len(refs)
        least = max(QUORUM * judges, PASSAGE_VOTES if s.items or _tag(s) in LISTS else 1)
        for k, node in enumerate(s.nodes):
            if s.equal >= least or (s.items and s.votes[k] >= max(QUORUM * s.aligned, PASSAGE_VOTES)):
                node.drop = 1
            elif is_marked(node):
                node.drop = 2
        todo.extend((c, s.aligned) for c in s.children)


def _is_menu(s: Shape) -> bool:
    return s.size > 0 and s.links >= LINK_SHARE * s.size


def _tag(s: Shape) -> str:
    return s.label.split(".", 1)[0]


def _content(shape: Shape) -> list[Shape]:
    """The slots that hold the main text, in the order of the page; nodes left out of them are marked."""
    holds: set[int] = set()
    titled: set[int] = set()
    for s in reversed(list(every(shape))):
        inside = [c for c in s.children if c.nodes[0].drop != 2]
        if _tag(s) in CONTAINERS or any(id(c) in holds for c in inside):
            holds.add(id(s))
        if (_tag(s) == "h1" and not s.nodes[0].drop) or any(id(c) in titled for c in inside):
            titled.add(id(s))

    def weight(s: Shape) -> float:
        w = s.mass * (HINT if id(s) in holds else 1)
        return w / HINT if any(n.drop == 2 for n in s.nodes) or _tag(s) == "header" else w

    found: list[Shape] = []
    todo = [shape]
    while todo:
        s = todo.pop()
        slots = [c for c in s.children if c.size and any(n.drop != 1 for n in c.nodes)]
        holding = [c for c in slots if id(c) in holds and c.nodes[0].drop != 2]
        inner = _tag(s) == "main" and holding
        if (_tag(s) in CONTAINERS and not inner) or not slots:
            found.append(s)
            continue
        if len(holding) > 1:
            todo.extend(reversed(holding))
            continue
        top = max(slots, key=weight)
        rest = sum(weight(c) for c in slots) - weight(top) + s.own
        blocks = [c for c in slots if c.items is None and _tag(c) not in LISTS]
        if top in blocks and weight(top) > rest:
            # a title beside the content belongs to it
            todo.extend(c for c in reversed(slots) if c is top or (id(c) in titled and not c.nodes[0].drop and _tag(c) != "header"))
            continue
        for c in blocks:
            if c is not top and id(c) not in titled and weight(c) < MINOR * weight(top):
                c.nodes[0].drop = c.nodes[0].drop or 1
        for c in slots:
            if c is not top and _is_menu(c) and _tag(c) != "p":
                for n in c.nodes:
                    n.drop = n.drop or 1
        for c in slots:
            if _tag(c) == "header" and _tag(s) in ("body", "html", "#root"):
                c.nodes[0].drop = 1
        found.append(s)
    return found


def _spare_copies(found: list[Shape]) -> None:
    """Where over half of an article's prose counts as template, the references are near-copies of it: its prose stays."""
    for top in found:
        if _tag(top) in CONTAINERS:
            prose = [s for s in every(top) if s.items]
            sizes = [(s.size / len(s.nodes), n) for s in prose for n in s.nodes]
            if 2 * sum(size for size, n in sizes if n.drop == 1) > sum(size for size, _ in sizes):
                for s in every(top):
                    for n in s.nodes:
                        n.drop = 0 if n.drop == 1 and (s.items or s.children) else n.drop


def extract(html: str | None, refs: list[str] | None) -> str:
    """The main text of a page; empty for a null or empty page and where nothing but boilerplate is found.

    Without references, or with none but copies of the page, its own slots alone are weighed.
    """
    return _text(skeleton(parse(html)), refs) if html else ""


def _text(shape: Shape, refs: list[str] | None) -> str:
    own = content_of(shape)
    _judge(shape, [ref for content, ref in (unpacked(r) for r in dict.fromkeys(refs or ())) if not own or content != own])
    found = _content(shape)
    _spare_copies(found)
    parts: list[str] = []
    for top in found:
        for node in top.nodes:
            if node.drop != 1:
                _gather(node, parts)
                parts.append(" ")
    return clean(parts)


# --- tables --------------------------------------------------------------------------------------------------------------

_FOUND = T.StructType([T.StructField("layout", T.LongType()), T.StructField("content", T.LongType()), T.StructField("shape", T.StringType())])


def shape_of(html: str | None) -> str | None:
    return packed(skeleton(parse(html))) if html else None


def _described(html: str | None) -> dict | None:
    if not html:
        return None
    shape = skeleton(parse(html))
    content = content_of(shape)
    return {"layout": layout_of(shape), "content": content, "shape": packed(shape, content)}


@F.arrow_udf(_FOUND)
def _shapes(pages: pa.Array) -> pa.Array:
    return pa.array([_described(x.as_py()) for x in pages], pa.struct([("layout", pa.int64()), ("content", pa.int64()), ("shape", pa.string())]))


@F.arrow_udf(T.LongType())
def _layouts(pages: pa.Array) -> pa.Array:
    return pa.array([layout_of(skeleton(parse(x))) if (x := p.as_py()) else None for p in pages], pa.int64())


@F.arrow_udf(T.StringType())
def _texts(pages: pa.Array, refs: pa.Array) -> pa.Array:
    return pa.array([extract(x.as_py(), r.as_py()) for x, r in zip(pages, refs, strict=True)], pa.string())


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, layout, refs): at most ``SLOTS`` reference skeletons of each common layout of a host, and of the host (null layout).

    Pages with the same content fall into the same class, so copies of one page are one reference.
    """
    rows = pages.where(F.length(html_col) > 0).select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("h"), _shapes(F.col(html_col)).alias("s"))
    mixed = F.xxhash64("s.content")
    rows = rows.select("host", "s.layout", F.pmod(mixed, F.lit(SLOTS)).alias("slot"), F.struct(mixed.alias("c"), "h").alias("order"), "s.shape")
    one = durable(rows.groupBy("host", "layout", "slot").agg(F.min_by("shape", "order").alias("shape"), F.min("order").alias("order"), F.count("*").alias("n")))
    common = Window.partitionBy("host").orderBy(F.desc("pages"), "layout")
    sizes = one.groupBy("host", "layout").agg(F.sum("n").alias("pages")).withColumn("nth", F.row_number().over(common)).where(F.col("nth") <= LAYOUTS).select("host", "layout")
    own = one.join(sizes, ["host", "layout"], "left_semi").select("host", "layout", "shape")
    whole = one.groupBy("host", "slot").agg(F.min_by("shape", "order").alias("shape")).select("host", F.lit(None).cast("long").alias("layout"), "shape")
    return own.unionByName(whole).groupBy("host", "layout").agg(F.sort_array(F.collect_set("shape")).alias("refs"))


def _extracting(spark, refs: DataFrame):
    """A function (html, host) to texts, with all references sent to the workers; their size is checked by the caller."""
    table: dict[str, dict[int | None, list[str]]] = {}
    for r in refs.collect():
        table.setdefault(r["host"], {})[r["layout"]] = list(r["refs"])
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf(T.StringType())
    def texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, hosts in batches:
            out = []
            for page, host in zip(pages, hosts, strict=True):
                html, known = page.as_py(), sent.value.get(host.as_py(), {})
                if html:
                    shape = skeleton(parse(html))
                    out.append(_text(shape, [*known.get(layout_of(shape), ()), *known.get(None, ())]))
                else:
                    out.append("")
            yield pa.array(out, pa.string())

    return texts


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(id, url, text, n_chars) of every row.

    A null or empty page has an empty text. Pages without a host share the empty host. Repeated rows are extracted each;
    no rows give no rows. Text is never cut. Equal contents on a host, ties among slots: the first in page order counts.
    """
    refs = durable(wrappers(pages, url_col, html_col))
    size = refs.agg(F.sum(F.aggregate("refs", F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r)))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if size <= sent_bytes:
        out = rows.select("id", "url", _extracting(pages.sparkSession, refs)("html", "host").alias("text"))
    else:
        out = _joined(rows, refs)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def _joined(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """The same for any number of hosts: joins by host and layout, in which a hot host is dealt over SALTS parts."""
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = rows.count()
    # hosts with more than HOT_SHARE of all rows: at most 1 / HOT_SHARE of them
    hot = F.broadcast(durable(counts.where(F.col("n") > HOT_SHARE * total).select(F.col("host").alias("hot"))))
    marked = rows.withColumn("layout", _layouts("html")).join(hot, F.col("host") == F.col("hot"), "left")
    dealt = marked.withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)))).drop("hot")
    copies = F.when(F.col("hot").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    spread = refs.join(hot, F.col("host") == F.col("hot"), "left").select(F.col("host").alias("h"), F.col("layout").alias("l"), "refs", F.explode(copies).alias("part"))
    own, whole = spread.where("l is not null").withColumnRenamed("refs", "own"), spread.where("l is null").drop("l").withColumnRenamed("refs", "whole")
    out = dealt.join(own, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("part")) & (F.col("layout") == F.col("l")), "left").drop("h", "l", "part")
    out = out.join(whole, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("part")), "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select("id", "url", _texts("html", F.concat(F.coalesce("own", none), F.coalesce("whole", none))).alias("text"))
