"""Operator 3: main text of web pages by wrapper induction.

Pages of one host share a template.  Up to ``LENDERS`` different pages of a host lend
their trees, which are aligned and merged into one, so a block that some of them
lack, or an odd page among them, does no harm.  Every page of the host is aligned
with the merged tree by simple tree matching, and for each of its nodes Spark counts
the pages that have it and those with the text most lenders have there.  A node that
at least ``SPREAD`` of the host's pages have, nearly all of them with the same text, is
template; the slots that vary are content.  What a page itself marks as furniture
(navigation, header, footer, side column, notice, advert, form, comments, by tag, role,
class or id) is left out even where it varies, and so are lists of entries that readers
signed (see ``_signed``).  Template is left out everywhere, also inside an
article or main part.  What such a mark says is evidence for the choice among the
slots that vary: if the marked ones hold at least ``MARKED`` of their text, the
page is read from there, else (an article that is only a teaser) from all slots.

Every element is a node, texts are hashes.  The matching is the largest one that keeps
order and depth, over all pairs of siblings; of the largest, one with most equal
siblings.  Sizes are kept by pairs of shapes, and a row of siblings is compared with all
others at once, so a page of n like siblings takes n steps over arrays and memory for
about two square roots of n of them.

Cases
* null or empty html, and pages without text, give the empty string;
* a null url is a host of its own; unclosed and stray tags never fail;
* hosts of fewer than ``LEAST_PAGES`` different pages have no template of their own;
  there the marks alone decide;
* elements nested deeper than ``DEEPEST`` levels become siblings at that level, their
  text stays;
* equal pages of a host count once, so that copies do not make their content template;
* a line in which some text varies stays whole, with the constant text around it;
* very long pages are aligned whole; edited copies of one page that make up less than
  ``SPREAD`` of a host do not make their content template;
* repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.staging import stage

#: Pages of a host from which on equal text means template, and the share of them.
LEAST_PAGES, CONSTANT = 5, 0.9
#: Share of a host's pages that must have a node before it can be template.
SPREAD = 0.4
#: Share of a page's varying text from which its marked article or main parts stand for all of it.
MARKED = 0.5
#: Bytes of host trees or templates up to which a join broadcasts them.
BROADCAST_BYTES = 16_000_000
SALTS = 16
#: Groups of equal pages up to which the join broadcasts them (about 100 bytes each).
BROADCAST_COPIES = 100_000
#: Different pages of a host whose trees are merged.
LENDERS = 8
#: Numbers that an alignment holds at once (rows of a matching, weights by shape), and sizes that it remembers.
HELD, REMEMBERED = 4_000_000, 500_000
#: Levels of a tree.
DEEPEST = 200

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
SKIPPED = RAW | frozenset("head nav footer aside form button select dialog menu header audio video canvas object".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th", {"table"}),
    "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}),
    "option": ("option", {"select"}),
}
#: Words of a class, id or role that mark furniture.
FURNITURE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr header masthead menu nav navbar navigation newsletter notice pagination popup promo promotion related reply respond share sharing sidebar side-bar signup social sponsor sponsored subscribe toolbar widget complementary search".split()
)
#: Words that may stand beside one of these; any other word makes the name one of content.
NEUTRAL = frozenset(
    "area articles bar block blog body bottom box btn button buttons card col column container content desktop fixed float form global group icon icons inline inner item items js left link links list local main mobile module news outer overlay page panel post posts primary right row secondary section site slot stories sticky the thread top ui unit user wrap wrapper".split()
)
#: Words that make an article one that readers or advertisers wrote, or a pointer elsewhere.
FOREIGN = frozenset("comment comments reply respond disqus related advert advertisement adverts ad ads promo promotion sponsor sponsored".split())
#: Words that say so whatever stands beside them.
READERS = frozenset("comments disqus".split())
#: Words that name readers' comments if entries with names stand below, else a part of the text.
PERHAPS = frozenset("comment discussion discussions response responses reply replies feedback reader readers thread threads reactions".split())
#: Words of a class that mark the name, or the date, of who wrote an entry.
AUTHOR = frozenset("author user username name nick nickname commenter poster byline by avatar".split())
DATED = frozenset("date time timestamp ago when posted datetime".split())
MAIN = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAMED = re.compile(r"\s*[^\W\d_][\w.'-]*(?: [\w.'-]+){0,3}\s*(?::|(?:says|said|wrote|writes)\b)")
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


class Node:
    """An element: its label, whether it is furniture, a main part or perhaps comments, whom it names, its children and texts."""

    __slots__ = ("tag", "label", "skip", "main", "perhaps", "names", "dates", "kids")

    def __init__(self, tag: str, label: str, skip: bool, main: bool, words: set[str] = frozenset()):
        self.tag, self.label, self.skip, self.main = tag, label, skip, main
        self.perhaps, self.names, self.dates = False, False, tag == "time"
        if words:
            self.perhaps, self.names, self.dates = not words.isdisjoint(PERHAPS), not words.isdisjoint(AUTHOR), self.dates or not words.isdisjoint(DATED)
        self.kids: list[Node | str] = []


def _furniture(mark: str) -> list[str]:
    """Furniture words of a class, id or role, if the rest of its name says nothing else."""
    if mark in FURNITURE:
        return [mark]
    words = [w for w in re.split(r"[-_\d]+", mark) if w]
    own = [w for w in words if w in FURNITURE]
    return own if all(w in FURNITURE or w in NEUTRAL or len(w) == 1 for w in words) else []


def _element(tag: str, attributes: str) -> Node:
    if not attributes:
        return Node(tag, tag, tag in SKIPPED, tag in MAIN)
    marks: list[str] = []
    for _, a, b, c in _MARKS.findall(attributes):
        marks += (a or b or c).lower().split()
    said = {word for mark in marks for word in _furniture(mark)}
    words = {word for mark in marks for word in re.split(r"[-_\d]+", mark)} if marks else frozenset()
    said |= words & READERS
    main = tag in MAIN or "main" in marks
    named = not said.isdisjoint(FOREIGN) if main else bool(said)
    skip = tag in SKIPPED or (tag not in ("html", "body", "main") and named) or bool(_HIDDEN.search(attributes))
    return Node(tag, ".".join([tag, *marks[:2]]), skip, main, words)


def _signed(entry: Node, strict: bool) -> bool:
    """Whether an element is an entry of a reader: it names an author and a date in elements of their own.

    Unless ``strict``, one of the two is enough, or a text that begins with a name and a colon.
    """
    named = dated = False
    first = ""
    pending = [entry]
    while pending:
        node = pending.pop()
        named, dated = named or node.names, dated or node.dates
        for kid in reversed(node.kids):
            if isinstance(kid, Node):
                pending.append(kid)
        first = first or next((k for k in node.kids if isinstance(k, str) and k.strip()), "")
    return (named and dated) if strict else (named or dated or _NAMED.match(first) is not None)


def _has_main_text(root: Node) -> bool:
    """Whether a main part holds text outside headings and furniture."""
    pending = [(root, False)]
    while pending:
        node, main = pending.pop()
        if node.skip or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        main = main or node.main
        if main and any(isinstance(k, str) and not k.isspace() for k in node.kids):
            return True
        pending += [(k, main) for k in node.kids if isinstance(k, Node)]
    return False


def _leave_out_comments(root: Node) -> None:
    """Mark lists of readers' entries as furniture: by a word that may mean so and signed entries, or by two or more strictly signed ones.

    The latter only where a main part keeps text beside them, so a forum's thread stays.
    """
    strict: list[Node] = []
    pending = [root]
    while pending:
        node = pending.pop()
        below = [k for k in node.kids if isinstance(k, Node) and not k.skip]
        if node.perhaps and node.tag not in ("html", "body", "main"):
            entries = [k for k in below if k.tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "br", "hr")]
            while len(entries) == 1 and entries[0].tag in ("ul", "ol", "div", "section"):
                inner = [k for k in entries[0].kids if isinstance(k, Node) and not k.skip]
                if not inner:
                    break
                entries = inner
            if entries and all(_signed(k, False) for k in entries):
                node.skip = True
                continue
        alike = Counter(k.label for k in below if not k.main and k.tag not in ("p", "body"))
        for label in [x for x, n in alike.items() if n > 1]:
            entries = [k for k in below if k.label == label]
            if all(_signed(k, True) for k in entries):
                for k in entries:
                    k.skip = True
                strict += entries
        pending += [k for k in below if not k.skip]
    if strict and not _has_main_text(root):
        for k in strict:
            k.skip = False


def parse(source: str) -> Node:
    """A forgiving tree of ``source``; unclosed elements end with their parents."""
    root = Node("", "", False, False)
    stack = [root]
    at = 0
    told = False  # whether an element may hold comments or names who wrote something
    while True:
        found = _TOKEN.search(source, at)
        if found is None:
            break
        if found.start() > at:
            stack[-1].kids.append(source[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in BLOCKS and tag != "br":
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ends.split():
                    del stack[depth:]
                    break
                if stack[depth].tag in stops:
                    break
        node = _element(tag, found[3])
        told = told or node.perhaps or node.names
        stack[min(len(stack), DEEPEST) - 1].kids.append(node)
        if tag in RAW and not found[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            node.kids.append(source[at : close.start() if close else len(source)])
            at = close.end() if close else len(source)
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
    if at < len(source):
        stack[-1].kids.append(source[at:])
    if told:
        _leave_out_comments(root)
    return root


class Slot:
    """A node to align: label, hash of its own text, children; number of nodes, and hashes of its labels and of all it holds."""

    __slots__ = ("label", "text", "kids", "node", "votes", "count", "shape", "whole")

    def __init__(self, label: str, text: int, kids: list[Slot], node: Node | None = None):
        self.label, self.text, self.kids, self.node = label, text, kids, node
        self.votes: Counter | None = None
        self.settle()

    def settle(self) -> None:
        if not self.kids:
            self.count, self.shape, self.whole = 1, hash((self.label,)), hash((self.label, self.text))
            return
        self.count = 1 + sum(k.count for k in self.kids)
        self.shape = hash((self.label, *[k.shape for k in self.kids]))
        self.whole = hash((self.label, self.text, *[k.whole for k in self.kids]))


def skeleton(node: Node) -> Slot:
    """The tree below ``node`` with hashes for texts."""
    texts, kids = [], []
    for k in node.kids:
        if isinstance(k, str):
            texts.append(k)
        else:
            kids.append(skeleton(k))
    text = " ".join(" ".join(texts).split()) if texts else ""
    return Slot(node.label, crc32(text.encode()) if text else 0, kids, node)


def nested(tree: Slot) -> list:
    return [tree.label, tree.text, [nested(k) for k in tree.kids]]


def slots(tree: list) -> Slot:
    return Slot(tree[0], tree[1], [slots(k) for k in tree[2]])


def _next(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Heaviest matchings with one more sibling, by the number of siblings on the other side."""
    out = np.empty(len(row), dtype=np.int64)
    out[0] = 0
    np.maximum(row[1:], row[:-1] + weights, out=out[1:])
    return np.maximum.accumulate(out, out=out)


def _path(n: int, m: int, weights) -> list[tuple[int, int]]:
    """Pairs of the heaviest matching that keeps order, last first; rows between kept ones are computed again on the way back."""
    step = n if n * m <= HELD else isqrt(n) + 1
    blocks = (n - 1) // step
    row = np.zeros(m + 1, dtype=np.int64)
    kept = [row]
    for i in range(blocks * step):
        row = _next(row, weights(i))
        if (i + 1) % step == 0:
            kept.append(row)
    out, j = [], m
    for block in range(blocks, -1, -1):
        first = block * step
        rows = [kept[block]]
        for i in range(first, min(first + step, n)):
            rows.append(_next(rows[-1], weights(i)))
        for i in range(len(rows) - 1, 0, -1):
            if rows[i][j] != rows[i - 1][j]:
                j = int(np.searchsorted(rows[i], rows[i][j]))  # the first column with this value ends in a pair
                j -= 1
                out.append((first + i - 1, j))
    return out


class Matcher:
    """Simple tree matching that remembers the sizes of matches by pairs of shapes."""

    def __init__(self) -> None:
        self.sizes: dict[tuple[int, int], int] = {}

    def size(self, a: Slot, b: Slot) -> int:
        """Nodes of the largest match of two trees that keeps order and depth."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.count
        found = self.sizes.get((a.shape, b.shape))
        if found is None:
            start, rows, columns = _trimmed(a.kids, b.kids, "shape")
            ends = sum(k.count for k in a.kids) - sum(k.count for k in rows)
            row = np.zeros(len(columns) + 1, dtype=np.int64)
            weights = self._weights(rows, columns, False)
            for i in range(len(rows) if columns else 0):
                row = _next(row, weights(i))
            if len(self.sizes) > REMEMBERED:
                self.sizes.clear()
            found = self.sizes[a.shape, b.shape] = 1 + ends + int(row[-1])
        return found

    def _weights(self, rows: list[Slot], columns: list[Slot], ties: bool):
        """Function from a row's number to its weights: sizes of matches, and with ``ties`` one more for an equal sibling."""
        scale = 1 + min(len(rows), len(columns)) if ties else 1
        kinds: dict[int, int] = {}
        kind = np.array([kinds.setdefault(y.shape, len(kinds)) for y in columns], dtype=np.int64)
        of_kind = {y.shape: y for y in columns}
        equal: dict[int, list[int]] = {}
        if ties:
            for j, y in enumerate(columns):
                equal.setdefault(y.whole, []).append(j)
        known: dict[int, np.ndarray] = {}

        def weights(i: int) -> np.ndarray:
            x = rows[i]
            out = known.get(x.shape)
            if out is None:
                if len(known) * len(columns) > HELD:
                    known.clear()
                by_kind = np.array([self.size(x, of_kind[shape]) for shape in kinds], dtype=np.int64)
                out = known[x.shape] = scale * by_kind[kind]
            if x.whole in equal:
                out = out.copy()
                for j in equal[x.whole]:
                    out[j] += 1
            return out

        return weights

    def matched(self, a: list[Slot], b: list[Slot]) -> list[tuple[Slot, Slot]]:
        """Pairs of siblings of the largest match; of the largest, one with most equal siblings."""
        start, rows, columns = _trimmed(a, b, "whole")
        ends = list(zip(a[:start], b[:start])) + list(zip(a[start + len(rows) :], b[start + len(columns) :]))
        if len(rows) == len(columns) and all(x.shape == y.shape for x, y in zip(rows, columns)):
            return ends + list(zip(rows, columns))
        if not rows or not columns:
            return ends
        return ends + [(rows[i], columns[j]) for i, j in _path(len(rows), len(columns), self._weights(rows, columns, True))]

    def pairs(self, a: Slot, b: Slot) -> list[tuple[Slot, Slot]]:
        """All pairs of nodes of the match of two trees."""
        out, pending = [], [(a, b)] if a.label == b.label else []
        while pending:
            pair = pending.pop()
            out.append(pair)
            if pair[0].kids and pair[1].kids:
                pending += self.matched(pair[0].kids, pair[1].kids)
        return out


def _trimmed(a: list[Slot], b: list[Slot], key: str) -> tuple[int, list[Slot], list[Slot]]:
    """Length of the common start, and what is left without common start and end; a heaviest match pairs these ends."""
    start = 0
    while start < min(len(a), len(b)) and getattr(a[start], key) == getattr(b[start], key):
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and getattr(a[-1 - end], key) == getattr(b[-1 - end], key):
        end += 1
    return start, a[start : len(a) - end], b[start : len(b) - end]


def merged(trees: list[Slot]) -> Slot:
    """One tree with the nodes of all ``trees``; each has the text most of them have there."""

    def counted(node: Slot) -> Slot:
        out = Slot(node.label, node.text, [counted(k) for k in node.kids])
        out.votes = Counter((node.text,))
        return out

    def settled(node: Slot) -> Slot:
        for kid in node.kids:
            settled(kid)
        node.text = min(node.votes, key=lambda h: (-node.votes[h], h))
        node.settle()
        return node

    matcher = Matcher()
    out = counted(trees[0])
    for tree in trees[1:]:
        pairs = matcher.pairs(out, tree)
        place = {id(own): known for known, own in pairs}
        for known, own in pairs:
            known.votes[own.text] += 1
            number = {id(k): i for i, k in enumerate(known.kids)}
            kids, at = [], 0
            for kid in own.kids:
                if id(kid) in place:
                    stop = number[id(place[id(kid)])] + 1
                    kids += known.kids[at:stop]
                    at = stop
                else:
                    kids.append(counted(kid))
            known.kids = kids + known.kids[at:]
        settled(out)
    return out


def numbered(tree: Slot) -> dict[int, int]:
    """Number in document order of each node object."""
    order: dict[int, int] = {}
    pending = [tree]
    while pending:
        node = pending.pop()
        order[id(node)] = len(order)
        pending += reversed(node.kids)
    return order


def _template_parts(root: Node, constant: set[int]) -> set[int]:
    """Elements with text all of whose text is template."""
    whole: set[int] = set()
    order, pending = [], [root]
    while pending:
        node = pending.pop()
        order.append(node)
        if not node.skip:
            pending += [k for k in node.kids if isinstance(k, Node)]
    varying: set[int] = set()
    textual: set[int] = set()
    for node in reversed(order):
        if node.skip:
            continue
        own = any(isinstance(k, str) and k.strip() for k in node.kids)
        below = [id(k) for k in node.kids if isinstance(k, Node)]
        if (own and id(node) not in constant) or not varying.isdisjoint(below):
            varying.add(id(node))
        if own or not textual.isdisjoint(below):
            textual.add(id(node))
            if id(node) not in varying:
                whole.add(id(node))
    return whole


def _blocks(root: Node, constant: set[int]) -> tuple[list[str], list[str]]:
    """Text blocks of the whole page and of its main parts, without its template."""
    every: list[str] = []
    marked: list[str] = []
    run: list[str] = []
    varies = False
    template = _template_parts(root, constant) if constant else set()

    def flush(main: bool) -> None:
        nonlocal varies
        text = " ".join(entities.unescape("".join(run)).split()) if varies else ""
        run.clear()
        varies = False
        if text:
            every.append(text)
            if main:
                marked.append(text)

    pending: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while pending:
        node, k, main = pending.pop()
        if k == 0:
            if node.tag in BLOCKS:
                flush(pending[-1][2] if pending else False)
            if node.skip or id(node) in template:
                continue
            main = main or node.main
        for k in range(k, len(node.kids)):
            kid = node.kids[k]
            if isinstance(kid, str):
                run.append(kid)
                varies = varies or (id(node) not in constant and not kid.isspace())
            else:
                pending.append((node, k + 1, main))
                pending.append((kid, 0, main))
                break
        else:
            if node.tag in BLOCKS:
                flush(main)
    flush(False)
    return every, marked


class Wrapper:
    """What the pages of a host share: its tree, the numbers of its nodes, those that are template, and a matcher."""

    def __init__(self, tree: str, template: list[int] = ()):
        self.tree = slots(json.loads(tree))
        self.order = numbered(self.tree)
        self.template = set(template)
        self.matcher = Matcher()

    def constant(self, root: Node) -> set[int]:
        """Elements of a page that are aligned with template nodes and have their text."""
        return {id(o.node) for r, o in self.matcher.pairs(self.tree, skeleton(root)) if self.order[id(r)] in self.template and r.text == o.text}


def main_text(source: str, wrapper: Wrapper | None = None) -> str:
    """Main text of a page, given what its host's pages share."""
    root = parse(source)
    every, marked = _blocks(root, wrapper.constant(root) if wrapper else set())
    return "\n".join(marked if sum(map(len, marked)) >= MARKED * sum(map(len, every)) else every)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and node of its tree: pages aligned there, and those with the same text; equal pages share one vote."""
    counts: dict[tuple[str, int], list[float]] = {}
    wrappers: dict[str, Wrapper] = {}

    def rows() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array([counts[k][0] for k in keys], pa.float64()), pa.array([counts[k][1] for k in keys], pa.float64())],
            names=["host", "node", "pages", "same"],
        )
        counts.clear()
        wrappers.clear()
        return out

    for batch in batches:
        for host, source, tree, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            if host not in wrappers:
                wrappers[host] = Wrapper(tree.as_py())
            wrapper = wrappers[host]
            for r, o in wrapper.matcher.pairs(wrapper.tree, skeleton(parse(source.as_py()))):
                seen = counts.setdefault((host, wrapper.order[id(r)]), [0.0, 0.0])
                seen[0] += 1 / copies
                seen[1] += (r.text == o.text and r.text != 0) / copies
        if len(counts) > 200_000:
            yield rows()
    yield rows()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(nested(merged([skeleton(parse(s)) for s in bodies.as_py()])), separators=(",", ":")) for bodies in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], names=["host", "tree"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Wrapper] = {}
    for batch in batches:
        texts = []
        for host, source, tree, nodes in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5)):
            template = nodes.as_py()
            if template:
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = Wrapper(tree.as_py(), template)
                texts.append(main_text(source.as_py(), known[host]))
            else:
                texts.append(main_text(source.as_py()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _with_host(pages: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """Join a table by host: broadcast while small, else with hot hosts dealt over tasks."""
    size = hosts.agg(F.sum(F.octet_length("tree") + F.octet_length("host")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(hosts), "host", how)
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "body"), F.lit(SALTS)).cast("int"))
    return salted.join(hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], how).drop("salt")


def _copied(pages: DataFrame) -> DataFrame:
    """``pages`` with the number of equal pages of the host as ``copies``."""
    pages = pages.withColumn("body_hash", F.xxhash64("body"))
    groups = stage(pages.groupBy("host", "body_hash").agg(F.count("*").alias("copies")).filter("copies > 1"), "op3-copies")
    few = groups.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    joined = pages.join(F.broadcast(groups) if few else groups, ["host", "body_hash"], "left")
    return joined.withColumn("copies", F.coalesce("copies", F.lit(1))).drop("body_hash")


def templates(pages: DataFrame) -> DataFrame:
    """``(host, tree, template)`` of ``pages(page_id, host, body)``: each host's tree and its template nodes."""
    pages = _copied(pages)
    told = pages.filter("body <> ''").withColumn("part", F.pmod(F.xxhash64("body", F.lit(3)), F.lit(LENDERS)))
    lent = told.groupBy("host", "part").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "body"))["body"].alias("body"), F.sum(1 / F.col("copies")).alias("n_pages"))
    lenders = lent.groupBy("host").agg(F.array_sort(F.collect_list("body")).alias("bodies"), F.sum("n_pages").alias("n_pages"))  # at most LENDERS pages
    trees = stage(lenders.filter(F.col("n_pages") >= LEAST_PAGES - 1e-6).select("host", "bodies").mapInArrow(_trees, "host string, tree string"), "op3-trees")
    aligned = _with_host(pages, trees, "inner").select("host", "body", "tree", "copies").mapInArrow(_aligned, "host string, node int, pages double, same double")
    summed = aligned.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    seen = summed.groupBy("host").agg(
        F.collect_list(F.struct("node", "pages", "same")).alias("seen"),  # nodes of LENDERS pages
        F.max(F.when(F.col("node") == 0, F.col("pages"))).alias("all_pages"),  # every page has the root
    )
    least = F.greatest(F.lit(LEAST_PAGES), SPREAD * F.col("all_pages")) - 1e-6
    constant = F.filter("seen", lambda n: (n["pages"] >= least) & (n["same"] >= CONSTANT * n["pages"] - 1e-6))
    nodes = seen.select("host", F.array_sort(F.transform(constant, lambda n: n["node"])).alias("template")).filter(F.size("template") > 0)
    return trees.join(nodes, "host")


def extract(pages: DataFrame, *, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every row: ``page_id``, ``url``, ``text`` and ``n_chars``."""
    kind = pages.schema[id_column].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), "(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("body"))
    found = stage(templates(rows.select("page_id", "host", "body")), "op3-templates")
    joined = _with_host(rows, found, "left").select("page_id", "url", "host", "body", "tree", F.coalesce("template", F.array().cast("array<int>")).alias("template"))
    texts = joined.mapInArrow(_extracted, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
