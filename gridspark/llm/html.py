"""Main text of web pages by wrapper induction.

Pages of one host are filled from templates. Each page's DOM is reduced to its frame: the containers, without headings,
paragraphs, list items, table cells and running text. Pages of a host whose outer frames agree form a group, however many groups a
host has; the group's most frequent frame is its reference (a group of one or two pages takes that of the host's largest group).
Frames are aligned with their reference by simple tree matching, which finds the largest set of node pairs that agree in
tag and name and keep order and ancestry, whatever their size: subtrees of equal shape are matched once, and of a wide table only some
rows are kept. Every aligned node is a slot. A slot whose own text is constant over the pages that share the reference
is template; a varying one is content, unless its tag or its names say that it is a menu, header, footer, sidebar, notice, advert,
form or comment list. Inside article and main elements a constant slot goes only with a second sign, a name or wording of such parts:
a licence, a list of tags or a section title that all articles share stays. Pages whose slots are all equal count once: copies prove no template.

The content lies in the article and main elements if these hold at least half of the text of the varying slots, else in the whole page.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, record_batch
from gridspark.session import materialise

# Elements without an end tag, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml".split())
# Elements that stand in a line of text; all others start and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark meter"
    " output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math semantics mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder"
    " munderover".split())
# Elements that make a frame.
CONTAINERS = frozenset(
    "html body main article section div nav header footer aside form ul ol dl table td figure details dialog".split())
# Elements that are text whatever their names.
TEXTUAL = frozenset(
    "h1 h2 h3 h4 h5 h6 p li dt dd tr td th thead tbody tfoot caption blockquote pre figcaption summary legend address".split())
# Start tags that end an open element of the same kind.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
BARRIERS = frozenset("body main article section div nav header footer aside form ul ol dl table figure".split())

# Boilerplate by tag, and by a name: a container whose id, role, aria-label or a token of its class is one of the words,
# or joins one to another word (site-footer, comment-list).
BOILER_TAGS = frozenset("nav header footer aside form button select dialog head".split()) | RAW
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu menus"
    " header masthead footer sidebar sidebars aside notice notices cookie cookies consent gdpr popup modal newsletter"
    " subscribe share sharing social comment comments disqus reply replies related breadcrumb breadcrumbs toolbar"
    " search login signup contentinfo complementary".split())
PAGE_TAGS = frozenset(("#", "html", "body", "main", "article"))
BOILER_PARTS = frozenset("list box bar wrapper container area section block links form panel widget slot unit inner".split())
NOT_BOILER = frozenset("no not non with without has hide".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(id|class|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# Wording of calls to the reader: with a constant slot inside an article, the second sign that it is no part of the text.
CALLS = frozenset(
    "subscribe subscription newsletter join follow share sign login log register cookie cookies advertisement advert sponsored"
    " comment comments reply donate download app click".split())
CALL_WORDS = 30

# A slot is template if one value fills it on at least this share of the pages aligned to its reference, and on two or more.
CONSTANT_SHARE = 0.5
# Inside article and main elements, on three or more: two pages there may well show the same article.
LEAST_PAGES, LEAST_IN_ARTICLE = 2, 3
# Levels of the outer frame by which pages are grouped, and pages from which a group has a reference of its own.
OUTER, LEAST_GROUP = 5, 3
# Pairs of children up to which plain lists are the faster table, and rows of sizes kept beyond: neither decides a result.
SMALL_TABLE, ROWS_KEPT = 256, 64
# Set to a number, frames of whatever size are aligned near-linearly, which may leave out more nodes; farthest step between two matches.
EXACT_PAIRS, STEP = None, 32


@dataclass
class Element:
    tag: str
    names: str = ""
    children: list = field(default_factory=list)  # elements and strings
    marks: tuple = ()  # id, role, aria-label and the tokens of class


def parse(source: str) -> Element:
    """Tree of the page. Unclosed elements end with their parent; stray end tags are ignored."""
    root = Element("#")
    stack = [root]
    at, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at:m.start()])
        at = m.end()
        end, start = m[1], m[2]
        if end:
            tag = end.lower()
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    del stack[n:]
                    break
                if stack[n].tag in BARRIERS and tag not in BARRIERS:
                    break
        elif start:
            tag = start.lower()
            if tag in CLOSES or tag in BARRIERS or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close_before(stack, tag)
            named = [(a[0].lower(), (a[1] or a[2] or a[3]).lower()) for a in ATTRIBUTE.findall(m[3])] if "=" in m[3] else []
            marks = tuple(t for k, v in named for t in (v.split() if k in ("class", "role") else [v.strip()]))
            element = Element(tag, " ".join(v for _, v in named), marks=marks)
            stack[-1].children.append(element)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else size
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append(element)
    return root


def close_before(stack: list[Element], tag: str) -> None:
    """End the open elements that the start tag ends: an open paragraph, or its own kind up to the nearest container."""
    ended = CLOSES.get(tag, set()) | {"p"}
    for n in range(len(stack) - 1, 0, -1):
        if stack[n].tag in ended:
            del stack[n:]
            return
        if stack[n].tag in BARRIERS:
            return


def is_boiler(element: Element) -> bool:
    """Marked as boilerplate. Names of the page's own frame tell about the whole page, not about a part of it."""
    if element.tag in PAGE_TAGS:
        return False
    return element.tag in BOILER_TAGS or (element.tag in CONTAINERS and any(map(is_boiler_name, element.marks)))


def is_boiler_name(name: str) -> bool:
    """The word itself, or two parts: footer-links, site-footer, but neither no-sidebar nor search-and-rescue."""
    parts = [p.strip("0123456789") for p in re.split("[-_]+", name)]
    parts = [p for p in parts if p]
    if len(parts) == 1:
        return parts[0] in BOILER_WORDS
    return len(parts) == 2 and parts[0] not in NOT_BOILER and (
        parts[1] in BOILER_WORDS or (parts[0] in BOILER_WORDS and parts[1] in BOILER_PARTS))


def blocks(element: Element, frames: set[int], template: set[int]) -> list[str]:
    """Texts of the element's blocks in page order, without marked parts.

    Of frames that are in template (both by identity) the text of their own goes; their child frames are judged by themselves.
    """
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    work: list = [(element, False)]
    while work:
        node, mute = work.pop()
        if isinstance(node, str):
            if not mute:
                line.append(node)
        elif node is None:
            flush()
        elif node.tag == "br":
            line.append(" ")
        elif node is element or not (is_boiler(node) or (
                element.tag in ARTICLE and node.tag in ARTICLE and any(map(is_boiler_name, node.marks)))):
            if id(node) in frames:
                mute = id(node) in template
            if node.tag not in INLINE:
                flush()
                work.append((None, mute))
            work.extend((c, mute) for c in reversed(node.children))
        elif node.tag not in INLINE and node.tag not in RAW:
            flush()
    flush()
    return out


@dataclass
class Frame:
    """A container in the frame: label, children, the element, and the text of its own outside child frames."""

    label: str
    children: list
    element: Element | None = None
    own: str = ""


def frame_of(root: Element) -> Frame:
    """The frame tree. Raw elements and void ones are no part of it; those of TEXTUAL belong to the container around them."""
    top = Frame("#", [], root)
    own: dict[int, list[str]] = {id(top): []}
    frames = [top]
    work: list[tuple[Frame, object]] = [(top, c) for c in reversed(root.children)]
    while work:
        frame, node = work.pop()
        if isinstance(node, str):
            own[id(frame)].append(node)
            continue
        if node.tag in RAW or node.tag in VOID or node.tag == "head":
            continue
        inside = frame
        if node.tag in CONTAINERS or (node.names and node.tag not in INLINE and node.tag not in TEXTUAL):
            inside = Frame(f"{node.tag}.{re.sub('[0-9]+', '#', node.names)}", [], node)
            own[id(inside)] = []
            frames.append(inside)
            frame.children.append(inside)
        work.extend((inside, c) for c in reversed(node.children))
    for f in frames:
        f.own = " ".join("".join(own[id(f)]).split())
    return top


def owns(frame: Frame) -> list[str]:
    """Own texts of the frame and all below, in page order."""
    out, work = [], [frame]
    while work:
        node = work.pop()
        out.append(node.own)
        work.extend(reversed(node.children))
    return out


def elements_of(frame: Frame) -> set[int]:
    """Identities of the elements of the frame and all below."""
    out, work = set(), [frame]
    while work:
        node = work.pop()
        out.add(id(node.element))
        work.extend(node.children)
    return out


def dump(frame: Frame) -> str:
    """The frame's shape as text, labels only."""
    parts: list[str] = []
    work: list = [frame]
    while work:
        node = work.pop()
        if isinstance(node, str):
            parts.append(node)
        else:
            parts.append(f"({node.label}")
            work.append(")")
            work.extend(reversed(node.children))
    return "\x01".join(parts)


def restore(shape: str) -> Frame:
    top: Frame | None = None
    stack: list[Frame] = []
    for part in shape.split("\x01"):
        if part == ")":
            stack.pop()
        else:
            frame = Frame(part[1:], [])
            if stack:
                stack[-1].children.append(frame)
            else:
                top = frame
            stack.append(frame)
    return top


def numbered(frame: Frame) -> dict[int, int]:
    """Slot numbers of a reference frame's nodes, by identity, in page order."""
    out: dict[int, int] = {}
    work = [frame]
    while work:
        node = work.pop()
        out[id(node)] = len(out)
        work.extend(reversed(node.children))
    return out


class Shapes:
    """Numbers of frame shapes: frames that agree in label and in the shapes of their children share one."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.of: dict[int, int] = {}  # by the frame's identity

    def add(self, frame: Frame) -> int:
        below, work = [], [frame]
        while work:
            node = work.pop()
            below.append(node)
            work.extend(node.children)
        for node in reversed(below):
            children = tuple(self.of[id(c)] for c in node.children)
            key = (node.label, children)
            if key not in self.numbers:
                self.numbers[key] = len(self.labels)
                self.labels.append(node.label)
                self.children.append(children)
                self.sizes.append(1 + sum(self.sizes[c] for c in children))
            self.of[id(node)] = self.numbers[key]
        return self.of[id(frame)]


class Matching:
    """Sizes of the largest matchings of shapes: simple tree matching, each pair of shapes once.

    No call goes deeper for deeper frames, and a table keeps some of its rows only, so wide and deep frames take the same way as
    small ones.
    """

    def __init__(self, shapes: Shapes) -> None:
        self.shapes = shapes
        self.known: dict[tuple[int, int], int] = {}

    def plain(self, a: int, b: int) -> int | None:
        """What needs no table."""
        if a == b:
            return self.shapes.sizes[a]
        if self.shapes.labels[a] != self.shapes.labels[b]:
            return 0
        if not self.shapes.children[a] or not self.shapes.children[b]:
            return 1
        return self.known.get((a, b))

    def size(self, a: int, b: int) -> int:
        work = [(a, b)]
        while work:
            x, y = work[-1]
            if self.plain(x, y) is not None:
                work.pop()
                continue
            open_ = self.open_pairs(x, y)
            if open_:
                work.extend(open_)
                continue
            self.known[x, y] = 1 + self.most(self.shapes.children[x], self.shapes.children[y])
            work.pop()
        return self.plain(a, b)

    def open_pairs(self, x: int, y: int) -> list[tuple[int, int]]:
        """Pairs of children's shapes whose sizes are still to be found."""
        by_label: dict[str, list[int]] = {}
        for d in dict.fromkeys(self.shapes.children[y]):
            by_label.setdefault(self.shapes.labels[d], []).append(d)
        return [(c, d) for c in dict.fromkeys(self.shapes.children[x]) for d in by_label.get(self.shapes.labels[c], ())
                if self.plain(c, d) is None]

    def weights(self, left: tuple[int, ...], right: tuple[int, ...]) -> Callable[[int], np.ndarray]:
        """Sizes of one of the left shapes with each of the right ones; all pairs are known."""
        kinds = list(dict.fromkeys(right))
        place = {d: n for n, d in enumerate(kinds)}
        at = np.array([place[d] for d in right], np.int64)
        by_label: dict[str, list[int]] = {}
        for d in kinds:
            by_label.setdefault(self.shapes.labels[d], []).append(d)

        @lru_cache(maxsize=ROWS_KEPT)
        def row(c: int) -> np.ndarray:
            out = np.zeros(len(kinds), np.int64)
            for d in by_label.get(self.shapes.labels[c], ()):
                out[place[d]] = self.plain(c, d)
            return out[at]

        return row

    def most(self, left: tuple[int, ...], right: tuple[int, ...]) -> int:
        """Largest sum of sizes of pairs in order."""
        if len(left) * len(right) <= SMALL_TABLE:
            return small_table(self, left, right)[-1][-1]
        row, before = self.weights(left, right), np.zeros(len(right) + 1, np.int64)
        for c in left:
            before = next_row(before, row(c))
        return int(before[-1])

    def pairs(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the pairs of a largest sum, from the last on; of several, the one that leaves out the last of the left."""
        i, j, out = len(left), len(right), []
        if i * j <= SMALL_TABLE:
            first, table = 0, small_table(self, left, right)
        else:
            # Every step-th row is kept, and those between are made again once the way back comes to them.
            row, step = self.weights(left, right), math.isqrt(i) + 1
            kept, before = [], np.zeros(j + 1, np.int64)
            for n, c in enumerate(left):
                if n % step == 0:
                    kept.append(before)
                before = next_row(before, row(c))
            first, table = i + 1, []
        while i and j:
            if i <= first:
                first = (i - 1) // step * step
                table = [kept[first // step]]
                for c in left[first:i]:
                    table.append(next_row(table[-1], row(c)))
            here, above = table[i - first], table[i - 1 - first]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out


def next_row(before: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros_like(before)
    np.maximum.accumulate(np.maximum(before[1:], before[:-1] + weights), out=out[1:])
    return out


def small_table(known: Matching, left: tuple[int, ...], right: tuple[int, ...]) -> list[list[int]]:
    table = [[0] * (len(right) + 1)]
    for c in left:
        before, row = table[-1], [0]
        for n, d in enumerate(right):
            row.append(max(before[n + 1], row[n], before[n] + known.plain(c, d)))
        table.append(row)
    return table


def match(a: Frame, b: Frame, memo: dict) -> int:
    """Size of the largest matching of two frames: simple tree matching."""
    shapes = Shapes()
    return Matching(shapes).size(shapes.add(a), shapes.add(b))


def extent(frame: Frame) -> tuple[int, int]:
    """Nodes and levels of a frame."""
    nodes, levels, level = 0, 0, [frame]
    while level:
        nodes, levels = nodes + len(level), levels + 1
        level = [c for f in level for c in f.children]
    return nodes, levels


def align(page: Frame, reference: Frame) -> dict[int, Frame]:
    """Page frame by slot number of the reference, of all aligned nodes."""
    numbers, shapes, out = numbered(reference), Shapes(), {}
    shapes.add(page)
    shapes.add(reference)
    matching = Matching(shapes)
    work = [(page, reference)]
    while work:
        a, b = work.pop()
        if a.label != b.label:
            continue
        out[numbers[id(b)]] = a
        if [c.label for c in a.children] == [c.label for c in b.children]:
            work.extend(zip(a.children, b.children))
        elif EXACT_PAIRS is not None:
            work.extend(anchored(a.children, b.children))
        else:
            x, y = shapes.of[id(a)], shapes.of[id(b)]
            for c, d in matching.open_pairs(x, y):
                matching.size(c, d)
            work.extend((a.children[i], b.children[j]) for i, j in matching.pairs(shapes.children[x], shapes.children[y]))
    return out


def anchored(a: list[Frame], b: list[Frame]) -> list[tuple[Frame, Frame]]:
    """Pairs of equal label in order: from both ends, then at labels that occur once on both sides, then with the fewest left out."""
    low = 0
    while low < min(len(a), len(b)) and a[low].label == b[low].label:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high].label == b[-1 - high].label:
        high += 1
    pairs = list(zip(a[:low], b[:low])) + list(zip(a[len(a) - high:], b[len(b) - high:]))
    a, b = a[low:len(a) - high], b[low:len(b) - high]
    once = [{x: n for n, x in enumerate(f.label for f in side)} for side in (a, b)]
    numbers = [Counter(f.label for f in side) for side in (a, b)]
    single = [(once[0][f.label], once[1][f.label]) for f in a if numbers[0][f.label] == numbers[1][f.label] == 1]
    i = j = 0
    for next_i, next_j in [*rising(single), (len(a), len(b))]:
        while i < next_i and j < next_j:
            # The next pair by the fewest nodes left out of both sides together.
            step = next(((di, s - di) for s in range(STEP + 1) for di in range(s + 1)
                         if i + di < next_i and j + s - di < next_j and a[i + di].label == b[j + s - di].label), None)
            if step:
                pairs.append((a[i + step[0]], b[j + step[1]]))
            di, dj = step or (0, 0)
            i, j = i + di + 1, j + dj + 1
        if next_i < len(a):
            pairs.append((a[next_i], b[next_j]))
        i, j = next_i + 1, next_j + 1
    return pairs


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of the pairs, whose first numbers rise, in which the second ones rise too."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            ends.append(n)
        else:
            tails[k], ends[k] = j, n
        before.append(ends[k - 1] if k else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def outer(frame: Frame) -> int:
    """Hash of the outer frame: the different label paths of its first levels, however often each occurs."""
    import xxhash

    paths, level = {frame.label}, [(frame, frame.label)]
    for _ in range(OUTER - 1):
        level = [(c, f"{path}\x01{c.label}") for f, path in level for c in f.children]
        paths.update(path for _, path in level)
    return xxhash.xxh3_64_intdigest("\x02".join(sorted(paths)).encode("utf-8", "surrogatepass")) - (1 << 63)


def second_sign(frame: Frame) -> bool:
    """A name or wording that says the slot is no part of an article."""
    marks = frame.element.marks if frame.element else ()
    if any(p in BOILER_WORDS for m in marks for p in re.split("[-_0-9]+", m)):
        return True
    words = re.findall(r"[^\W\d_]+", frame.own.lower())
    return len(words) <= CALL_WORDS and not CALLS.isdisjoint(words)


def slot_values(page: Frame, reference: Frame, inside: set[int]) -> list[tuple[int, int, str]]:
    """(slot, pages that make it template, own text) of aligned slots that hold text of their own and may be template."""
    return [
        (n, LEAST_IN_ARTICLE if n in inside else LEAST_PAGES, f.own) for n, f in align(page, reference).items()
        if f.own and (n not in inside or second_sign(f))]


def extract(source: str, shape: str | None, constant: frozenset[int]) -> str:
    """Main text of a page, given its reference frame and the slots that are template."""
    root = parse(source)
    template: set[int] = set()
    frames: set[int] = set()
    if constant:
        page = frame_of(root)
        frames = elements_of(page)
        for n, f in align(page, restore(shape)).items():
            if n in constant and f.element is not root:
                template.add(id(f.element))
    found = articles(root)
    lines = [line for element in found for line in blocks(element, frames, template)]
    everything = blocks(root, frames, template) if constant or not found else lines
    if not found or 2 * sum(map(len, lines)) < sum(map(len, everything)):
        lines = everything
    if not lines and not found:
        # Nothing outside marked parts: an article inside one is the page's text after all.
        lines = [line for element in articles(root, into_marked=True) for line in blocks(element, frames, set())]
    return "\n".join(lines)


ARTICLE = ("article", "main")


def articles(root: Element, into_marked: bool = False) -> list[Element]:
    found, work = [], [root]
    while work:
        node = work.pop()
        if node.tag in ARTICLE:
            found.append(node)
        elif node is root or into_marked or not is_boiler(node):
            work.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return found


def in_articles(reference: Frame) -> set[int]:
    """Numbers of the slots that are article or main elements or lie inside one."""
    numbers, out, work = numbered(reference), set(), [(reference, False)]
    while work:
        frame, inside = work.pop()
        inside = inside or frame.label.split(".", 1)[0] in ARTICLE
        if inside:
            out.add(numbers[id(frame)])
        work.extend((c, inside) for c in frame.children)
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    text holds the main text's blocks joined by line ends, white space inside a block turned into one blank; it is empty
    if nothing is left. A null html counts as empty. Pages whose url is null or has no host form one group. Null and
    repeated page_ids stay as they are, other columns of pages are ignored, an empty table gives an empty one.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    hosted = pages.withColumn("host", host)

    def shapes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [frame_of(parse(h)) for h in batch.column("html").to_pylist()]
        return record_batch(**{c: batch.column(c) for c in ("page_id", "url", "html", "host")},
                            outer=([outer(f) for f in found], pa.int64()), shape=([dump(f) for f in found], pa.string()))

    # Written with what parsing found out, so that the two passes that follow need not parse for the group alone.
    placed = materialise(arrow_map(
        hosted, shapes, "page_id long, url string, html string, host string, outer long, shape string"))
    counted = placed.groupBy("host", "outer", "shape").agg(F.count("*").alias("n"))
    groups = materialise(counted.groupBy("host", "outer").agg(
        F.sum("n").alias("pages"), F.max(F.struct("n", "shape"))["shape"].alias("shape")))
    largest = groups.groupBy("host").agg(F.max(F.struct("pages", "outer", "shape")).alias("top"))
    own = F.col("pages") >= LEAST_GROUP
    references = materialise(groups.join(largest, "host").select(
        "host", "outer", F.when(own, F.col("outer")).otherwise(F.col("top.outer")).alias("reference"),
        F.when(own, F.col("shape")).otherwise(F.col("top.shape")).alias("shape")))

    def values(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        restored: dict[str, tuple[Frame, set[int]]] = {}
        out: list[tuple] = []
        digest = lambda t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
        for name, source, group, shape in zip(*[batch.column(c).to_pylist() for c in ("host", "html", "reference", "shape")]):
            if shape not in restored:
                frame = restore(shape)
                restored[shape] = frame, in_articles(frame)
            page = frame_of(parse(source))
            whole = digest("\x01".join(owns(page)))
            out.append((name, group, -1, 0, 0, whole))
            out += [(name, group, slot, least, digest(own), whole) for slot, least, own in slot_values(page, *restored[shape])]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return record_batch(**dict(zip(("host", "reference", "slot", "least", "digest", "page"), zip(zip(*out), kinds))))

    known = placed.select("host", "html", "outer").join(references, ["host", "outer"]).select(
        "host", "html", "reference", "shape")
    # Slot -1 stands for the page itself.
    fills = materialise(arrow_map(
        known, values, "host string, reference long, slot long, least int, digest long, page long").distinct().groupBy(
            "host", "reference", "slot", "digest").agg(F.max("least").alias("least"), F.count("*").alias("n")))
    constant = fills.where("slot >= 0").groupBy("host", "reference", "slot").agg(
        F.max("least").alias("least"), F.max("n").alias("n")).join(
            fills.where("slot < 0").select("host", "reference", F.col("n").alias("pages")), ["host", "reference"]).where(
                (F.col("n") >= F.col("least")) & (F.col("n") >= CONSTANT_SHARE * F.col("pages")))
    # A reference has no more slots than its frame has nodes.
    wrappers = materialise(references.join(
        constant.groupBy("host", "reference").agg(F.sort_array(F.collect_list("slot")).alias("constant")),
        ["host", "reference"], "left").select(
            "host", "outer", "shape", F.coalesce("constant", F.array().cast("array<long>")).alias("constant")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            extract(source, shape, frozenset(slots or ()))
            for source, shape, slots in zip(*[batch.column(c).to_pylist() for c in ("html", "shape", "constant")])]
        return record_batch(page_id=batch.column("page_id"), url=batch.column("url"), text=(found, pa.string()),
                            n_chars=([len(t) for t in found], pa.int64()))

    joined = placed.drop("shape").join(wrappers, ["host", "outer"]).select("page_id", "url", "html", "shape", "constant")
    return arrow_map(joined, run, "page_id long, url string, text string, n_chars long")
