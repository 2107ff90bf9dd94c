"""Periodic runs of words: maximal stretches that repeat with a smallest period.

A stretch of period q and length m makes its suffixes at distance q agree in m - q words, so runs lie among suffixes
with long common prefixes. Suffix classes start as single positions and are united by decreasing length of the common
prefix (Kruskal's order on the suffix array's neighbours), with a union-find whose classes hold their positions in
order. When two positions become neighbours in a class at common prefix l, the words between them repeat for
l more: if their distance is at most l / 2 (three periods and more) they seed a run, which is exact to the right
because the prefix ends there, and counted once because its left end must not extend. No smaller period exists, as its
position would lie between the two.

Runs of 24 words and three periods need a common prefix of 16, so only texts in which some 16 words occur twice are
sorted, all such texts of a batch together. Every text stays in its task; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridspark.llm.common import arrow_map, texts

SHORTEST, PERIODS = 24, 3
# Common prefix that every run implies: its length less its period.
PREFIX = 16
# Words sorted at a time (one longer text goes alone) and positions in a block of an ordered set.
SLICE = 500_000
BLOCK = 512

RUN = "start: bigint, length: bigint, period: bigint"


class Positions:
    """Ordered set of numbers in blocks, so that one insertion moves few of them."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def after(self, x: int) -> int | None:
        """Smallest member above x, which is a member."""
        at = bisect_left(self.lows, x + 1) - 1
        block = self.blocks[at]
        place = bisect_left(block, x + 1)
        if place < len(block):
            return block[place]
        return self.lows[at + 1] if at + 1 < len(self.lows) else None

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert x, not a member so far; its neighbours."""
        at = max(0, bisect_left(self.lows, x) - 1)
        block = self.blocks[at]
        place = bisect_left(block, x)
        before = block[place - 1] if place else None
        if place < len(block):
            following = block[place]
        else:
            following = self.lows[at + 1] if at + 1 < len(self.lows) else None
        block.insert(place, x)
        if not place:
            self.lows[at] = x
        if len(block) > 2 * BLOCK:
            self.blocks[at:at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.lows.insert(at + 1, block[BLOCK])
        self.size += 1
        return before, following


def kruskal_runs(words: list[int], edges: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, given suffix-array neighbours (x, y, common prefix), longest first."""
    root: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    found: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for prefix, level in groupby(edges, key=lambda e: e[2]):
        seeds: list[tuple[int, int]] = []

        def meet(i: int | None, j: int | None) -> None:
            if i is None or j is None:
                return
            d = j - i
            if (PERIODS - 1) * d <= prefix and d + prefix >= SHORTEST and (not i or words[i - 1] != words[j - 1]):
                seeds.append((i, j))

        for x, y, _ in level:
            a, b = find(x), find(y)
            large, small = sets.get(a) or Positions(a), sets.get(b) or Positions(b)
            if large.size < small.size:
                a, b, large, small = b, a, small, large
            root[b] = a
            sets[a] = large
            sets.pop(b, None)
            members = list(small)
            previous = None
            for here, later in zip(members, [*members[1:], None]):
                before, following = large.add(here)
                if before != previous or previous is None:
                    meet(before, here)
                if following is not None and (later is None or following < later):
                    meet(here, following)
                previous = here
        # Classes of one level are complete only now: a pair that a later union of the level parted is no seed.
        for i, j in seeds:
            if sets[find(i)].after(i) == j:
                found.append((i, j - i + prefix, j - i))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def ranks(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Order of the first 1, 2, 4, ... words from each position, until all differ; `ends` is the end of each position's text."""
    place = np.arange(len(ids))
    levels = [np.unique(ends * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while levels[-1].max() + 1 < len(ids):
        now = levels[-1]
        later = np.zeros(len(ids), np.int64)
        inside = place + step < ends
        later[inside] = now[place[inside] + step] + 1
        levels.append(np.unique(now * (len(ids) + 1) + later, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return [level.astype(np.int32) for level in levels]


def neighbours(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-array neighbours (x, y) of the same text with a common prefix of PREFIX or more, and its length."""
    levels = ranks(ids, ends)
    order = np.argsort(levels[-1], kind="stable")
    x, y = order[:-1], order[1:]
    same = ends[x] == ends[y]
    x, y = x[same], y[same]
    common = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        u, v = x + common, y + common
        open_ = np.flatnonzero((u < ends[x]) & (v < ends[x]))
        equal = open_[levels[k][u[open_]] == levels[k][v[open_]]]
        common[equal] += 1 << k
    long = common >= PREFIX
    return x[long], y[long], common[long]


def repeated(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the texts in which the hash of some PREFIX words in a row occurs twice."""
    n = len(ids)
    if n <= PREFIX:
        return np.zeros(0, np.int64)
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < PREFIX:
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        step *= 2
    at = np.flatnonzero(np.arange(len(h)) + PREFIX <= ends[:len(h)])
    h = h[at] ^ (ends[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(h)
    twice = h[order][1:] == h[order][:-1]
    return np.unique(ends[at[order[1:][twice]]])


def runs_of(sequences: list[list]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period), by start and period, of each sequence of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    sizes = np.array([len(s) for s in sequences], np.int64)
    if not sizes.sum():
        return out
    number = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for s in sequences for w in s), np.int64, int(sizes.sum()))
    stops = np.cumsum(sizes)
    wanted = repeated(ids, np.repeat(stops, sizes))
    chosen = np.searchsorted(stops, wanted)
    if not len(chosen):
        return out
    parts = [ids[stops[k] - sizes[k]:stops[k]] for k in chosen]
    joined = np.concatenate(parts)
    ends = np.cumsum(sizes[chosen])
    x, y, common = neighbours(joined, np.repeat(ends, sizes[chosen]))
    text = np.searchsorted(ends, x, side="right")
    order = np.lexsort((-common, text))
    starts = ends - sizes[chosen]
    x, y, common, text = x[order], y[order], common[order], text[order]
    borders = np.searchsorted(text, np.arange(len(chosen) + 1))
    for k, (a, b) in enumerate(zip(borders, borders[1:])):
        if a < b:
            edges = zip((x[a:b] - starts[k]).tolist(), (y[a:b] - starts[k]).tolist(), common[a:b].tolist())
            out[chosen[k]] = kruskal_runs(parts[k].tolist(), edges)
    return out


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, made periodic from some place on in every tenth document by a hash of its id; never without an id."""
    if doc_id is None or not words:
        return words
    hashed = zlib.crc32(str(doc_id).encode())
    if hashed % 10:
        return words
    g, n = hashed // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, each run reduced to its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])


def slices(sequences: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    part: list[list[bytes]] = []
    size = 0
    for words in sequences:
        if part and size + len(words) > SLICE:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def found_in(docs: DataFrame, plant: bool, schema: str, columns) -> DataFrame:
    """doc_id and what `columns` makes of all words and runs of the batch."""

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column("doc_id").to_pylist(), []
        sequences = (words_of(t) for t in texts(batch))
        if plant:
            sequences = map(planted, ids, sequences)
        for part in slices(sequences):
            rows += [columns(words, runs) for words, runs in zip(part, runs_of(part))]
        types = pa.schema([f for f in batch.schema if f.name == "doc_id"])
        values = [pa.array(v, t) for v, t in zip(zip(*rows), ARROW[schema])]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *values], names=[*types.names, *[f.split()[0] for f in schema.split(", ")]])

    return arrow_map(docs.select("doc_id", "text"), search, f"doc_id long, {schema}")


LISTED = "runs array<struct<start:bigint,length:bigint,period:bigint>>"
DIGEST = ("n_runs long", "start long", "length long", "period long", "exponent_milli long", "runs_sha256 string",
          "collapsed_sha256 string")
DIGESTED = ", ".join(DIGEST)
ARROW = {
    LISTED: [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))],
    DIGESTED: [pa.int64()] * 5 + [pa.string()] * 2,
}


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id and runs, an array of (start, length, period) by start and period.

    Words are separated by ASCII white space; a null or empty text has none and no runs. Null and repeated doc_ids stay,
    other columns are ignored, an empty table gives an empty one.
    """
    names = ("start", "length", "period")
    return found_in(docs, False, LISTED, lambda words, runs: ([dict(zip(names, r)) for r in runs],))


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best: tuple = (None,) * 3
    for run in runs:
        # Greatest length / period without rounding; runs come by start and period, so the first of equals stays.
        if best[0] is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def planted_runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), whose words are first made periodic where `planted` says so: n_runs, the run
    of greatest exponent (start, length, period, exponent_milli; null without runs), a hash of all runs and one of the
    collapsed text. Odd rows as in periodic_runs; rows without doc_id are never made periodic.
    """
    return found_in(docs, True, DIGESTED, digest)
