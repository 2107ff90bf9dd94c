"""Packing documents into fixed-length sequences, shortest pack first over the length histogram.

Documents are cut at multiples of the sequence length; what is left over has a length of at most
one sequence. Only the histogram of these lengths, at most one entry per possible length, reaches the
driver: lengths are placed longest first, each into the packs with the most room, by counts of packs with
the same pattern. Whole packs beyond the fewest possible are then taken apart, emptiest first, and their
pieces are cut to fill the room in the others exactly, so less than one sequence of padding remains
in all. Patterns and documents are joined again by a document's rank among those of its length.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, texts
from gridspark.llm.tokens import CACHE_ENTRIES, word_encoder
from gridspark.session import materialise

END_ID = 1
SEQUENCE = 2048
# Rows that share one rank counter. Ranks of a length are counted per slice of it, so one length may hold any
# share of the rows.
RANK_SLICE = 50_000


@dataclass
class Pattern:
    """`count` packs, each with (length, copies) parts in order."""

    count: int
    parts: tuple[tuple[int, int], ...]
    used: int


def add(parts: tuple[tuple[int, int], ...], length: int, copies: int = 1) -> tuple[tuple[int, int], ...]:
    if parts and parts[-1][0] == length:
        return (*parts[:-1], (length, parts[-1][1] + copies))
    return (*parts, (length, copies))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns that hold every length of the histogram as often as it counts, without cuts."""
    open_packs: list[tuple[int, int, Pattern]] = []  # (tokens used, tie, pattern): the emptiest pack first
    tie = 0

    def push(pattern: Pattern) -> None:
        nonlocal tie
        if pattern.count:
            tie += 1
            heapq.heappush(open_packs, (pattern.used, tie, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and open_packs[0][0] + length <= size:
            _, _, pattern = heapq.heappop(open_packs)
            take = min(left, pattern.count)
            push(Pattern(pattern.count - take, pattern.parts, pattern.used))
            push(Pattern(take, add(pattern.parts, length), pattern.used + length))
            left -= take
        if left:
            per_pack = size // length
            push(Pattern(left // per_pack, ((length, per_pack),), per_pack * length))
            if left % per_pack:
                push(Pattern(1, ((length, left % per_pack),), left % per_pack * length))
    return [p for _, _, p in sorted(open_packs, key=lambda x: (x[0], x[1]))]


@dataclass
class Plan:
    """Where the documents of each length go, as flat arrays for a search by (length, rank)."""

    size: int
    # Slots of kept packs: ranks low .. low + copies * packs - 1 of a length.
    key: np.ndarray  # length << 44 | low, ascending
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    cut_base: np.ndarray  # >= 0: the ranks are cut; place of the first one in the stream of cut tokens
    # Room in kept packs, as a stream: packs gap_sequence ... of equal room from gap_start on.
    gap_start: np.ndarray
    gap_room: np.ndarray
    gap_sequence: np.ndarray


def make_plan(histogram: dict[int, int], size: int) -> Plan:
    patterns = shortest_pack_first(histogram, size)  # emptiest first
    tokens = sum(length * n for length, n in histogram.items())
    surplus = sum(p.count for p in patterns) - -(-tokens // size)
    dissolved, kept = [], []
    for p in patterns:
        gone = min(surplus, p.count)
        surplus -= gone
        if gone:
            dissolved.append(Pattern(gone, p.parts, p.used))
        if p.count - gone:
            kept.append(Pattern(p.count - gone, p.parts, p.used))
    low: dict[int, int] = {}
    rows, gaps, sequence, place = [], [], 0, 0
    for p in kept:
        offset = 0
        for length, copies in p.parts:
            start = low.get(length, 0)
            rows.append((length << 44 | start, copies, sequence, offset, -1))
            low[length] = start + copies * p.count
            offset += length * copies
        if offset < size:
            gaps.append((place, size - offset, sequence))
            place += (size - offset) * p.count
        sequence += p.count
    cut: dict[int, int] = {}
    for p in dissolved:
        for length, copies in p.parts:
            cut[length] = cut.get(length, 0) + copies * p.count
    base = 0
    for length, n in sorted(cut.items()):
        rows.append((length << 44 | low.get(length, 0), 1, 0, 0, base))
        base += length * n
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
    room = [np.array(c, np.int64) for c in zip(*gaps)] if gaps else [np.zeros(0, np.int64)] * 3
    return Plan(size, *columns, *room)


def place(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start in the piece, length, sequence, offset) of the parts of the rank-th piece of a length."""
    at = int(np.searchsorted(plan.key, length << 44 | rank, "right")) - 1
    nth = rank - (int(plan.key[at]) & (1 << 44) - 1)
    base = int(plan.cut_base[at])
    if base < 0:
        copies = int(plan.copies[at])
        return [(0, length, int(plan.sequence[at]) + nth // copies, int(plan.offset[at]) + nth % copies * length)]
    out, start, stream = [], 0, base + nth * length
    while start < length:
        g = int(np.searchsorted(plan.gap_start, stream, "right")) - 1
        room = int(plan.gap_room[g])
        pack, inside = divmod(stream - int(plan.gap_start[g]), room)
        take = min(length - start, room - inside)
        out.append((start, take, int(plan.gap_sequence[g]) + pack, plan.size - room + inside))
        start += take
        stream += take
    return out


def token_pieces(docs: DataFrame, path: str, size: int, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Every document's ids and its end id, cut at multiples of `size`: one row per piece.

    ids are kept for pieces shorter than a sequence only: others are never cut again.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = word_encoder(path, cache_entries)
        end = np.array([END_ID], encoder.dtype).tobytes()
        row, start, length, crc, total, kept = [], [], [], [], [], []
        for n, encoded in enumerate(encoder.encode(texts(batch))):
            ids = np.frombuffer(encoded + end, encoder.dtype)
            for a in range(0, len(ids), size):
                part = ids[a:a + size]
                row.append(n)
                start.append(a)
                length.append(len(part))
                crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                total.append(len(ids))
                kept.append(part.tobytes() if len(part) < size else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return arrow_map(docs.select("doc_id", "text"), cut,
                     "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def ranked(pieces: DataFrame, slices: int) -> DataFrame:
    """(piece, length, rank): rank counts from 0 among the pieces of a length, whatever share it holds."""
    keyed = pieces.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(slices)).alias("slice"))
    counts = keyed.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.select(
        "length", "slice",
        (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    numbered = keyed.withColumn(
        "nth", F.row_number().over(Window.partitionBy("length", "slice").orderBy("piece")) - 1)
    return numbered.join(before, ["length", "slice"]).select(
        "piece", "length", (F.col("before") + F.col("nth")).cast("long").alias("rank"))


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most `size` tokens; one row per piece.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids (binary, null for whole sequences of one document). Each id of a document
    lies in exactly one piece; a sequence's pieces are gapless from 0; only one sequence of all is
    not full. A null or empty text is a document of the end id alone. Null and repeated doc_ids are
    documents of their own, other columns of docs are ignored, an empty table gives an empty one. A worker keeps the ids
    of at most `cache_entries` words, which costs memory as long as it lives and saves time.
    """
    pieces = materialise(token_pieces(docs, path, size, cache_entries).withColumn("piece", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, size)
    slices = max(16, sum(histogram.values()) // RANK_SLICE)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, length, sequence, offset, crc, parts = [], [], [], [], [], [], []
        columns = {c: batch.column(c).to_pylist() for c in ("start", "length", "rank", "ids_crc32", "ids")}
        width = 2 if any(x is not None and len(x) == 2 * n for x, n in zip(columns["ids"], columns["length"])) else 4
        for n, (first, total, rank, whole, ids) in enumerate(zip(*columns.values())):
            for a, count, where, at in place(plan, total, rank):
                part = ids[a * width:(a + count) * width] if ids is not None else None
                row.append(n)
                start.append(first + a)
                length.append(count)
                sequence.append(where)
                offset.append(at)
                crc.append(whole if count == total else zlib.crc32(
                    np.frombuffer(part, f"<u{width}").astype("<u4").tobytes()))
                parts.append(part)
        rows = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(crc, pa.int64()), batch.column("doc_tokens").take(rows), pa.array(sequence, pa.int64()),
             pa.array(offset, pa.int64()), pa.array(parts, pa.binary())],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    joined = pieces.join(ranked(pieces, slices).select("piece", "rank"), "piece")
    return arrow_map(joined, assign,
                     "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
                     " offset long, ids binary")
