"""Near-duplicate documents by the share of five-word shingles they have in common: every pair at 0.8 or more is linked.

A document is the set of its shingles' 64-bit hashes; equal sets are one node, under a 128-bit hash of the set. Two sets at 0.8 or
more share one of the first fifth of their shingles in any order common to all sets, so nodes that share such a shingle are
the candidates and none is missed. The order puts shingles that are frequent in a bounded sample last; it decides the cost,
not the result.

Links only matter up to components, so candidates are taken in rounds and compared only while their nodes are apart: first the links
of SimHash fingerprints, found with vantage-point trees, and one link per shingle (to its smallest node); then, where many nodes share a
shingle, the nearest node of another group; then all that are left. A bitmap of shingle parities bounds the difference of
two sets from below, so most pairs never meet the sets themselves; large sets have a second one that grows with them, which
is compared where the first leaves a pair open. Shingles of many nodes are compared in tiles.

Texts stay where they are until the end. Bloom filters of fixed size tell the tasks which shingles more than one document has, and which
rows' sets are wanted; what they let through too much is dropped by the joins that follow. At the end only documents that
have copies or links are shuffled with their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import simhash
from gridspark.llm.common import components, key_filter, may_hold, record_batch, texts
from gridspark.session import Scratch, materialise

WORDS_PER_SHINGLE = 5
# Similarity of a link, as a fraction: 4/5.
PART, WHOLE = 4, 5
BITMAP_BYTES = 128

# Rows handed to Python at a time: texts and sets are large.
BATCH_ROWS = 200

# Nodes sampled for the order of shingles, and the most shingles it puts last.
SAMPLE = 10_000
FREQUENT = 100_000
# Nodes of a shingle up to which a join pairs them, and nodes in a side of a tile.
FEW = 32
TILE = 2048


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """As in common, with each batch's memory handed back before the next one comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest, n = xxhash.xxh3_64_intdigest, WORDS_PER_SHINGLE
    return np.unique(np.array([digest(b" ".join(words[i:i + n])) for i in range(max(1, len(words) - n + 1))], np.uint64))


def key_of(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def bitmap(found: np.ndarray, length: int = BITMAP_BYTES) -> bytes:
    """Parities of the numbers of shingles at each bit. Bitmaps differ in no more bits than sets in members."""
    odd = np.bincount((found % np.uint64(8 * length)).astype(np.int64), minlength=8 * length) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_bitmap(found: np.ndarray) -> bytes | None:
    """A bitmap of two to four bits for each shingle, a power of two; None where `bitmap` has as many."""
    bits = 1 << (2 * len(found) - 1).bit_length()
    return bitmap(found, bits // 8) if bits > 8 * BITMAP_BYTES else None


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the length of the other."""
    length = min(len(x), len(y)) // 8
    x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, length), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def majority(found: np.ndarray) -> int:
    """SimHash fingerprint of the set, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 16_384):
        ones += np.unpackbits(found[at:at + 16_384].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return (PART + WHOLE) * shared >= PART * len(both)


def node_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingles(t) for t in texts(batch)]
    return record_batch(
        row=batch.column("row"), doc_id=batch.column("doc_id"), key=([key_of(s) for s in sets], pa.binary()),
        size=([len(s) for s in sets], pa.int32()), print=([majority(s) for s in sets], pa.int64()),
        bitmap=([bitmap(s) for s in sets], pa.binary()), wide=([wide_bitmap(s) for s in sets], pa.binary()))


def frequent_last(docs: DataFrame, nodes: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that are frequent among sampled nodes, and their numbers."""
    share = min(1.0, SAMPLE / max(1, nodes.count()))
    drawn = nodes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("row").limit(2 * SAMPLE)
    # A bounded table; rows that are equal in every column count once.
    sample = docs.join(F.broadcast(drawn), "row").dropDuplicates(["row"])

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record_batch(shingle=pa.array(np.concatenate([shingles(t) for t in texts(batch)]).view(np.int64)))

    counted = arrow_map(sample.select("text"), spread, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    rows = counted.where("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    keys = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return np.stack([keys[order], rows["n"].to_numpy(np.int64)[order].astype(np.uint64)])


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set shares at least one."""
    keys, numbers = frequent
    n = np.zeros(len(found), np.uint64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        n = np.where(keys[at] == found, numbers[at], n)
    return found[np.lexsort((found, n))][:len(found) + 1 - -(-PART * len(found) // WHOLE)]


def shared_prefixes(docs: DataFrame, nodes: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(shingle, node, size, n, least): the nodes that hold a shingle of more than one node in their prefixes, how many
    they are, and the smallest of them with its size."""
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(frequent_last(docs, nodes))
    chosen = key_filter(nodes.select("row"))

    def prefixes(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sets and prefixes of the batch's rows that stand for a node."""
        hit = may_hold(chosen.value, batch.column("row").to_numpy())
        sets = [shingles(t or "") for t in batch.column("text").filter(pa.array(hit)).to_pylist()]
        return sets, [prefix(s, frequent.value) for s in sets]

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, found = prefixes(batch)
        return record_batch(shingle=pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)))

    counted = arrow_map(docs.select("row", "text"), alone, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    several = key_filter(counted.where("n > 1").select("shingle"))

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, found = prefixes(batch)
        found = [f[may_hold(several.value, f.view(np.int64))] for f in found]
        lengths = [len(f) for f in found]
        keys = np.array([key_of(s) for s in sets], object)
        return record_batch(
            shingle=pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)),
            key=pa.array(np.repeat(keys, lengths).tolist(), pa.binary()),
            size=pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), lengths), pa.int32()))

    holders = write(arrow_map(docs.select("row", "text"), held, "shingle long, key binary, size int").join(
        nodes.select("key", "node"), "key").select("shingle", "node", "size"))
    for used in (frequent, chosen, several):
        used.destroy()
    stated = holders.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("least"), F.max("node").alias("most"))
    return write(holders.join(stated.where("least.node <> most").drop("most"), "shingle"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b) of nodes that are similar."""

    def side(name: str, *columns: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def bounded(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(f"bitmap_{s}").to_pylist()), np.uint64).reshape(
            batch.num_rows, -1) for s in "ab")
        total = sum(batch.column(f"size_{s}").to_numpy().astype(np.int64) for s in "ab")
        keep = (PART + WHOLE) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (WHOLE - PART) * total
        return batch.select(["a", "b"]).filter(pa.array(keep))

    def bounded_wide(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [x is None or y is None or (PART + WHOLE) * differing(x, y) <= (WHOLE - PART) * (m + n) for x, y, m, n in zip(
            *[batch.column(c).to_pylist() for c in ("wide_a", "wide_b", "size_a", "size_b")])]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(
            batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist())]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = write(arrow_map(pairs.select("a", "b").distinct().join(side("a", "size", "bitmap"), "a").join(
        side("b", "size", "bitmap"), "b"), bounded, "a long, b long"))
    # In large sets the first bitmaps fill up and tell little.
    near = write(arrow_map(near.join(side("a", "size", "wide").where("wide_a is not null"), "a", "left").join(
        side("b", "size", "wide").where("wide_b is not null"), "b", "left"), bounded_wide, "a long, b long"))
    # Only nodes of open pairs have their sets made again, from the row that stands for them.
    wanted = write(near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(
        nodes.select("node", "key", "row"), "node"))
    chosen = key_filter(wanted.select("row"))

    def set_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = may_hold(chosen.value, batch.column("row").to_numpy())
        sets = [shingles(t or "") for t in batch.column("text").filter(pa.array(hit)).to_pylist()]
        return record_batch(key=([key_of(s) for s in sets], pa.binary()), shingles=([s.tobytes() for s in sets], pa.binary()))

    sets = write(arrow_map(docs.select("row", "text"), set_rows, "key binary, shingles binary").join(
        wanted.select("key", "node"), "key").groupBy("node").agg(F.any_value("shingles").alias("shingles")))
    chosen.destroy()
    ends = [sets.select(F.col("node").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "ab"]
    return write(arrow_map(
        near.join(ends[0], "a").join(ends[1], "b").select("a", "b", "shingles_a", "shingles_b"), exact, "a long, b long"))


def tile_pairs(nearest: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Pairs of nodes of different groups in a tile that sizes and bitmaps leave open: all, or the nearest of each node."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["block"] == b] for b in key[1:])
        node, size, group = right["node"].to_numpy(), right["size"].to_numpy(np.int64), right["group"].to_numpy()
        bits = np.frombuffer(b"".join(right["bitmap"]), np.uint64).reshape(len(right), BITMAP_BYTES // 8)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for n, s, g, m in zip(left["node"], left["size"], left["group"], left["bitmap"]):
            open_ = np.flatnonzero((group != g) & (WHOLE * np.minimum(size, s) >= PART * np.maximum(size, s)))
            if key[1] == key[2] and not nearest:
                open_ = open_[node[open_] > n]
            differ = np.bitwise_count(bits[open_] ^ np.frombuffer(m, np.uint64)).sum(axis=1, dtype=np.int64)
            fits = (PART + WHOLE) * differ <= (WHOLE - PART) * (size[open_] + s)
            found = node[open_[fits]]
            if nearest and len(found):
                found = found[[np.argmin(differ[fits] / (size[open_[fits]] + s))]]
            out.append((np.minimum(found, n), np.maximum(found, n)))
        a, b = (np.concatenate([p[k] for p in out] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return compare


def linked_nodes(docs: DataFrame, nodes: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that connect what the links of nodes (node, key, row, size, print, bitmap, wide) of docs (row, text) connect."""
    shared = shared_prefixes(docs, nodes, write)
    fits = f"{WHOLE} * least(%s, %s) >= {PART} * greatest(%s, %s)"
    stars = shared.where("node <> least.node").where(fits % (("size", "least.size") * 2)).select(
        F.col("least.node").alias("a"), F.col("node").alias("b"))
    # The fingerprints' links: from each node to its fingerprint's smallest, and on to that of the linked ones.
    prints = write(nodes.groupBy("print").agg(F.min("node").alias("least")))
    forest = simhash.linked_prints(prints.select("print"))
    ends = [prints.select(F.col("print").alias(c), F.col("least").alias(f"node_{c}")) for c in "ab"]
    hashed = nodes.select("node", "print").join(prints, "print").where("node <> least").select(
        F.col("least").alias("a"), F.col("node").alias("b")).union(
            forest.join(ends[0], "a").join(ends[1], "b").select(
                F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))
    links = verified(stars.union(hashed), nodes, docs, write)

    def apart() -> DataFrame:
        """The shared shingles' rows, with the groups that the links so far make, where a shingle has more than one."""
        roots = components(links, write)
        grouped = shared.join(roots, "node", "left").select(
            "shingle", "node", "size", "n", F.coalesce("root", "node").alias("group"))
        several = grouped.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high")).where(
            "low <> high").select("shingle")
        return write(grouped.join(several, "shingle", "left_semi"))

    def tiled(rows: DataFrame, nearest: bool) -> DataFrame:
        """A shingle of many nodes: blocks by a hash of the node, and a tile for every two blocks."""
        blocks = F.ceil(F.col("n") / TILE).cast("int")
        many = rows.where(F.col("n") > FEW).join(nodes.select("node", "bitmap"), "node").select(
            "shingle", "node", "size", "group", "bitmap", blocks.alias("blocks"),
            F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
        dealt = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "shingle", "node", "size", "group", "bitmap", "block", F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"))
        return dealt.groupBy("shingle", "low", "high").applyInPandas(tile_pairs(nearest), "a long, b long")

    rest = apart()
    if not rest.where(F.col("n") > FEW).isEmpty():
        # Many near copies of one another are joined by a link each before the rest of their pairs would be listed.
        links = write(links.union(verified(tiled(rest, True), nodes, docs, write)))
        rest = apart()
    few = rest.where(F.col("n") <= FEW)
    pairs = few.alias("x").join(few.alias("y"), "shingle").where(
        "x.node < y.node and x.group <> y.group").where(fits % (("x.size", "y.size") * 2)).select(
            F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return links.union(verified(pairs.union(tiled(rest, False)), nodes, docs, write))


def chosen_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of docs (row, other, ...) that stands for each group, given the group of every row: rooted (row, doc_id, root).

    Documents that the filter of rows in groups of several does not let through are alone and stay where they are. The two
    hashes of a row, row and other, tell equal rows from others of the same first hash.
    """
    best = materialise(rooted.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("b"), F.count("*").alias("n")))
    several = key_filter(rooted.join(best.where("n > 1"), "root").select("row"))

    @F.pandas_udf("boolean")
    def is_open(row: pd.Series) -> pd.Series:
        return pd.Series(may_hold(several.value, row.to_numpy()))

    chosen = best.select(F.col("b.row").alias("row"))
    doubtful = docs.where(is_open("row")).join(chosen, "row", "left_semi").dropDuplicates(["row", "other"])
    return docs.where(~is_open("row")).union(doubtful)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hand BATCH_ROWS rows at a time to Python in the tables written inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of similar documents in docs (doc_id, text, ...), all columns as they are.

    It is a row with the group's smallest doc_id; of rows that share that id, or of a group without ids, the one with the
    smallest hash, and of equal ones any. Null and empty texts are similar to each other.
    """
    columns = docs.columns
    marked = docs.select(F.xxhash64(*columns).alias("row"), F.xxhash64(F.lit(1), *columns).alias("other"),
                         F.struct(*columns).alias("all"))
    named = marked.select("row", F.col("all.doc_id").alias("doc_id"), F.col("all.text").alias("text"))
    with small_batches(docs.sparkSession), Scratch(docs.sparkSession) as write:
        rows = write(arrow_map(
            named, node_rows, "row long, doc_id long, key binary, size int, print long, bitmap binary, wide binary"))
        nodes = write(rows.groupBy("key").agg(
            F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("size", "print", "bitmap", "wide")]).withColumn(
                "node", F.monotonically_increasing_id()))
        roots = components(linked_nodes(named, nodes, write), write)
        rooted = write(rows.select("row", "doc_id", "key").join(nodes.select("key", "node"), "key").join(
            roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("root")))
        kept = chosen_rows(marked, rooted)
    return kept.select("all.*")
