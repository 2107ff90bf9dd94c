"""Near-duplicate documents by 64-bit SimHash fingerprints, searched with vantage-point trees.

Equal fingerprints are one node. A tree of vantage points, built on a bounded sample, cuts the
fingerprints into shards by Hamming distance: near a vantage point (distance up to the sample's
median) or far. A fingerprint lives in one shard. It is also sent to every shard that its ball of the link
radius reaches: by the triangle inequality the partners of a near one at distance d from a vantage point
are far ones only if d is within the radius of the border. Of two linked fingerprints that part at
a vantage point the near one visits the far one's shard, so each pair meets exactly once. Inside a
shard the same rule prunes further vantage points until few enough are left to compare.

A shard hands on a spanning forest of its links, at most one edge per fingerprint, not the links
themselves, so a large group of near copies stays linear.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, components, local_components, texts
from gridspark.session import materialise

WORDS_PER_SHINGLE = 3
HASH_SEED = 42
RADIUS = 3

# Fingerprints per shard aimed at, sampled fingerprints per shard, and the largest sample. The sample shapes
# the tree only; every fingerprint is searched.
SHARD = 4096
SAMPLE_PER_SHARD = 64
SAMPLE_MOST = 500_000
# Pairs compared at a time inside a shard.
DIRECT = 1 << 20


def fingerprint(text: str) -> int:
    """Bit majority of the hashes of the text's word shingles; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS_PER_SHINGLE + 1)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends[WORDS_PER_SHINGLE - 1:] - 1).tolist() if len(words) >= WORDS_PER_SHINGLE else [len(joined)]
    starts = [0, *ends[:n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, last)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 16_384):
        part = hashes[at:at + 16_384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def print_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the fingerprint, as a signed 64-bit integer, in the place of the text."""
    found = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
    place = batch.schema.get_field_index("text")
    return batch.set_column(place, "print", pa.array(found))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): print is the fingerprint as a signed 64-bit integer."""
    return arrow_map(docs.select("doc_id", "text"), print_rows, "doc_id long, print long")


@dataclass
class Node:
    """Inner node: a vantage point and the border; leaf: its shard number."""

    shard: int = -1
    point: np.uint64 = np.uint64(0)
    border: int = 0
    near: Node | None = None
    far: Node | None = None


def distance(prints: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ point)


def build_tree(sample: np.ndarray, shards: int, seed: int = 7) -> Node:
    """Vantage-point tree with about `shards` leaves."""
    rng = np.random.default_rng(seed)
    leaves = 0

    def grow(part: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        if depth and len(part) > 1:
            # The candidate whose distances spread most leaves the fewest near the border.
            points = part[rng.integers(0, len(part), 8)]
            spread = [distance(part, p).std() for p in points]
            point = points[int(np.argmax(spread))]
            d = distance(part, point)
            border = int(np.median(d))
            inside = d <= border
            if inside.any() and not inside.all():
                return Node(-1, point, border, grow(part[inside], depth - 1), grow(part[~inside], depth - 1))
        leaves += 1
        return Node(leaves - 1)

    return grow(sample, max(0, math.ceil(math.log2(max(1, shards)))))


def route(tree: Node, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, print, home) rows: the home of every print, and the shards that it visits."""
    out: list[tuple[int, np.ndarray, bool]] = []

    def down(node: Node, part: np.ndarray, home: bool) -> None:
        if not len(part):
            return
        if node.near is None:
            out.append((node.shard, part, home))
            return
        d = distance(part, node.point)
        if home:
            down(node.near, part[d <= node.border], True)
            down(node.far, part[d > node.border], True)
            down(node.far, part[(d <= node.border) & (d > node.border - radius)], False)
        else:
            down(node.near, part[d <= node.border + radius], False)
            down(node.far, part[d > node.border - radius], False)

    down(tree, prints, True)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    sizes = [len(p) for _, p, _ in out]
    return (np.repeat([s for s, _, _ in out], sizes).astype(np.int64), np.concatenate([p for _, p, _ in out]),
            np.repeat([h for _, _, h in out], sizes))


def close_pairs(homes: np.ndarray, others: np.ndarray, radius: int, seed: int = 3):
    """Yields index arrays (i of homes, j of others) of all pairs within the radius."""
    rng = np.random.default_rng(seed)
    stack = [(np.arange(len(homes)), np.arange(len(others)), 0)]
    while stack:
        a, b, stuck = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) > DIRECT and len(a) > 64 and stuck < 3:
            point = homes[a[int(rng.integers(0, len(a)))]]
            da, db = distance(homes[a], point), distance(others[b], point)
            border = int(np.median(da))
            inside = da <= border
            stuck = 0 if inside.sum() < 0.9 * len(a) else stuck + 1
            stack.append((a[inside], b[db <= border + radius], stuck))
            stack.append((a[~inside], b[db > border - radius], stuck))
            continue
        step = max(1, DIRECT // len(a))
        for at in range(0, len(b), step):
            part = b[at:at + step]
            i, j = np.nonzero(np.bitwise_count(homes[a][:, None] ^ others[part][None, :]) <= radius)
            if len(i):
                yield a[i], part[j]


def shard_forest(homes: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (print, smallest print of its group in this shard) that connect what the shard's links connect."""
    others = np.concatenate([homes, visitors])
    n = len(others)
    root = np.arange(n)
    for i, j in close_pairs(homes, others, radius):
        different = i != j
        if not different.any():
            continue
        i, j = i[different], j[different]
        # Fold the links found so far into one root per print before the next block.
        root = local_components(n, np.concatenate([np.arange(n), i]), np.concatenate([root, j]))
    linked = np.flatnonzero(root != np.arange(n))
    return others[linked], others[root[linked]]


def linked_prints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning edges (a, b) of the links between distinct fingerprints `nodes` (print)."""
    spark = nodes.sparkSession
    count = nodes.count()
    shards = max(1, math.ceil(count / SHARD))
    wanted = min(SAMPLE_MOST, shards * SAMPLE_PER_SHARD)
    # Fingerprints chosen by a hash of their own: the same ones wherever they are stored.
    share = min(1.0, 1.2 * wanted / max(1, count))
    sample = nodes.where(F.pmod(F.xxhash64("print"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * wanted)
    points = np.sort(sample.toPandas()["print"].to_numpy(np.int64).view(np.uint64))
    tree = spark.sparkContext.broadcast(build_tree(points, shards))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        shard, found, home = route(tree.value, prints, radius)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard), pa.array(found.view(np.int64)), pa.array(home)], names=["shard", "print", "home"])

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prints = rows["print"].to_numpy(np.int64).view(np.uint64)
        home = rows["home"].to_numpy(bool)
        a, b = shard_forest(prints[home], prints[~home], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = arrow_map(nodes, spread, "shard long, print long, home boolean")
    # A shard whose fingerprints no vantage point parts stays larger; its visitors are dealt to tiles, and its
    # own fingerprints go to each of them.
    sizes = routed.groupBy("shard").agg(F.count("*").alias("size"))
    tiles = sizes.select("shard", F.ceil(F.col("size") / (64 * SHARD)).cast("int").alias("tiles"))
    dealt = routed.join(tiles, "shard").select(
        "shard", "print", "home",
        F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")))).alias("tile"))
    return dealt.groupBy("shard", "tile").applyInPandas(search, "a long, b long")


def component_of_prints(prints: DataFrame, radius: int) -> DataFrame:
    """(print, component_id) of each distinct fingerprint of prints (doc_id, print)."""
    nodes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(linked_prints(nodes.select("print"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(first, "root").select("print", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most `radius` bits are linked; component_id is the smallest doc_id
    reachable by links, itself included. A null or empty text has fingerprint zero and is linked like
    any other. Null doc_ids take part but never name a component, unless it has no other (then null). Repeated
    doc_ids stay rows of their own, other columns of docs are ignored, an empty table gives an empty one.
    """
    prints = materialise(fingerprints(docs))
    named = component_of_prints(prints, radius)
    return prints.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates in docs (doc_id, text, ...), all columns as they are.

    It is a row with the group's smallest doc_id; of rows that share that id, or of a group without ids, the one with
    the smallest text hash, and of equal ones any.
    """
    marked = docs.select("doc_id", "text", F.xxhash64(*docs.columns).alias("row_hash"))
    prints = materialise(arrow_map(marked, print_rows, "doc_id long, print long, row_hash long"))
    named = component_of_prints(prints.select("doc_id", "print"), radius)
    return chosen_rows(docs, prints.join(named, "print").select("doc_id", "row_hash", "root"))


def chosen_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of docs that stands for each group, given the group of every row: rooted (doc_id, row_hash, root)."""
    columns = docs.columns
    best = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("b"))
    chosen = best.select(F.col("b.doc_id").alias("chosen_id"), F.col("b.row_hash").alias("row_hash"))
    hashed = docs.withColumn("row_hash", F.xxhash64(*columns))
    joined = hashed.join(
        chosen, hashed["doc_id"].eqNullSafe(chosen["chosen_id"]) & (hashed["row_hash"] == chosen["row_hash"]), "left_semi")
    # Only rows that are equal in every column can be chosen twice; without any the texts need no second exchange.
    if not rooted.groupBy("doc_id", "row_hash").count().where("count > 1").isEmpty():
        joined = joined.dropDuplicates(["doc_id", "row_hash"])
    return joined.select(*columns)
