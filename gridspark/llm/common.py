"""Helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.session import materialise


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Run `function` on every non-empty Arrow batch inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def limit_batches(spark: SparkSession, rows: int) -> None:
    """Hand at most `rows` rows at a time to Python from now on. Frames that are written later take it from the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    # 0 or less is no limit.
    if before <= 0 or before > rows:
        spark.conf.set(name, str(rows))


def record_batch(**columns) -> pa.RecordBatch:
    """A batch from (values, type) pairs or ready arrays."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v[0], v[1]) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]



def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, for undirected edges a-b; vectorised label passing."""
    root = np.arange(n)
    while a.size:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
    return root


# Bits of a filter of keys, whatever the number of keys, and bits set for each.
FILTER_BITS, FILTER_HASHES = 1 << 24, 4


def filter_places(keys: np.ndarray) -> np.ndarray:
    """Bit numbers of 64-bit keys, FILTER_HASHES for each."""
    x = keys.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return (x[:, None] + np.arange(FILTER_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(FILTER_BITS)


def key_filter(keys: DataFrame):
    """Broadcast Bloom filter, of fixed size, of the one column of `keys` (long). The more keys, the more others it lets through."""
    name = keys.columns[0]

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = np.unique(filter_places(batch.column(0).to_numpy(zero_copy_only=False)))
        word, at = np.unique(places >> np.uint64(6), return_index=True)
        value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), at)
        return record_batch(word=pa.array(word.astype(np.int64)), bits=pa.array(value.view(np.int64)))

    words = arrow_map(keys.where(F.col(name).isNotNull()), bits, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toPandas()
    field = np.zeros(FILTER_BITS // 64, np.uint64)
    field[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(field)


def may_hold(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter lets each key through: all that are in it, and some others."""
    places = filter_places(np.asarray(keys))
    return ((field[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(axis=1)


def components(edges: DataFrame, write: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, root) per node of an edge, root
    the smallest node reachable. Alternating large-star and small-star rounds until nothing moves;
    every round is written to the checkpoint folder, and a star's centre is a joined row, never a
    collected list, so a component of any size stays spread. `write` writes the rounds' tables.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = write(ordered.distinct())
    mark = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = write(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
