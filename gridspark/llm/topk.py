"""Exact top-k by integer inner product, as a Voronoi kNN join.

With one more component, sqrt(M^2 - |x|^2) for data and 0 for queries, M the longest data vector, the
largest inner products are the smallest distances: |q' - x'|^2 = |q|^2 + M^2 - 2 qx. Queries and data are
grouped by their nearest pivot. A summary of each data group, its smallest distances to its pivot, gives by
the triangle inequality a distance within which every query of a group has enough data; a data row goes
to a query group only if its distance to its own pivot lets it be that near. Query groups that lie together share
a bin, to which a row that any of them needs is sent once; a bin is solved in tiles of bounded size, and the tiles'
best rows are ranked once more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map
from gridspark.session import materialise

SCALE = 256
# Pivots: about the fourth root of the rows times four, within these limits. The sample they are chosen from.
PIVOTS_LEAST, PIVOTS_MOST = 4, 256
PIVOT_SAMPLE = 4096
# Rows of a tile.
TILE_DATA, TILE_QUERIES = 2_500, 2_000
EXACT_FLOAT = 2.0 ** 53
INT_LIMIT = 2.0 ** 62


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): components floor(SCALE * x) as packed 64-bit integers; unusable rows are left out."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, dims, packed = [], [], []
        for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            if vec_id is None or not x or any(c is None for c in x):
                continue
            scaled = np.floor(SCALE * np.array(x, np.float64))
            if np.isfinite(scaled).all() and (np.abs(scaled) < INT_LIMIT).all():
                ids.append(vec_id)
                dims.append(len(x))
                packed.append(scaled.astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())],
            names=["vec_id", "dim", "vec"])

    return arrow_map(df.select("vec_id", "embedding"), pack, "vec_id long, dim int, vec binary")


def unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(-1, dim)


def lifted(x: np.ndarray, longest: float | None) -> np.ndarray:
    """x' of data when the longest squared length is given, else q' of queries."""
    x = x.astype(np.float64)
    last = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))
    return np.column_stack([x, last])


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows, pivots)."""
    out = np.empty((len(x), len(pivots)))
    for n, p in enumerate(pivots):
        out[:, n] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through floats where these are exact."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT_FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_rows(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of each row's k largest scores; of equal ones the first."""
    out = []
    for row in scores:
        if len(row) <= k:
            out.append(np.arange(len(row)))
            continue
        least = np.partition(row, len(row) - k)[len(row) - k]
        above = np.flatnonzero(row > least)
        equal = np.flatnonzero(row == least)[:k - len(above)]
        out.append(np.concatenate([above, equal]))
    return out


def knn_join(rows: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    """Top k of each query of one dimension. rows (row, vec_id, vec), materialised."""
    spark = rows.sparkSession
    total = rows.count()

    def lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unpack(batch.column("vec").to_pylist(), dim).astype(np.float64)
        return pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max())])], names=["longest"])

    longest = arrow_map(rows.select("vec"), lengths, "longest double").agg(F.max("longest")).first()[0]
    sample = rows.orderBy(F.xxhash64("vec", "row")).select("vec").limit(PIVOT_SAMPLE).toPandas()
    points = lifted(unpack(sample["vec"], dim), longest)
    pivots = choose_pivots(points, int(min(PIVOTS_MOST, max(PIVOTS_LEAST, 4 * total ** 0.25))))
    between = to_pivots(pivots, pivots)
    shared = spark.sparkContext.broadcast(pivots)

    def group(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unpack(batch.column("vec").to_pylist(), dim)
        ids = batch.column("vec_id").to_numpy()
        d = to_pivots(lifted(x, longest), shared.value)
        q = to_pivots(lifted(x, None), shared.value)
        own, query = d.argmin(axis=1), ids % every == 0
        asked = np.where(query, q.argmin(axis=1), -1)
        at = np.arange(len(x))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("row", "vec_id", "vec")], pa.array(own.astype(np.int32)),
             pa.array(d[at, own]), pa.array(asked.astype(np.int32)), pa.array(q[at, asked])],
            names=["row", "vec_id", "vec", "own", "away", "asked", "reach"])

    grouped = materialise(arrow_map(
        rows, group, "row long, vec_id long, vec binary, own int, away double, asked int, reach double"))
    # The smallest distances of each data group, through a window that keeps k + 1 rows a group and task.
    ranked = grouped.select("own", "away", "row").withColumn(
        "nth", F.row_number().over(Window.partitionBy("own").orderBy("away", "row"))).where(F.col("nth") <= k + 1)
    summary = ranked.select("own", "away").toPandas()
    asked = grouped.where("asked >= 0").groupBy("asked").agg(
        F.max("reach").alias("reach"), F.count("*").alias("n")).toPandas()
    slack = 1e-9 * (1.0 + float(longest) ** 0.5)
    reach, within, queries = {}, {}, {}
    for i, far, n in asked.itertuples(index=False):
        bounds = np.sort(far + between[i, summary["own"].to_numpy(int)] + summary["away"].to_numpy(float))
        # One more than k: a query's own row may be among them.
        within[int(i)] = float(bounds[k]) if len(bounds) > k else float("inf")
        reach[int(i)], queries[int(i)] = float(far), int(n)
    bins = bins_of(queries, between)
    plan = spark.sparkContext.broadcast((between, reach, within, slack, bins))

    def needed(batch: pa.RecordBatch) -> pa.RecordBatch:
        gap, far, bound, extra, groups = plan.value
        own = batch.column("own").to_numpy()
        away = batch.column("away").to_numpy()
        parts, targets = [], []
        for n, members in enumerate(groups):
            near = np.zeros(len(own), bool)
            for i in members:
                near |= np.abs(gap[i, own] - away) <= far[i] + bound[i] + extra
            hit = np.flatnonzero(near)
            parts.append(hit)
            targets.append(np.full(len(hit), n, np.int32))
        pick = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        target = pa.array(np.concatenate(targets) if targets else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pick) for c in ("row", "vec_id", "vec")], target],
            names=["row", "vec_id", "vec", "target"])

    sent = arrow_map(grouped.select("row", "vec_id", "vec", "own", "away"), needed,
                     "row long, vec_id long, vec binary, target int")
    blocks = max(1, -(-total // TILE_DATA))
    # Tiles of each bin, and the bin of each pivot, looked up by number; both lists are as short as the pivots'.
    tiles = [-(-sum(queries[i] for i in members) // TILE_QUERIES) for members in bins] or [1]
    count = F.get(F.array(*[F.lit(n) for n in tiles]), F.col("target"))
    bin_of = [next((n for n, members in enumerate(bins) if i in members), 0) for i in range(len(pivots))]
    target = F.get(F.array(*[F.lit(n) for n in bin_of]), F.col("asked"))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    data = sent.select(
        "row", "vec_id", "vec", "target", F.lit(False).alias("query"),
        F.explode(F.sequence(F.lit(0), count - 1)).alias("tile"),
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    asking = grouped.where("asked >= 0").withColumn("target", target).select(
        "row", "vec_id", "vec", "target", F.lit(True).alias("query"),
        F.pmod(F.xxhash64("row"), count).cast("int").alias("tile"), F.explode(numbers).alias("block"))

    def solve(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["vec_id", "row"])
        q, x = tile[tile["query"]], tile[~tile["query"]]
        out = []
        if len(q) and len(x):
            a, b = unpack(q["vec"], dim), unpack(x["vec"], dim)
            rows_x, ids = x["row"].to_numpy(), x["vec_id"].to_numpy()
            for at in range(0, len(a), 128):
                own = q["row"].to_numpy()[at:at + 128]
                scores = products(a[at:at + 128], b)
                # One more than k, so that the query's own row can go.
                for n, best in enumerate(best_rows(scores, k + 1)):
                    best = best[rows_x[best] != own[n]]
                    out.append(pd.DataFrame({
                        "row": own[n], "query_id": q["vec_id"].to_numpy()[at + n], "vec_id": ids[best],
                        "score": scores[n, best]}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: pd.Series(dtype="int64") for c in ("row", "query_id", "vec_id", "score")})

    found = data.union(asking).groupBy("target", "tile", "block").applyInPandas(
        solve, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def bins_of(queries: dict[int, int], between: np.ndarray) -> list[list[int]]:
    """Query groups (numbers with their sizes) in bins of about a tile: from group to nearest group not yet placed."""
    left, bins = set(queries), []
    at = min(left, default=None)
    size = TILE_QUERIES
    while left:
        if size + queries[at] > TILE_QUERIES:
            bins.append([])
            size = 0
        bins[-1].append(at)
        size += queries[at]
        left.discard(at)
        at = min(left, key=lambda i: (between[at, i], i), default=None)
    return bins


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n points of the sample, each the farthest from those before it."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def top_k(df: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k rows with the largest integer inner product of each query: query_id, rank (from 1), vec_id, score.

    df has vec_id and embedding. Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but
    the query's own one; fewer candidates give fewer rows, equal scores the smaller vec_id first. Rows take no part
    whose vec_id or embedding is null or empty, or that hold null, non-finite or (scaled) over 62-bit components.
    Vectors of different dimension never meet. Rows that repeat a vec_id are queries and candidates of their own;
    other columns are ignored; an empty table gives an empty one.
    """
    rows = materialise(vectors(df).withColumn("row", F.monotonically_increasing_id()))
    dims = sorted(r[0] for r in rows.select("dim").distinct().collect())
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for dim in dims:
        part = rows.where(F.col("dim") == dim).select("row", "vec_id", "vec")
        out = out.union(knn_join(part, dim, every, k)) if len(dims) > 1 else knn_join(part, dim, every, k)
    return out
