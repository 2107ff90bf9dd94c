"""Exact k nearest neighbours in projected metres, as equi-joins.

Step 1 puts sources and targets in square buckets sized from the source density, lists every
source under its own and the eight surrounding buckets, and reads a target's candidates from its
one bucket. A target is settled when its k-th distance does not reach beyond those nine buckets.

Step 2 takes the rest: targets in sparse areas, and all targets whose nine buckets hold more
sources than `max_block` (a hot spot). They walk down a pyramid of source counts, sixteen children
per node; at each level a node survives only if it can still hold one of the k nearest. The
bound is exact, so nothing is capped, and a target keeps few nodes however dense the hot spot is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridspark.functions.geo import albers_xy, distance, inverse_distance_weight
from gridspark.session import materialise

MAX_BLOCK = 256
# Up to this many sources every target simply looks at all of them.
DIRECT = 256
MAX_LEVEL = 26
STEPS_PER_TABLE = 4
# Levels that cannot hold more nodes than this, by their depth, are broadcast: every target starts at the root.
BROADCAST_NODES = 4**7


def with_xy(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add projected `x`, `y` in metres."""
    x, y = albers_xy(F.col(lat), F.col(lon))
    return df.withColumns({"x": x, "y": y})


def nearest(
    targets: DataFrame, sources: DataFrame, keys: Sequence[str], source_id: str, k: int = 4,
    max_block: int = MAX_BLOCK, direct: int = DIRECT,
) -> DataFrame:
    """`keys` plus `nn`, the k nearest sources as array<struct<dist, id>> by (dist, id).

    Both inputs carry x and y; `keys` are unique in `targets`. With fewer than k sources `nn`
    holds all there are. The table does not depend on the day: build it once and keep it.
    """
    points = sources.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(source_id).alias("id"), "x", "y")
    targets = targets.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, "x", "y")
    # One row of statistics.
    extent = points.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"),
    ).first()
    if extent.n <= direct:
        everything = points.agg(F.collect_list(F.struct("id", "x", "y")).alias("near")).scalar()
        return targets.withColumn("near", everything).select(*keys, _ranked("near", k).alias("nn"))
    # Of sources at one place only the k first by id can be among the nearest.
    place = Window.partitionBy("x", "y").orderBy("id")
    points = points.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n")
    side = max(extent.x1 - extent.x0, extent.y1 - extent.y0, 1.0)
    area = max(extent.x1 - extent.x0, side / extent.n) * max(extent.y1 - extent.y0, side / extent.n)
    size = math.sqrt(2 * k * area / (math.pi * extent.n))

    first = materialise(_by_block(targets, points, k, size, max_block))
    settled = first.where("settled").select(*keys, "nn")
    open_targets = first.where("NOT settled").select(*keys, "x", "y")
    if open_targets.isEmpty():
        return settled
    rest = _by_pyramid(open_targets, points, keys, k, extent, side, max_block)
    # A static table: users join it many times, so its plan ends here.
    return settled.unionByName(materialise(rest))


def _by_block(targets: DataFrame, points: DataFrame, k: int, size: float, max_block: int) -> DataFrame:
    bucket = lambda c: F.floor(F.col(c) / F.lit(size))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    copies = (
        points.withColumn("bx", bucket("x")).withColumn("by", bucket("y"))
        .withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        .select((F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by"), "id", "x", "y")
    )
    # Hot blocks are left out before anything is collected, so a list never exceeds max_block.
    hot = copies.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_block)
    blocks = (
        copies.join(hot.select("bx", "by"), ["bx", "by"], "left_anti")
        .groupBy("bx", "by").agg(F.collect_list(F.struct("id", "x", "y")).alias("near"))
    )
    placed = targets.withColumn("bx", bucket("x")).withColumn("by", bucket("y"))
    joined = placed.join(blocks, ["bx", "by"], "left")
    joined = joined.withColumn("nn", _ranked("near", k))
    border = F.least(
        F.col("x") - (F.col("bx") - 1) * size, (F.col("bx") + 2) * size - F.col("x"),
        F.col("y") - (F.col("by") - 1) * size, (F.col("by") + 2) * size - F.col("y"),
    )
    settled = F.coalesce(F.get("nn", F.lit(k - 1))["dist"] < border, F.lit(False))
    return joined.withColumn("settled", settled).drop("bx", "by", "near")


def _ranked(near: str, k: int) -> Column:
    """The first k of an array of sources by (distance, id)."""
    found = F.transform(near, lambda s: F.struct(
        distance(F.col("x"), F.col("y"), s["x"], s["y"]).alias("dist"), s["id"].alias("id")))
    return F.slice(F.sort_array(found), 1, k)


def _by_pyramid(
    targets: DataFrame, points: DataFrame, keys: Sequence[str], k: int, extent, side: float, max_block: int
) -> DataFrame:
    def cell(axis: str, origin: float, level: int) -> Column:
        raw = F.floor((F.col(axis) - F.lit(origin)) / F.lit(side / 2**level))
        return F.when(raw >= 2**level, F.lit(2**level - 1)).otherwise(raw)

    def at_level(level: int) -> DataFrame:
        return points.withColumns({"ix": cell("x", extent.x0, level), "iy": cell("y", extent.y0, level)})

    # The depth at which every leaf is small, found from one-row maxima.
    depth = max(1, math.ceil(math.log(max(extent.n / max_block, 1), 4)))
    while extent.n > max_block and depth < MAX_LEVEL:
        fullest = at_level(depth).groupBy("ix", "iy").count().agg(F.max("count")).first()[0]
        if fullest <= max_block:
            break
        depth = min(MAX_LEVEL, depth + 2)

    leaves = at_level(depth)
    # Every second level, from the leaves up: sixteen children per node and half the passes. The lowest is
    # written, since all others and the walk read it.
    levels = list(range(depth, 0, -2))
    nodes = [materialise(leaves.groupBy("ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("xa"), F.max("x").alias("xb"),
        F.min("y").alias("ya"), F.max("y").alias("yb"),
    ))]
    for _ in levels[1:]:
        nodes.append(
            nodes[-1].groupBy(F.shiftright("ix", 2).alias("ix"), F.shiftright("iy", 2).alias("iy")).agg(
                F.sum("n").alias("n"), F.min("xa").alias("xa"), F.max("xb").alias("xb"),
                F.min("ya").alias("ya"), F.max("yb").alias("yb"),
            )
        )

    frontier = targets.withColumns({"px": F.lit(0).cast("bigint"), "py": F.lit(0).cast("bigint")})
    by_far = Window.partitionBy(*keys).orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_target = Window.partitionBy(*keys)
    for step, (depth_here, level) in enumerate(zip(reversed(levels), reversed(nodes)), start=1):
        # The first step goes down one or two levels from the root.
        down = depth_here if step == 1 else 2
        children = level.withColumns({"px": F.shiftright("ix", down), "py": F.shiftright("iy", down)})
        if 4**depth_here <= BROADCAST_NODES:
            children = F.broadcast(children)
        opened = frontier.join(children, ["px", "py"]).withColumns({
            "close": F.hypot(_gap("x", "xa", "xb"), _gap("y", "ya", "yb")),
            "far": F.hypot(_reach("x", "xa", "xb"), _reach("y", "ya", "yb")),
        })
        # The k nearest lie within the smallest radius whose fully enclosed nodes hold k sources.
        opened = opened.withColumn("held", F.sum("n").over(by_far))
        opened = opened.withColumn("radius", F.min(F.when(F.col("held") >= k, F.col("far"))).over(per_target))
        frontier = opened.where("radius IS NULL OR close <= radius").select(
            *keys, "x", "y", F.col("ix").alias("px"), F.col("iy").alias("py")
        )
        if step % STEPS_PER_TABLE == 0:
            frontier = materialise(frontier)

    inside = leaves.select(F.col("ix").alias("px"), F.col("iy").alias("py"), "id",
                           F.col("x").alias("sx"), F.col("y").alias("sy"))
    found = frontier.join(inside, ["px", "py"]).withColumn(
        "dist", distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")))
    order = Window.partitionBy(*keys).orderBy("dist", "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # At most k entries per target.
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("nn"))


def _gap(v: str, low: str, high: str) -> Column:
    """Distance along one axis to a box; 0 inside."""
    return F.when(F.col(v) < F.col(low), F.col(low) - F.col(v)).when(
        F.col(v) > F.col(high), F.col(v) - F.col(high)).otherwise(F.lit(0.0))


def _reach(v: str, low: str, high: str) -> Column:
    """Distance along one axis to the far side of a box."""
    return F.greatest(F.abs(F.col(v) - F.col(low)), F.abs(F.col(v) - F.col(high)))


def neighbour_rows(neighbours: DataFrame, keys: Sequence[str], source_id: str) -> DataFrame:
    """One row per target and neighbour: keys, rank 1..k, source id, dist, nearest_m."""
    return neighbours.select(
        *keys, F.get("nn", F.lit(0))["dist"].alias("nearest_m"), F.posexplode("nn").alias("rank", "_s")
    ).select(
        *keys, (F.col("rank") + 1).alias("rank"), F.col("_s.id").alias(source_id),
        F.col("_s.dist").alias("dist"), "nearest_m",
    )


def nearest_one(
    targets: DataFrame, sources: DataFrame, keys: Sequence[str], source_id: str, dist: str = "dist_m"
) -> DataFrame:
    """Targets with the id of and distance to their nearest source."""
    nn = nearest(targets, sources, keys, source_id, k=1)
    found = nn.select(*keys, F.get("nn", F.lit(0))["id"].alias(source_id), F.get("nn", F.lit(0))["dist"].alias(dist))
    return targets.join(found, list(keys))


def weighted(rows: DataFrame, power: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Add the inverse-distance weight `w` to neighbour rows."""
    return rows.withColumn("w", inverse_distance_weight(F.col("dist"), power, eps))
