"""Exact interpolated percentiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridspark.session import materialise


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """`groups` plus one column per entry of `fractions` (name -> fraction), linear between ranks.

    Equal values collapse to counts first. The counts are dealt to ranges of (group, value) whose bounds
    follow the data, so no range is larger for outliers or a hot group. The sums of a group's ranges, a row each,
    tell which range holds a wanted rank; only those are then ranked value by value.
    """
    groups = list(groups)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    ranges = materialise(counts.repartitionByRange(*groups, "v").withColumn("part", F.spark_partition_id()))

    before = Window.partitionBy(*groups).orderBy("part")
    sums = ranges.groupBy(*groups, "part").agg(F.sum("c").alias("c"))
    sums = sums.withColumns({"end": F.sum("c").over(before), "n": F.sum("c").over(Window.partitionBy(*groups))})
    sums = sums.withColumn("begin", F.col("end") - F.col("c"))

    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("pos"))
        for name, q in fractions.items()
    ]))
    asked = sums.withColumn("_w", wanted).select(
        *groups, "part", "begin", "end", F.col("_w.name").alias("name"), F.col("_w.pos").alias("pos"))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    asked = asked.where("rank >= begin AND rank < end")

    inside = ranges.join(asked.select(*groups, "part", "begin").distinct(), [*groups, "part"])
    by_value = Window.partitionBy(*groups, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("last", F.col("begin") + F.sum("c").over(by_value)).select(
        *groups, "part", "v", (F.col("last") - F.col("c")).alias("first"), "last")
    hits = asked.join(inside, [*groups, "part"]).where("rank >= first AND rank < last")

    part = F.col("pos") - F.floor("pos")
    weight = F.when(part == 0, F.lit(1.0)).when(F.col("rank") == F.floor("pos"), 1 - part).otherwise(part)
    return hits.groupBy(*groups).agg(*[
        F.sum(F.when(F.col("name") == name, weight * F.col("v"))).alias(name) for name in fractions
    ])
