"""Bringing layers onto common keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.quality import require_unique


def align_to_sources(sources: DataFrame, layer: DataFrame, keys: Sequence[str], unique_on: Sequence[str]) -> DataFrame:
    """Every source with its layer values, NULL where the layer lacks it; duplicates are an error."""
    return sources.select(*keys).join(require_unique(layer, unique_on, "layer"), list(keys), "left")


def common_keys(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys present in every layer."""
    common = layers[0].select(*keys)
    for layer in layers[1:]:
        common = common.intersect(layer.select(*keys))
    return common.distinct()


def align_layers(layers: Mapping[str, DataFrame], keys: Sequence[str], everywhere: bool = True, unique: bool = False) -> DataFrame:
    """Alignment of single-value layers: keys plus one column per layer.

    The layers are stacked and aggregated, so any number of them costs one shuffle that combines
    first; a chain of joins would need one per layer. With `everywhere` keys missing from
    a layer drop out, else they stay with NULL. With `unique` a key repeated within a layer is an error, else
    its largest value counts.
    """
    names = list(layers)
    stacked = None
    for position, name in enumerate(names):
        values = [
            (F.col(name).cast("double") if n == name else F.lit(None).cast("double")).alias(n) for n in names
        ]
        rows = layers[name].select(*keys, F.lit(1 << position).cast("bigint").alias("_seen"), *values)
        stacked = rows if stacked is None else stacked.unionByName(rows)
    aligned = stacked.groupBy(*keys).agg(
        F.bit_or("_seen").alias("_seen"), F.count(F.lit(1)).alias("_rows"), *[F.max(n).alias(n) for n in names])
    if unique:
        repeated = F.raise_error(F.concat(F.lit(f"duplicate {', '.join(keys)} in one of: {', '.join(names)}")))
        aligned = aligned.where(F.when(F.col("_rows") == F.bit_count("_seen"), F.lit(True)).otherwise(repeated.cast("boolean")))
    if everywhere:
        aligned = aligned.where(F.col("_seen") == (1 << len(names)) - 1)
    return aligned.drop("_seen", "_rows")


def join_layers(layers: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that every layer has, with one column per layer, by sort-merge joins in a row.

    For layers stored in buckets of `keys` (see `write_bucketed`): these joins need no exchange. Other layers go to `align_layers`.
    """
    joined = None
    for name, layer in layers.items():
        rows = layer.select(*keys, name)
        joined = rows if joined is None else joined.join(rows.hint("merge"), list(keys))
    return joined
