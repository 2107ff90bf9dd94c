"""Checks that report their findings as rows, and assertions that fail the job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def uncovered(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` whose key is not in `lookup`."""
    return df.join(lookup.select(*keys), list(keys), "left_anti")


def require_none(problems: DataFrame, message: str) -> None:
    """Raise when `problems` has any row, quoting a few."""
    sample = problems.limit(5).collect()
    if sample:
        raise ValueError(f"{message}: {[tuple(r) for r in sample]}")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    require_none(duplicate_keys(df, keys), f"duplicate {', '.join(keys)} in {what}")
    return df


def require_covered(df: DataFrame, lookup: DataFrame, keys: Sequence[str], what: str = "lookup") -> DataFrame:
    require_none(uncovered(df, lookup, keys), f"{what} does not cover all {', '.join(keys)}")
    return df


def worst_groups(df: DataFrame, bad, group: str, n: int = 10) -> DataFrame:
    """The `n` groups with the most rows satisfying `bad`: a top-k report."""
    return (
        df.where(bad).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), group).limit(n)
    )


def match_rate(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows seen, rows whose key is in `lookup`, and their share."""
    marked = df.select(*keys).join(
        lookup.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left"
    )
    return marked.agg(
        F.count(F.lit(1)).alias("rows_seen"), F.count("_hit").alias("rows_matched")
    ).withColumn("match_rate", F.try_divide(F.col("rows_matched").cast("double"), F.col("rows_seen")))


def needed_inputs(days: DataFrame, same_day: Sequence[str], two_days: Sequence[str], day: str = "prism_day") -> DataFrame:
    """(day, layer, d): the layers that each labelled day needs, `same_day` layers of the day itself, `two_days`
    layers of it and the day before."""
    def pairs(layers: Sequence[str], offset: int) -> list[Column]:
        return [F.struct(F.lit(v).alias("layer"), F.date_sub(day, offset).alias("d")) for v in layers]

    needed = F.array(*pairs(same_day, 0), *pairs(two_days, 0), *pairs(two_days, 1))
    return days.select(day, F.explode(needed).alias("_n")).select(day, "_n.layer", "_n.d").distinct()


def watched(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df and an observation of the aggregates `counts`, taken while the job that first runs df runs; its `get` waits for that job.

    What would need a scan of its own comes with the rows as they pass.
    """
    observation = Observation()
    return df.observe(observation, *[value.alias(name) for name, value in counts.items()]), observation


def match_counts(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Observation]:
    """Rows whose key is in `lookup`, and an observation of rows_seen and rows_matched."""
    marked = rows.join(lookup.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left")
    seen, counts = watched(marked, rows_seen=F.count(F.lit(1)), rows_matched=F.count("_hit"))
    return seen.where("_hit").drop("_hit"), counts


def missing_inputs(
    days: DataFrame, available: DataFrame, same_day: Sequence[str], two_days: Sequence[str], day: str = "prism_day"
) -> DataFrame:
    """(layer, day) pairs a run over `days` needs and `available` lacks."""
    expected = needed_inputs(days, same_day, two_days, day).select("layer", "d").distinct()
    # Rows of one layer and day meet in one task; distinct ones are combined before they are sent there.
    return expected.join(available.select("layer", "d").distinct(), ["layer", "d"], "left_anti")


def layer_fingerprints(df: DataFrame, layer: str, day: str = "d") -> DataFrame:
    """(layer, d, fingerprint): what a layer holds of each day, whatever the order and files of its rows.

    The number of rows with two sums of row hashes; columns count by name, and a repeated row counts.
    """
    columns = sorted(c for c in df.columns if c != day)
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return df.groupBy(F.col(day).alias("d")).agg(
        F.concat_ws(".", F.count(F.lit(1)), total(0), total(1)).alias("fingerprint")
    ).select(F.lit(layer).alias("layer"), "d", "fingerprint")


def input_fingerprints(
    days: DataFrame, known: DataFrame, same_day: Sequence[str], two_days: Sequence[str], day: str = "prism_day"
) -> DataFrame:
    """(day, fingerprint) of all inputs of each labelled day, given those of the layers: known (layer, d, fingerprint).

    A layer that is not there takes part as such, so its arrival is a change. A group is the layers of one day.
    """
    each = needed_inputs(days, same_day, two_days, day).join(known, ["layer", "d"], "left")
    part = F.concat_ws("|", "layer", F.col("d").cast("string"), F.coalesce("fingerprint", F.lit("none")))
    return each.groupBy(day).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(part)), ","), 256).alias("fingerprint"))


def days_to_run(
    days: DataFrame, finished: DataFrame, overwrite: bool = False, keys: Sequence[str] = ("prism_day",)
) -> DataFrame:
    """Requested days without a finished result; all of them with `overwrite`.

    `keys` name what makes a result; a NULL among them equals a NULL.
    """
    if overwrite:
        return days
    done = finished.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return days.join(done, same, "left_anti")
