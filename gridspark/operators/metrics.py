"""Error statistics of predictions against observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.percentile import exact_percentiles
from gridspark.session import materialise

# Display names of the variables.
VARIABLE_LABELS = {
    "temp_C": "Air temperature (°C)",
    "ea_hPa": "Vapor pressure (hPa)",
    "rh_pct": "Relative humidity (%)",
    "HI_C": "Heat Index (°C)",
    "WBGT_C": "Wet-Bulb Globe Temperature (°C)",
    "TMRT_C": "Mean radiant temperature (°C)",
    "UTCI_C": "UTCI (°C)",
}

_SUMS = ("n", "e", "a", "q")


def variable_label(variable: Column) -> Column:
    pairs = [F.lit(x) for item in VARIABLE_LABELS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), variable), variable)


def match_pairs(predictions: DataFrame, observations: DataFrame, keys: Sequence[str] = ("station_id", "time_utc")) -> DataFrame:
    """Inner match of predictions and observations, many to many."""
    return predictions.join(observations, list(keys))


def match_paired(
    first: DataFrame, second: DataFrame, observations: DataFrame, required: Sequence[str],
    product_keys: Sequence[str] = ("station_id", "time_utc", "prism_day"),
    keys: Sequence[str] = ("station_id", "time_utc"),
) -> DataFrame:
    """Rows of two products and one observation with every required value present."""
    merged = first.join(second, list(product_keys)).join(observations, list(keys))
    return merged.dropna(subset=[c for c in required if c in merged.columns])


def error_columns(
    pairs: DataFrame, variables: Sequence[str], pred_suffix: str, obs_suffix: str = "_obs"
) -> dict[str, tuple[str, str]]:
    """variable -> (prediction, observation) column; variables without both are skipped."""
    names = {v: (f"{v}{pred_suffix}", f"{v}{obs_suffix}") for v in variables}
    return {v: both for v, both in names.items() if set(both) <= set(pairs.columns)}


def error_sums(pairs: DataFrame, groups: Sequence[str], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Count, sum, absolute sum and square sum of every error per group, in one pass.

    All statistics derive from these sums, so the pairs are scanned and shuffled once however
    many summaries are asked for.
    """
    if not columns:
        raise ValueError("no variable has both a prediction and an observation column")
    aggregates = []
    for label, (predicted, observed) in columns.items():
        error = F.col(predicted) - F.col(observed)
        sums = (F.count(error), F.sum(error), F.sum(F.abs(error)), F.sum(error * error))
        aggregates += [agg.alias(f"{label}__{s}") for s, agg in zip(_SUMS, sums)]
    return pairs.groupBy(*groups).agg(*aggregates)


def by_variable(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unpivot error sums to one row per key and variable, with columns var, n, e, a, q."""
    names = [c[:-3] for c in sums.columns if c.endswith("__n")]
    packed = F.array(*[
        F.struct(F.lit(v).alias("var"), *[F.col(f"{v}__{s}").alias(s) for s in _SUMS]) for v in names
    ])
    return sums.select(*keys, F.explode(packed).alias("_v")).select(*keys, "_v.*")


def finish(sums: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """N, bias, mae, rmse from summed rows; NULL statistics where N is 0."""
    n = F.col("n")
    name = lambda s: f"{prefix}_{s}" if prefix else s
    return sums.select(
        *keys, n.alias(name("N")), F.try_divide(F.col("e"), n).alias(name("bias")),
        F.try_divide(F.col("a"), n).alias(name("mae")), F.sqrt(F.try_divide(F.col("q"), n)).alias(name("rmse")),
    )


def metrics_suite(
    pairs: DataFrame, variables: Sequence[str], prefix: str, pred_suffix: str | None = None,
    obs_suffix: str = "_obs", station: str = "station_id", day: str = "prism_day", store: bool = True,
) -> dict[str, DataFrame]:
    """`overall`, `by_station` and `by_day` statistics from one pass over the pairs.

    With `store` the error sums per station and day are written once and all three read them.
    """
    sums = error_sums(pairs, [station, day], error_columns(pairs, variables, pred_suffix or f"_{prefix}", obs_suffix))
    return suite_of(materialise(sums) if store else sums, prefix, station, day)


def suite_of(sums: DataFrame, prefix: str, station: str = "station_id", day: str = "prism_day") -> dict[str, DataFrame]:
    """The three summaries of a metric suite from error sums per station and day."""
    rows = by_variable(sums, [station, day])
    totals = [F.sum(s).alias(s) for s in _SUMS]
    return {
        "overall": finish(rows.groupBy("var").agg(*totals), ["var"], prefix),
        "by_station": finish(rows.groupBy(station, "var").agg(*totals), [station, "var"], prefix),
        "by_day": finish(rows.groupBy(day, "var").agg(*totals), [day, "var"], prefix),
    }


def all_metrics(
    pairs: DataFrame, variables: Sequence[str], pred_suffix: str, obs_suffix: str = "_obs",
    station: str = "station_id", day: str = "prism_day",
) -> DataFrame:
    """The three summaries as one table (`level` overall, station or day) by grouping sets."""
    columns = error_columns(pairs, variables, pred_suffix, obs_suffix)
    rows = by_variable(error_sums(pairs, [station, day], columns), [station, day])
    sets = [[F.col("var")], [F.col("var"), F.col(station)], [F.col("var"), F.col(day)]]
    grouped = rows.groupingSets(sets, F.col("var"), F.col(station), F.col(day)).agg(
        F.grouping_id().alias("_g"), *[F.sum(s).alias(s) for s in _SUMS])
    level = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "station").otherwise("day")
    return finish(grouped.withColumn("level", level), ["level", "var", station, day])


def paired_metrics(
    pairs: DataFrame, variables: Sequence[str], first: str, second: str, obs_suffix: str = "_obs"
) -> DataFrame:
    """Statistics of two products on the same rows, and the difference of their RMSE."""
    columns = {
        f"{v}|{product}": both
        for product in (first, second)
        for v, both in error_columns(pairs, variables, f"_{product}", obs_suffix).items()
    }
    rows = by_variable(error_sums(pairs, [], columns), [])
    rows = rows.withColumns({"product": F.split_part("var", F.lit("|"), F.lit(2)), "var": F.split_part("var", F.lit("|"), F.lit(1))})
    of = lambda product, s: F.max(F.when(F.col("product") == product, F.col(s)))
    n = of(first, "n")
    stats = {}
    for product in (first, second):
        stats[f"{product}_bias"] = F.try_divide(of(product, "e"), n)
        stats[f"{product}_mae"] = F.try_divide(of(product, "a"), n)
        stats[f"{product}_rmse"] = F.sqrt(F.try_divide(of(product, "q"), n))
    difference = stats[f"{second}_rmse"] - stats[f"{first}_rmse"]
    return rows.groupBy("var").agg(
        n.alias("paired_N"), *[c.alias(k) for k, c in stats.items()],
        difference.alias(f"rmse_{second}_minus_{first}"))


def station_sums(
    pairs: DataFrame, stations: DataFrame, distance: str, variables: Sequence[str], pred_suffix: str,
    windows: Sequence[str] = (), station: str = "station_id",
) -> DataFrame:
    """Error sums per window, variable and station with matches, plus the station's distance."""
    keys = [*windows, station]
    sums = error_sums(pairs, keys, error_columns(pairs, variables, pred_suffix))
    return by_variable(sums, keys).where("n > 0").join(
        stations.select(station, F.col(distance).alias("dist"), F.lit(1).alias("known")), station, "left")


def summarise(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: stations, matched hours, distance median and p90, bias, RMSE, from stored station sums.

    Distances count each station with a matched row once; keys without a matched row are left out.
    """
    totals = rows.groupBy(*keys).agg(F.count("known").alias("n_stations"), *[F.sum(s).alias(s) for s in _SUMS])
    spread = exact_percentiles(rows, keys, "dist", {"dist_median_m": 0.5, "dist_p90_m": 0.9})
    return totals.join(spread, list(keys), "left").select(
        *keys, "n_stations", F.col("n").alias("n_hours"), "dist_median_m", "dist_p90_m",
        (F.col("e") / F.col("n")).alias("bias"), F.sqrt(F.col("q") / F.col("n")).alias("rmse"))


def summary_rows(
    pairs: DataFrame, stations: DataFrame, distance: str, variables: Sequence[str], pred_suffix: str,
    windows: Sequence[str] = (), station: str = "station_id",
) -> DataFrame:
    """Summary of one comparison per window and variable. `stations` has one row per station.

    The station sums are written once: counts and percentiles read them several times.
    """
    rows = station_sums(pairs, stations, distance, variables, pred_suffix, windows, station)
    return summarise(materialise(rows), [*windows, "var"])
