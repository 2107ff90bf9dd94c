"""Validation of predictions against station observations, for any number of windows at once.

Windows are rows (window_id, start_day, end_day). Observations get their cell from the small
station table first, so the one large join is observation to prediction on cell and time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.time import shifted_day, window_label, window_tag
from gridspark.operators.metrics import (
    error_columns, error_sums, match_paired, match_pairs, paired_metrics, station_sums, suite_of, summarise, variable_label,
)
from gridspark.operators.neighbours import nearest_one, with_xy
from gridspark.operators.stations import first_coordinates, with_observations
from gridspark.session import materialise
from gridspark.sources.sinks import write_pairs, write_report, write_suite

MET = ("temp_C", "ea_hPa", "rh_pct")
INDICES = ("temp_C", "rh_pct", "HI_C", "WBGT_C")
RADIANT = ("TMRT_C", "UTCI_C")

# Product names are labels only. Reference and distance names, column heads of the table.
MODEL_MET = "gridded meteorology"
MODEL_INDICES = "gridded heat-stress indices"
MODEL_UTCI = "radiation-driven UTCI"
COARSE_MET = "ERA5-Land meteorology"
ISD, USCRN, SURFRAD = "ISD-Lite", "USCRN (heat01)", "SURFRAD"
NEAR_MODEL, NEAR_COARSE = "≤800 m", "≤9 km"
TABLE_HEADS = {
    "window_label": "Temporal window", "window_start": "Window start", "window_end": "Window end",
    "product": "Product", "reference": "Reference", "variable": "Variable", "n_stations": "Stations (N)",
    "n_hours": "Station-hours matched (N)", "distance_filter": "Distance filter",
    "dist_median_m": "Distance median (m)", "dist_p90_m": "Distance p90 (m)", "bias": "Bias", "rmse": "RMSE",
}
TABLE_ORDER = ("window_start", "product", "reference", "variable")


@dataclass
class Comparison:
    """One product against one reference."""

    product: str
    reference: str
    distance_filter: str
    distance: str
    pred_suffix: str
    variables: Sequence[str]
    pairs: DataFrame
    stations: DataFrame


def map_stations(stations: DataFrame, grid: DataFrame, suffix: str) -> DataFrame:
    """Add key_<suffix> and dist_m_<suffix>, the nearest cell of a grid table and its distance.

    The result is static and joined many times, so it is written once.
    """
    placed = with_xy(stations, "LAT", "LON")
    found = nearest_one(placed, grid, ["station_id"], "key", f"dist_m_{suffix}")
    return materialise(found.drop("x", "y").withColumnRenamed("key", f"key_{suffix}"))


def windows_of(spark, spans: Sequence[tuple[str, str]]) -> DataFrame:
    """Window rows from (start, end) pairs; an end before its start is an error."""
    for start, end in spans:
        if end < start:
            raise ValueError(f"window end {end} is before start {start}")
    rows = [(i, a, b) for i, (a, b) in enumerate(spans)]
    df = spark.createDataFrame(rows, "window_id int, a string, b string")
    return df.select("window_id", F.col("a").cast("date").alias("start_day"), F.col("b").cast("date").alias("end_day"))


def in_windows(observations: DataFrame, windows: DataFrame) -> DataFrame:
    """Observations with the windows they fall in, by the label of their 12Z-to-12Z day.

    Windows are listed by day, which makes this an equi-join.
    """
    by_day = windows.select(
        "window_id", F.explode(F.sequence("start_day", "end_day", F.expr("INTERVAL 1 DAY"))).alias("prism_day"))
    return observations.withColumn("prism_day", shifted_day(F.col("time_utc"))).join(by_day, "prism_day")


def wanted_only(predictions: DataFrame, placed: DataFrame) -> DataFrame:
    """Predictions on the cells and days of `placed` observations (key, prism_day); a row without a day stays.

    The days, a calendar's, become literals on the partition column, so other days are never read; cells that no
    station uses drop out before the join on time.
    """
    cells = predictions.join(placed.select("key").distinct(), "key", "left_semi")
    if "prism_day" not in predictions.columns or "prism_day" not in placed.columns:
        return cells
    days = [r[0] for r in placed.select("prism_day").distinct().collect()]
    return cells.where(F.col("prism_day").isNull() | F.col("prism_day").isin(days))


def pairs_for(observations: DataFrame, stations: DataFrame, keep: Column, key: str, predictions: DataFrame) -> DataFrame:
    """Matched rows of the kept stations; stations sharing a cell each get its values."""
    kept = stations.where(keep).select("station_id", F.col(key).alias("key"))
    placed = observations.join(kept, "station_id")
    return match_pairs(placed, wanted_only(predictions, placed).drop("prism_day"), ["key", "time_utc"])


def isd_comparisons(
    stations: DataFrame, observations: DataFrame, model: DataFrame, coarse: DataFrame
) -> list[Comparison]:
    """Model and coarse product against the hourly surface network.

    `stations` carries key_model, key_era and the flags of `keep_flags`; `observations` window_id.
    """
    used = materialise(with_observations(stations, observations))
    specs = [
        (MODEL_MET, NEAR_MODEL, "model", "keep_model", model), (COARSE_MET, NEAR_COARSE, "era", "keep_era", coarse)]
    return [
        Comparison(product, ISD, label, f"dist_m_{s}", f"_{s}", MET,
                   pairs_for(observations, used, F.col(flag), f"key_{s}", predictions), used)
        for product, label, s, flag, predictions in specs
    ]


def isd_paired(stations: DataFrame, observations: DataFrame, model: DataFrame, coarse: DataFrame) -> DataFrame:
    """Both products on the stations near both grids, rows with all nine values, by variable."""
    both = stations.where("keep_both")

    def on(product: DataFrame, key: str) -> DataFrame:
        cells = both.select("station_id", F.col(key).alias("key"))
        seen = observations.join(cells, "station_id")
        return wanted_only(product, seen).join(cells, "key").drop("key")

    required = [f"{v}_{s}" for v in MET for s in ("obs", "model", "era")]
    merged = match_paired(on(model, "key_model"), on(coarse, "key_era"), observations.drop("prism_day"), required)
    return paired_metrics(merged, MET, "model", "era")


def network_comparison(
    observations: DataFrame, grid: DataFrame, predictions: DataFrame, product: str, reference: str,
    variables: Sequence[str], max_dist_m: float = 800.0, stations: DataFrame | None = None,
) -> Comparison:
    """One product against a network whose observations carry their coordinates.

    `stations` are those of the observations, where `map_stations` has placed them on the grid already.
    """
    if stations is None:
        stations = map_stations(first_coordinates(observations), grid, "model")
    near = F.col("dist_m_model") <= max_dist_m
    pairs = pairs_for(observations.drop("LAT", "LON"), stations, near, "key_model", predictions)
    return Comparison(product, reference, NEAR_MODEL, "dist_m_model", "_model", variables, pairs, stations.where(near))


def uscrn_comparisons(observations: DataFrame, grid: DataFrame, met: DataFrame, indices: DataFrame) -> list[Comparison]:
    stations = map_stations(first_coordinates(observations), grid, "model")
    return [
        network_comparison(observations, grid, met, MODEL_MET, USCRN, MET, stations=stations),
        network_comparison(observations, grid, indices, MODEL_INDICES, USCRN, INDICES, stations=stations),
    ]


def surfrad_comparison(observations: DataFrame, grid: DataFrame, predictions: DataFrame) -> Comparison:
    """UTCI, and the radiant temperature where the predictions have it."""
    have = [v for v in RADIANT if f"{v}_model" in predictions.columns]
    return network_comparison(observations, grid, predictions, MODEL_UTCI, SURFRAD, have)


def summary_table(comparisons: Sequence[Comparison], windows: DataFrame) -> DataFrame:
    """All comparisons as one table in reading order, a row per window and variable with matches.

    Every comparison is reduced to station sums; these are stacked, written once and summarised
    together.
    """
    stacked = None
    for c in comparisons:
        rows = station_sums(c.pairs, c.stations, c.distance, c.variables, c.pred_suffix, ["window_id"])
        rows = rows.withColumns({
            "product": F.lit(c.product), "reference": F.lit(c.reference), "distance_filter": F.lit(c.distance_filter)})
        stacked = rows if stacked is None else stacked.unionByName(rows)
    keys = ["window_id", "product", "reference", "distance_filter", "var"]
    start, end = F.col("start_day"), F.col("end_day")
    return summarise(materialise(stacked), keys).join(windows, "window_id").select(
        window_label(start, end).alias("window_label"), F.date_format(start, "yyyy-MM-dd").alias("window_start"),
        F.date_format(end, "yyyy-MM-dd").alias("window_end"), "product", "reference",
        variable_label(F.col("var")).alias("variable"), "n_stations", "n_hours", "distance_filter",
        "dist_median_m", "dist_p90_m", "bias", "rmse").orderBy(*TABLE_ORDER)


def write_comparison(comparison: Comparison, windows: DataFrame, folder: str, prefix: str, pairs_as_csv: bool = False) -> None:
    """Files of one comparison: its station list, and for every window the metric suite (overall, by station, by day)
    and the matched pairs, under the window's tag.

    The pairs of all windows are joined once; the windows, a handful, are written one after another.
    """
    write_stored(replace(comparison, pairs=materialise(comparison.pairs)), windows, folder, prefix, pairs_as_csv)


def write_stored(comparison: Comparison, windows: DataFrame, folder: str, prefix: str, pairs_as_csv: bool) -> None:
    """`write_comparison` of pairs that are in a table already; the error sums of all windows are made in one pass."""
    write_report(comparison.stations, f"{folder}/stations_{prefix}", ["station_id"])
    pairs, columns = comparison.pairs, error_columns(comparison.pairs, comparison.variables, comparison.pred_suffix)
    sums = materialise(error_sums(pairs, ["window_id", "station_id", "prism_day"], columns))
    for window in tagged(windows).select("window_id", "tag").orderBy("window_id").collect():
        own = F.col("window_id") == window.window_id
        write_suite(suite_of(sums.where(own), prefix), folder, prefix, window.tag)
        write_pairs(pairs.where(own), f"{folder}/pairs_{prefix}_{window.tag}", pairs_as_csv)


def write_validation(
    comparisons: dict[str, Comparison], windows: DataFrame, folder: str, pairs_as_csv: bool = False
) -> DataFrame:
    """The whole job: the files of every comparison under its prefix (see `write_comparison`), the combined table, and its rows of
    each window; returns the combined table. Comparisons without matches have no rows in it.

    The pairs of a comparison are joined once, for its files and for the table.
    """
    comparisons = {prefix: replace(c, pairs=materialise(c.pairs)) for prefix, c in comparisons.items()}
    for prefix, comparison in comparisons.items():
        write_stored(comparison, windows, folder, prefix, pairs_as_csv)
    table = materialise(summary_table(list(comparisons.values()), windows))
    heads = [TABLE_HEADS[c] for c in TABLE_ORDER]
    write_report(published(table), f"{folder}/validation_table", heads)
    for window in tagged(windows).orderBy("window_id").collect():
        own = window_extract(table, f"{window.start_day:%Y-%m-%d}", f"{window.end_day:%Y-%m-%d}")
        if not own.isEmpty():
            write_report(published(own), f"{folder}/validation_table_{window.tag}", heads)
    return table


def window_extract(table: DataFrame, start: str, end: str) -> DataFrame:
    """The rows of one window."""
    return table.where((F.col("window_start") == start) & (F.col("window_end") == end))


def published(table: DataFrame) -> DataFrame:
    """The table under its printed column heads."""
    return table.select(*[F.col(c).alias(head) for c, head in TABLE_HEADS.items()])


def tagged(windows: DataFrame) -> DataFrame:
    """Windows with the tag used in file names."""
    return windows.withColumn("tag", window_tag(F.col("start_day"), F.col("end_day")))

