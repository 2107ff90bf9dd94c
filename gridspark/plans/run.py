"""Day-range runs: inputs to regional table, one plan for all days."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.geo import area_weight
from gridspark.functions.humidity import shifted_vapor_pressure
from gridspark.operators.axis import grid_nearest
from gridspark.operators.interpolate import (
    BROADCAST_BYTES, TILE, attach_sources, interpolated, look_up_sources, may_broadcast, source_dictionary, source_hours,
    spread_hours, tile_degrees, tile_dictionary, with_tile,
)
from gridspark.operators.quality import days_to_run, duplicate_keys, missing_inputs, require_none
from gridspark.operators.regions import (
    attach_population, attach_regions, dense_hours, name_regions, region_means,
)
from gridspark.operators.templates import scaled_temperature, template_hour
from gridspark.plans.fields import (
    RADIATION, RADIATION_CUTOFF_M, WEATHER, WEATHER_CUTOFF_M, cell_templates, radiation_values, weather_values,
)
from gridspark.plans.heatstress import METRICS, heat_stress
from gridspark.session import Scratch, materialise
from gridspark.sources.regions import population_of_years, resolve_population_years
from gridspark.sources.sinks import (
    RESULT_KEYS, committed_results, read_long, record_commits, write_long, write_regions,
)

CELL = ["lat", "lon"]
SAME_DAY = ("tmin", "tmax", "tdmean")
TWO_DAYS = ("t2m", "d2m", "sp", "u10", "v10", "str", "strd", "ghi", "dhi", "dni", "sza", "alb")


@dataclass
class Inputs:
    """Input tables of a run; coordinates are rounded alike in all of them.

    daily: lat, lon, prism_day, tmin, tmax, tdmean
    coarse: lat, lon, src_id, d, hr, t2m, d2m (C), sp, u10, v10, str, strd
    coarse_grid: lat, lon of the coarse cells (static)
    half_hours: point, d, slot, ghi, dhi, dni, sza, alb
    weather_nn, radiation_nn: lat, lon, nn (static neighbour tables)
    cell_regions: lat, lon, tract_code
    codes: tract_code, GEOID
    population: lat, lon, yr, pop; None for area weights only
    representative: GEOID, lat, lon; None for no points
    """

    daily: DataFrame
    coarse: DataFrame
    coarse_grid: DataFrame
    half_hours: DataFrame
    weather_nn: DataFrame
    radiation_nn: DataFrame
    cell_regions: DataFrame
    codes: DataFrame
    population: DataFrame | None = None
    representative: DataFrame | None = None


def utc_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the UTC days that the labelled days touch: each day and the one before.

    The days are a calendar's, so their list is small, and as literals on `d` they prune partitions and row
    groups before anything is read.
    """
    labels = [r[0] for r in days.select("prism_day").distinct().collect()]
    needed = sorted({d - timedelta(n) for d in labels for n in (0, 1)})
    return rows.where(F.col("d").isin(needed))


def hourly_inputs(
    inputs: Inputs, daily: DataFrame, days: DataFrame, broadcast_bytes: int = BROADCAST_BYTES,
    store: Callable[[DataFrame], DataFrame] = materialise,
) -> DataFrame:
    """lat, lon, prism_day, ph, the twelve layers, and whatever else `daily` carries.

    Everything joins at one row per cell and day and hours are spread last, so no hourly row is
    shuffled before the regional sums. Packed source values that are proven small are broadcast;
    larger ones, by `broadcast_bytes`, go to dictionaries of tiles of cells. Both ways keep the same rows:
    cells with a valid temperature range and a mean dewpoint whose template is complete. Hours
    that a source lacks stay, with that value missing. Both ways deal the daily rows by tile and day, so the cells of a
    region meet in few tasks, and what these sum up of it is small; a tile holds a bounded number of cells. `store` writes
    what is read more than once; a `Scratch` deletes it with its block.
    """
    carried = [c for c in daily.columns if c not in ("prism_day", "tmin", "tmax", "tdmean")]
    coarse = utc_days(inputs.coarse, days)
    weather = store(weather_values(coarse).join(days, "prism_day", "left_semi"))
    sun = store(radiation_values(utc_days(inputs.half_hours, days)).join(days, "prism_day", "left_semi"))

    # Everything static about a cell in one table: neighbours and nearest coarse cell.
    cells = inputs.weather_nn.withColumnRenamed("nn", "nn_w").join(
        inputs.radiation_nn.withColumnRenamed("nn", "nn_r"), CELL)
    cells = store(grid_nearest(cells, inputs.coarse_grid))
    cells = with_tile(cells, tile_degrees(cells))
    templates = cell_templates(coarse).where("td_mean IS NOT NULL")
    daily = daily.where("tmin IS NOT NULL AND tmax > tmin AND tdmean IS NOT NULL")
    # The two broadcasts live side by side and share one budget.
    if all(may_broadcast(p, len(n), broadcast_bytes // 2) for p, n in ((weather, WEATHER), (sun, RADIATION))):
        rows = daily.join(cells, CELL).repartition(*TILE, "prism_day").drop(*TILE)
        rows = rows.join(templates, ["near_lat", "near_lon", "prism_day"])
        rows = attach_sources(rows, weather, "src_id", ["prism_day"], nn="nn_w", tag="w_")
        rows = attach_sources(rows, sun, "point", ["prism_day"], nn="nn_r", tag="r_")
    else:
        rows = from_tiles(daily, cells, templates, weather, sun)
    rows = spread_hours(rows, ["hours", *source_hours(tag="w_"), *source_hours(tag="r_")])
    frac, td = template_hour()
    rows = rows.withColumn("t2m", scaled_temperature(F.col("tmin"), F.col("tmax"), frac))
    ea = shifted_vapor_pressure(td, F.col("td_mean"), F.col("tdmean"), F.col("t2m"))
    return rows.select(
        *carried, "prism_day", "ph", "t2m", ea.alias("ea"),
        *[interpolated(v, tag="w_", cutoff_m=WEATHER_CUTOFF_M).alias(v) for v in WEATHER],
        *[interpolated(v, tag="r_", cutoff_m=RADIATION_CUTOFF_M).alias(v) for v in RADIATION],
    )


def from_tiles(
    daily: DataFrame, cells: DataFrame, templates: DataFrame, weather: DataFrame, sun: DataFrame
) -> DataFrame:
    """The daily rows with template and source values out of the dictionaries of their tile and day.

    Each tile gets every source and template of a day once; a daily row meets all three by one exchange of its own, and leaves
    each dictionary behind before it meets the next.
    """
    day = ["prism_day"]
    place = F.struct("near_lat", "near_lon")
    named = templates.select(place.alias("_id"), *day, F.struct("hours", "t_low", "t_high", "td_mean").alias("_t"))
    rows = daily.join(cells, CELL).join(
        tile_dictionary(cells, named, F.array(place), F.col("_t"), day, "_templates"), [*TILE, *day])
    rows = rows.withColumn("_t", F.try_element_at("_templates", place)).drop("_templates").where("_t IS NOT NULL")
    for name, packed, source, nn, tag in (
        ("_weather", weather, "src_id", "nn_w", "w_"), ("_sun", sun, "point", "nn_r", "r_")
    ):
        found = source_dictionary(cells, packed, source, day, nn, name)
        rows = look_up_sources(rows.join(found, [*TILE, *day], "left"), name, nn, tag=tag)
    return rows.select("*", "_t.*").drop("_t", *TILE)


def population_years(inputs: Inputs, days: DataFrame) -> DataFrame | None:
    """The population year of every year of the days' labels; None without population."""
    if inputs.population is None:
        return None
    return resolve_population_years(days.select(F.year("prism_day").alias("yr")), inputs.population)


def weighted_cells(inputs: Inputs, days: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Region and population per cell and year of the requested days, and the years' table.

    The population year follows the label of the day, not the hour's own year.
    """
    resolved = population_years(inputs, days)
    if resolved is None:
        return inputs.cell_regions, None
    people = population_of_years(inputs.population, resolved)
    years = resolved.agg(F.collect_set("yr").alias("y")).scalar()
    return attach_population(
        inputs.cell_regions.withColumn("yr", F.explode(years)), people, [*CELL, "yr"]), resolved


def heat_stress_cells(inputs: Inputs, days: DataFrame) -> DataFrame:
    """The long metric table of all cells: lat, lon, prism_day, ph and the five metrics."""
    days = materialise(days.select("prism_day").distinct())
    daily = inputs.daily.join(days, "prism_day", "left_semi")
    return heat_stress(hourly_inputs(inputs, daily, days))


def mapped_cells(
    inputs: Inputs, days: DataFrame, store: Callable[[DataFrame], DataFrame] = materialise
) -> DataFrame:
    """The long metric table of all cells, metrics in single precision as they are stored.

    Where no cell is mapped twice the rows carry `tract_code` (NULL outside all regions) and `pop`. They come by tile, so
    regions can be summed from them without joining an hour, and combine before the shuffle. `store` writes what is
    read more than once on the way; the caller writes the rows.
    """
    days = store(days.select("prism_day").distinct())
    mapped = store(weighted_cells(inputs, days)[0].where("tract_code >= 0"))
    daily = inputs.daily.join(days, "prism_day", "left_semi")
    keys = [c for c in (*CELL, "yr") if c in mapped.columns]
    if duplicate_keys(mapped, keys).isEmpty():
        daily = daily.withColumn("yr", F.year("prism_day")).join(mapped, keys, "left").drop("yr")
    rows = heat_stress(hourly_inputs(inputs, daily, days, store=store))
    return rows.withColumns({m: F.col(m).cast("float") for m in METRICS})


def regional_table(
    inputs: Inputs, days: DataFrame, broadcast_bytes: int = BROADCAST_BYTES,
    store: Callable[[DataFrame], DataFrame] = materialise,
) -> DataFrame:
    """The regional table of the given days, with `pop_year`.

    Region and weights join the daily rows, so cells outside all regions drop out before any hour
    is made, and the regional sums are the only step that shuffles by hour.
    """
    days = store(days.select("prism_day").distinct())
    mapped, resolved = weighted_cells(inputs, days)
    daily = inputs.daily.join(days, "prism_day", "left_semi").withColumn("yr", F.year("prism_day"))
    daily = attach_regions(daily, mapped, [c for c in (*CELL, "yr") if c in mapped.columns]).drop("yr")
    return _means_of(heat_stress(hourly_inputs(inputs, daily, days, broadcast_bytes, store)), inputs, resolved)


def regional_table_of(cells: DataFrame, inputs: Inputs, days: DataFrame) -> DataFrame:
    """The regional table of cells and hours that are stored (see `read_long`) or at hand; no input is read and no index
    computed again.

    Stored coordinates are single precision; the region map's are met at the precision of the cells'. Cells that carry
    their region (see `mapped_cells`) need not meet the map.
    """
    if "tract_code" in cells.columns:
        return _means_of(cells.where("tract_code >= 0"), inputs, population_years(inputs, days))
    mapped, resolved = weighted_cells(inputs, days)
    mapped = mapped.withColumns({f"_{c}": F.col(c).cast(cells.schema[c].dataType) for c in CELL})
    cells = cells.withColumnsRenamed({c: f"_{c}" for c in CELL}).withColumn("yr", F.year("prism_day"))
    found = attach_regions(cells, mapped, [c for c in ("_lat", "_lon", "yr") if c in mapped.columns])
    return _means_of(found, inputs, resolved)


def _means_of(cells: DataFrame, inputs: Inputs, resolved: DataFrame | None) -> DataFrame:
    means = region_means(
        cells, METRICS, ["tract_code", "prism_day", "ph"], area_weight(F.col("lat")),
        None if resolved is None else F.col("pop"))
    table = name_regions(dense_hours(means, ["tract_code", "prism_day"]), inputs.codes, inputs.representative)
    if resolved is None:
        return table.withColumn("pop_year", F.lit(None).cast("int"))
    return table.withColumn("yr", F.year("prism_day")).join(resolved, "yr").drop("yr")


def labelled(inputs: Inputs, days: DataFrame, vintage: int) -> DataFrame:
    """The days with the population year and vintage that a run stores them under."""
    year = F.year("prism_day")
    if inputs.population is None:
        return days.select("prism_day", F.lit(None).cast("int").alias("pop_year"), F.lit(vintage).alias("vintage"))
    resolved = resolve_population_years(days.select(year.alias("yr")), inputs.population)
    return days.select("prism_day", year.alias("yr")).join(resolved, "yr").select(
        "prism_day", F.col("pop_year").cast("int").alias("pop_year"), F.lit(vintage).alias("vintage"))


def run_days(
    spark: SparkSession, inputs: Inputs, days: DataFrame, path: str, vintage: int,
    available: DataFrame | None = None, overwrite: bool = False, time_mode: str = "utc",
    long_path: str | None = None, fingerprints: DataFrame | None = None,
) -> int:
    """Compute and store the requested days that have no result yet; returns for how many days something was stored.

    A regional result is a day under its population year and vintage: another vintage, or weights where there were none,
    is a result of its own. With `long_path` the hourly metrics of all cells are kept too. Each of the two outputs
    has its own notes of complete days, so either may be asked for after the other; days that need the cells have
    their physics computed once, and their regional result is summed from the same values, or from stored cells. What is
    written on the way is deleted when the run ends. With `fingerprints` (prism_day,
    fingerprint; see `input_fingerprints`) a day whose inputs changed since counts as not done. With `available` (layer, d) a
    missing input stops the run before any work.
    """
    wanted = labelled(inputs, days, vintage)
    same_inputs: list[str] = []
    if fingerprints is not None:
        wanted, same_inputs = wanted.join(fingerprints, "prism_day", "left"), ["fingerprint"]

    with Scratch(spark) as store:

        def open_days(output: str, keys: Sequence[str]) -> DataFrame:
            # Written: the notes it is compared with change while the run goes on.
            return store(days_to_run(wanted, committed_results(spark, output), overwrite, [*keys, *same_inputs]))

        regional = open_days(path, RESULT_KEYS)
        cells = None if long_path is None else open_days(long_path, ["prism_day"])
        todo = regional if cells is None else regional.unionByName(cells)
        todo = todo.select("prism_day").distinct()
        if available is not None:
            require_none(missing_inputs(todo, available, SAME_DAY, TWO_DAYS), "missing inputs")
        # Days are a calendar's.
        of = lambda df: sorted({r[0] for r in df.select("prism_day").collect()})
        made, made_days = None, [] if cells is None else of(cells)
        if made_days:
            with Scratch(spark) as steps:
                made = store(mapped_cells(inputs, cells.select("prism_day"), steps))
            write_long(made, long_path, time_mode)
            record_commits(cells.drop("pop_year", "vintage").distinct(), long_path)
        if wanted_days := of(regional):
            its_days = regional.select("prism_day").distinct()
            if long_path is None:
                table = regional_table(inputs, its_days, store=store)
            elif set(wanted_days) <= set(made_days) and "tract_code" in made.columns:
                table = regional_table_of(made.where(F.col("prism_day").isin(wanted_days)), inputs, its_days)
            else:
                table = regional_table_of(read_long(spark, long_path, wanted_days, time_mode), inputs, its_days)
            write_regions(table, path, vintage, time_mode=time_mode)
            record_commits(regional, path)
        return todo.count()
