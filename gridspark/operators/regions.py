"""Area- and population-weighted means of cell values per region and hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.geo import area_weight
from gridspark.operators.quality import require_covered

TIME_AND_PLACE = ("lat", "lon", "year", "month", "day", "time", "prism_day", "ph")


def value_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """All numeric columns other than keys, time and coordinates; none is an error."""
    skip = {*TIME_AND_PLACE, *exclude}
    found = [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]
    if not found:
        raise ValueError("no numeric value columns to aggregate")
    return found


def attach_regions(cells: DataFrame, cell_regions: DataFrame, cell_keys: Sequence[str]) -> DataFrame:
    """Region code per row; cells without a region or with a negative code drop out."""
    return cells.join(cell_regions.where("tract_code >= 0"), list(cell_keys))


def attach_population(
    cell_regions: DataFrame, population: DataFrame, cell_keys: Sequence[str], check: bool = True
) -> DataFrame:
    """Population per mapped cell. A mapped cell the population table lacks is an error."""
    if check:
        require_covered(cell_regions, population, cell_keys, "population")
    return cell_regions.join(population.select(*cell_keys, "pop"), list(cell_keys), "left")


def region_means(
    df: DataFrame, values: Sequence[str], region_keys: Sequence[str], area: Column, pop: Column | None,
) -> DataFrame:
    """`<v>_area`, `<v>_pop` per group, plus `covered`.

    Each metric has its own denominator: rows without a value count for neither sum. Only
    positive weights count. Without population the `_pop` columns are NULL. Sums combine before
    the shuffle, so a region holding most cells costs each task one partial row per hour.
    """
    weights = {"_w_area": F.when(area > 0, area)}
    if pop is not None:
        weights["_w_pop"] = F.when(pop > 0, pop.cast("double"))
    df = df.withColumns(weights)
    sums, means, covered = [], [], []
    for v in values:
        value = F.col(v).cast("double")
        for name in ("area", "pop"):
            weight = F.col(f"_w_{name}")
            if f"_w_{name}" not in weights:
                means.append(F.lit(None).cast("double").alias(f"{v}_pop"))
                continue
            total, share = f"_{v}_{name}_s", f"_{v}_{name}_w"
            sums += [F.sum(value * weight).alias(total), F.sum(F.when(value.isNotNull(), weight)).alias(share)]
            means.append(F.try_divide(F.col(total), F.col(share)).alias(f"{v}_{name}"))
            covered.append(F.col(share).isNotNull())
    any_cover = covered[0]
    for flag in covered[1:]:
        any_cover = any_cover | flag
    return df.groupBy(*region_keys).agg(*sums).select(*region_keys, *means, any_cover.alias("covered"))


def dense_hours(
    means: DataFrame, day_keys: Sequence[str], hour: str = "ph", hours: int = 24, covered: str = "covered"
) -> DataFrame:
    """All hours for every region-day covered in any hour by either weighting.

    Regroups the aggregated rows (at most `hours` per group) into a map and reads it back along
    the hour sequence; no product of regions and hours is joined. Rows are dealt by the first of
    `day_keys`, the region, so that they need not move again to meet its name (see `name_regions`).
    """
    columns = [c for c in means.columns if c not in (*day_keys, hour, covered)]
    packed = means.repartition(day_keys[0]).groupBy(*day_keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(hour), F.struct(*columns)))).alias("_by_hour"),
        F.max(covered).alias("_keep"),
    ).where("_keep")
    spread = packed.withColumn(hour, F.explode(F.sequence(F.lit(0), F.lit(hours - 1)).cast("array<int>")))
    at = F.try_element_at("_by_hour", F.col(hour))
    return spread.select(*day_keys, hour, *[at[c].alias(c) for c in columns])


def name_regions(
    means: DataFrame, codes: DataFrame, representative: DataFrame | None = None
) -> DataFrame:
    """GEOID from the code table, representative point when there is one (missing allowed)."""
    names = codes.select("tract_code", "GEOID")
    if representative is None:
        names = names.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    else:
        names = names.join(representative.select("GEOID", "lat", "lon"), "GEOID", "left")
    # Names and points meet first, region by region, so that the hours move once.
    return means.join(names, "tract_code").drop("tract_code")


def tract_table(
    cells: DataFrame, cell_regions: DataFrame, codes: DataFrame, cell_keys: Sequence[str],
    population: bool = True, representative: DataFrame | None = None, use_cosine: bool = True,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """The full regional table of hourly cell rows keyed by cell, `prism_day` and `ph`.

    `cell_regions` holds cell keys and tract_code, and with `population` also `pop` (see
    `attach_population`); one of the two tables carries lat. They join on the columns they share.
    """
    values = list(values or value_columns(cells, exclude=cell_keys))
    mapped = attach_regions(cells, cell_regions, [c for c in cell_regions.columns if c in cells.columns])
    means = region_means(
        mapped, values, ["tract_code", "prism_day", "ph"], area_weight(F.col("lat"), use_cosine),
        F.col("pop") if population else None,
    )
    return name_regions(dense_hours(means, ["tract_code", "prism_day"]), codes, representative)
