"""Inverse-distance interpolation of hourly source values onto targets.

Values travel packed: one row per source and day with an array of 24 structs. Joins then run on a
24th of the rows, and hours are spread out only after the last join. Values too large to broadcast
go to tiles of targets: neighbours share most of their sources, so a tile's dictionary of a day is small, and a target row
crosses the network once, without any values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.geo import inverse_distance_weight
from gridspark.session import fits_broadcast, materialise

HOURS = 24
# Size up to which packed values are broadcast; their row width is known, so rows bound bytes.
BROADCAST_BYTES = 256 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64


def pack_hours(values: DataFrame, keys: Sequence[str], columns: Sequence[str], hour: str = "ph") -> DataFrame:
    """One row per key with `hours`, an array of 24 structs of `columns`; absent hours are NULL.

    An hour that occurs twice for a key is an error, so a group holds at most 24 rows.
    """
    pairs = F.collect_list(F.struct(F.col(hour).cast("int"), F.struct(*columns)))
    packed = values.groupBy(*keys).agg(F.map_from_entries(pairs).alias("_by_hour"))
    return packed.select(*keys, in_order("_by_hour").alias("hours"))


def in_order(by_hour: str) -> Column:
    """Array of 24 from a map keyed by hour."""
    return F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda h: F.try_element_at(by_hour, h))


def spread_hours(rows: DataFrame, packed: Sequence[str], hour: str = "ph") -> DataFrame:
    """One row per hour 0..23, in which each of the `packed` arrays is replaced by its element of that hour.

    The arrays are taken apart together, so an hour's row holds its own elements and no copy of the whole day; NULL arrays
    give NULL elements.
    """
    keep = [c for c in rows.columns if c not in packed]
    hours = F.sequence(F.lit(0), F.lit(HOURS - 1))
    zipped = F.arrays_zip(hours, *[F.coalesce(F.col(p), F.array()) for p in packed])
    return rows.select(*keep, F.inline(zipped).alias(hour, *packed))


def attach_sources(
    rows: DataFrame, packed: DataFrame, source_id: str, day_keys: Sequence[str] = (),
    nn: str = "nn", k: int = 4, tag: str = "", power: float = 1.0, eps: float = 1e-6,
) -> DataFrame:
    """Look the k neighbours' packed values up for every row; broadcasts `packed`.

    Adds `_<tag>w<i>` (weight), `_<tag>v<i>` (hours) and `_<tag>near` (nearest distance); the
    targets are not shuffled. Callers check the size first, see `may_broadcast`.
    """
    entry = lambda i, field: F.get(nn, F.lit(i))[field]
    rows = rows.withColumns({
        f"_{tag}near": entry(0, "dist"),
        **{f"_{tag}s{i}": entry(i, "id") for i in range(k)},
        **{f"_{tag}w{i}": inverse_distance_weight(entry(i, "dist"), power, eps) for i in range(k)},
    })
    for i in range(k):
        side = packed.select(
            F.col(source_id).alias(f"_{tag}s{i}"), *day_keys, F.col("hours").alias(f"_{tag}v{i}"))
        rows = rows.join(F.broadcast(side), [f"_{tag}s{i}", *day_keys], "left")
    return rows.drop(*[f"_{tag}s{i}" for i in range(k)])


TILE = ("_ty", "_tx")
# Cells a tile may hold, and the side in degrees that tiles start from.
TILE_CELLS = 4096
TILE_DEGREES = 1.0


def with_tile(df: DataFrame, degrees: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the two numbers of the square of `degrees` that a row lies in."""
    return df.withColumns({
        name: F.floor(F.col(c) / F.lit(degrees)).cast("bigint") for name, c in zip(TILE, (lat, lon))})


def tile_degrees(cells: DataFrame, most: int = TILE_CELLS, start: float = TILE_DEGREES) -> float:
    """Side of squares, at most `start`, none of which holds more than `most` of the (distinct) cells.

    One row of statistics a round; two rounds do unless cells crowd together.
    """
    degrees = start
    while True:
        fullest = with_tile(cells, degrees).groupBy(*TILE).count().agg(F.max("count")).first()[0]
        if fullest is None or fullest <= most or degrees < 1e-6:
            return degrees
        degrees /= 2 ** math.ceil(math.log(fullest / most, 4))


def tile_dictionary(
    cells: DataFrame, packed: DataFrame, ids: Column, value: Column, day_keys: Sequence[str], name: str,
    tile: Sequence[str] = TILE,
) -> DataFrame:
    """tile and day with `name`, a map from source to value: what the cells of a tile need of a day, each source once.

    `ids` is the array of sources of a cell and `packed` has them under `_id`; which sources a tile needs does not depend on
    the day. A tile of n cells with k neighbours holds at most n k sources, and few more than lie in it where n is large.
    """
    used = cells.select(*tile, F.explode(ids).alias("_id")).distinct()
    return used.join(packed, "_id").groupBy(*tile, *day_keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("_id"), value.alias("_v")))).alias(name))


def source_dictionary(
    cells: DataFrame, packed: DataFrame, source_id: str, day_keys: Sequence[str], nn: str = "nn", name: str = "_dict",
    tile: Sequence[str] = TILE, k: int = 4,
) -> DataFrame:
    """Tile dictionary of the packed hours of the k neighbours."""
    ids = F.transform(F.slice(nn, 1, k), lambda e: e["id"])
    return tile_dictionary(cells, packed.select(F.col(source_id).alias("_id"), *day_keys, "hours"), ids, F.col("hours"),
                           day_keys, name, tile)


def look_up_sources(
    rows: DataFrame, dictionary: str, nn: str = "nn", k: int = 4, tag: str = "", power: float = 1.0, eps: float = 1e-6,
) -> DataFrame:
    """What `attach_sources` adds, from the joined dictionary of the row's tile and day; drops the dictionary."""
    entry = lambda i, field: F.get(nn, F.lit(i))[field]
    return rows.withColumns({
        f"_{tag}near": entry(0, "dist"),
        **{f"_{tag}w{i}": inverse_distance_weight(entry(i, "dist"), power, eps) for i in range(k)},
        **{f"_{tag}v{i}": F.try_element_at(dictionary, entry(i, "id")) for i in range(k)},
    }).drop(dictionary)


def source_hours(k: int = 4, tag: str = "") -> list[str]:
    """Names of the columns of attached hours."""
    return [f"_{tag}v{i}" for i in range(k)]


def interpolated(value: str, k: int = 4, tag: str = "", cutoff_m: float | None = None) -> Column:
    """Inverse-distance mean of one hour from attached sources whose hours are spread (see `spread_hours`).

    A missing neighbour value leaves both sums; NULL without any value, and where the nearest
    source is farther than `cutoff_m` (the cutoff does not apply to the others).
    """
    # One SQL text per value: built from Columns it would cost hundreds of calls to the driver.
    readings = [(f"_{tag}v{i}.{value}", f"_{tag}w{i}") for i in range(k)]
    total = " + ".join(f"coalesce({w} * {v}, 0D)" for v, w in readings)
    share = " + ".join(f"if({v} IS NULL, 0D, {w})" for v, w in readings)
    near = "true" if cutoff_m is None else f"_{tag}near <= {float(cutoff_m)!r}D"
    return F.expr(f"if({near}, try_divide({total}, nullif({share}, 0D)), NULL)")


def may_broadcast(packed: DataFrame, n_columns: int, budget: int = BROADCAST_BYTES) -> bool:
    return fits_broadcast(packed, budget // (ROW_OVERHEAD_BYTES + HOURS * (16 + 8 * n_columns)))


def idw(
    neighbours: DataFrame, packed: DataFrame, keys: Sequence[str], source_id: str, columns: Sequence[str],
    days: DataFrame | None = None, hour: str = "ph", k: int = 4, power: float = 1.0, eps: float = 1e-6,
    cutoff_m: float | None = None, budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Hourly inverse-distance means: keys, the day if `days` is given, hour and `columns`.

    Every target gets all 24 hours of every day in `days` (one column, bounded by the calendar).
    The packed values are written once. Within `budget` bytes they are broadcast and looked up. Larger ones are
    shipped once to every group of targets that share their nearest source, and looked up there.
    """
    day_keys = list(days.columns) if days is not None else []
    if days is not None:
        packed = packed.join(days, day_keys, "left_semi")
    packed = materialise(packed)
    rows = neighbours
    if days is not None:
        listed = days.agg(F.sort_array(F.collect_set(day_keys[0])).alias("d")).scalar()
        rows = rows.withColumn(day_keys[0], F.explode(listed))
    if may_broadcast(packed, len(columns), budget):
        # The table of neighbours may lie in few files, and each of its rows becomes 24 of every day: they are dealt out first.
        rows = rows.repartition(*keys, *day_keys)
        rows = attach_sources(rows, packed, source_id, day_keys, k=k, power=power, eps=eps)
    else:
        tiled = lambda df: df.withColumn("_tile", F.get("nn", F.lit(0))["id"])
        found = source_dictionary(tiled(neighbours), packed, source_id, day_keys, tile=["_tile"], k=k)
        rows = look_up_sources(tiled(rows).join(found, ["_tile", *day_keys], "left"), "_dict", k=k, power=power, eps=eps)
    spread = spread_hours(rows, source_hours(k), hour)
    return spread.select(
        *keys, *day_keys, hour, *[interpolated(v, k, cutoff_m=cutoff_m).alias(v) for v in columns])
