"""Queries on coordinates, nearest neighbours, interpolation and the fine-grid fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views
from gridspark.catalog.registry import query, rounded, sql_albers, sql_clip, sql_es
from gridspark.catalog.times import PH, PRISM_DAY, SQL_LONGWAVE
from gridspark.functions.geo import albers_xy, area_weight, cell_center, in_conus, packed_key, round_coordinate
from gridspark.functions.humidity import kelvin_to_celsius
from gridspark.functions.missing import sentinel_to_null
from gridspark.functions.time import shifted_day_of
from gridspark.operators.align import align_layers, align_to_sources, common_keys
from gridspark.operators.axis import axis_nearest, grid_nearest
from gridspark.operators.interpolate import idw, pack_hours
from gridspark.operators.neighbours import nearest, nearest_one, neighbour_rows, weighted, with_xy
from gridspark.operators.stations import flag_counts, keep_flags
from gridspark.plans.fields import (
    RADIATION, WEATHER, coarse_weather, neighbour_table, radiation, temperature_and_humidity,
)
from gridspark.plans.grids import grid_table

c = F.col


@query("""
    select cell_id, cast(round_even(lat*1e6, 0) as bigint)*1000000000 + cast(round_even(lon*1e6, 0) as bigint) as key6,
           cast(round_even(lat*1e4, 0) as bigint)*1000000000 + cast(round_even(lon*1e4, 0) as bigint) as key4,
           round(round_even(lat*1e2, 0)/1e2, 6) as lat2, round(greatest(cos(radians(lat)), 0e0), 9) as w_area, 1e0 as w_one,
           lat between 24 and 31 and lon between -99.8 and -66 as inside
    from cells""")
def packed_keys(v: Views) -> DataFrame:
    lat, lon = c("lat"), c("lon")
    return v.cells.select(
        "cell_id", packed_key(lat, lon, 6).alias("key6"), packed_key(lat, lon, 4).alias("key4"),
        F.round(round_coordinate(lat, 2), 6).alias("lat2"), F.round(area_weight(lat), 9).alias("w_area"),
        area_weight(lat, use_cosine=False).alias("w_one"), (lat.between(24, 31) & lon.between(-99.8, -66)).alias("inside"))


@query("""
    select p_partkey, round(30e0 + (p_partkey + 5e-1)*(-8.3e-3), 6) as lat, round(-125e0 + (p_size + 5e-1)*8.3e-3, 6) as lon,
           (30e0 + (p_partkey + 5e-1)*(-8.3e-3)) between 24.0 and 50.5 and (-125e0 + (p_size + 5e-1)*8.3e-3) between -125.0 and -66.0 as in_box
    from part""")
def cell_centers_in_box(v: Views) -> DataFrame:
    lat, lon = cell_center(c("p_partkey"), 30.0, -8.3e-3), cell_center(c("p_size"), -125.0, 8.3e-3)
    return v.part.select("p_partkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), in_conus(lat, lon).alias("in_box"))


_X, _Y = sql_albers("lat", "lon")


def sql_xy(view: str) -> str:
    return f"(select *, {_X} as x, {_Y} as y from {view})"


@query(f"select cell_id, round({_X}, 3) as x, round({_Y}, 3) as y from cells")
def albers_coordinates(v: Views) -> DataFrame:
    x, y = albers_xy(c("lat"), c("lon"))
    return v.cells.select("cell_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""
    select key, lat, lon, round({_X}, 3) as x, round({_Y}, 3) as y
    from (select distinct cast(round_even(lat*1e4, 0) as bigint)*1000000000 + cast(round_even(lon*1e4, 0) as bigint) as key,
                 round(round_even(lat*1e4, 0)/1e4, 6) as lat, round(round_even(lon*1e4, 0)/1e4, 6) as lon
          from grid_hour join cells using (cell_id)) g""")
def distinct_grid(v: Views) -> DataFrame:
    sample = v.grid_hour.join(v.cells, "cell_id").select("lat", "lon")
    out = grid_table(sample, 4)
    return out.select("key", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _sql_nearest_line(value: str, line: str) -> str:
    """Aggregate over all lines: the closer of the lines around the value, the larger on a tie."""
    below, above = f"max({line}) filter ({line} <= {value})", f"min({line}) filter ({line} > {value})"
    return (
        f"case when {below} is null then {above} when {above} is null then {below}"
        f" when {value} - {below} < {above} - {value} then {below} else {above} end"
    )


def _sql_axis(value: str, axis: str, grid: str) -> str:
    return (
        f"(select v, {_sql_nearest_line('v', 'g')} as g from (select distinct {value} as v from cells) t,"
        f" (select distinct {axis} as g from {grid}) l group by v)"
    )


SQL_CELL_GRID = (
    f"select cells.*, a.g as near_lat, b.g as near_lon from cells"
    f" join {_sql_axis('lat', 'lat', 'coarse_cells')} a on a.v = cells.lat"
    f" join {_sql_axis('lon', 'lon', 'coarse_cells')} b on b.v = cells.lon"
)


@query(f"select cell_id, round(near_lat, 6) as near_lat, round(near_lon, 6) as near_lon from ({SQL_CELL_GRID}) n")
def axis_nearest_grid(v: Views) -> DataFrame:
    return rounded(grid_nearest(v.cells, v.coarse_cells).select("cell_id", "near_lat", "near_lon"))


@query(f"""
    select c_custkey, {_sql_nearest_line('v', 'g')} as line
    from (select c_custkey, c_acctbal as v from customer) t,
         (select distinct floor(s_acctbal/5e1)*5e1 as g from supplier) l
    group by c_custkey, v""")
def axis_nearest_value(v: Views) -> DataFrame:
    lines = v.supplier.select((F.floor(c("s_acctbal") / 50) * 50.0).alias("g"))
    return axis_nearest(v.customer, lines, "c_acctbal", "g", "line").select("c_custkey", "line")


def sql_knn(targets: str, key: str, sources: str, source_id: str, k: int) -> str:
    """Brute force: all pairs, ranked."""
    return f"""
        select * from (
            select t.{key} as {key}, s.{source_id} as {source_id}, sqrt((t.x - s.x)*(t.x - s.x) + (t.y - s.y)*(t.y - s.y)) as dist,
                   row_number() over (partition by t.{key} order by sqrt((t.x - s.x)*(t.x - s.x) + (t.y - s.y)*(t.y - s.y)), s.{source_id}) as rank
            from {sql_xy(targets)} t, {sql_xy(sources)} s) r
        where rank <= {k}"""


def _neighbours(v: Views) -> DataFrame:
    return neighbour_table(v.cells, v.src, ["cell_id"], "src_id")


@query(f"""
    select cell_id, cast(rank as int) as rank, src_id, round(dist, 3) as dist, round(1e3/greatest(dist, 1e-6), 6) as w,
           round(min(dist) over (partition by cell_id), 3) as nearest_m
    from ({sql_knn('cells', 'cell_id', 'src', 'src_id', 4)}) k""")
def knn4(v: Views) -> DataFrame:
    # Small blocks, so that both ways of the search are taken.
    nn = nearest(with_xy(v.cells), with_xy(v.src), ["cell_id"], "src_id", 4, max_block=24, direct=0)
    rows = weighted(neighbour_rows(nn, ["cell_id"], "src_id"))
    return rows.select(
        "cell_id", "rank", "src_id", F.round("dist", 3).alias("dist"), F.round(c("w") * 1000, 6).alias("w"),
        F.round("nearest_m", 3).alias("nearest_m"))


SQL_KNN = sql_knn("cells", "cell_id", "src", "src_id", 4)


def sql_idw(values: str, columns: tuple[str, ...], days: str, cutoff: float, source_id: str = "src_id") -> str:
    """Dense targets x days x 24 with inverse-distance means; `values` has source, prism_day, ph."""
    total = ", ".join(
        f"case when max(near) <= {cutoff:.1f} then sum({v}/greatest(dist, 1e-6))/nullif(sum(case when {v} is not null then 1e0/greatest(dist, 1e-6) end), 0) end as {v}"
        for v in columns)
    knn = sql_knn("cells", "cell_id", "src", "src_id", 4).replace("s.src_id as src_id", f"s.src_id as {source_id}")
    return f"""
        select cell_id, prism_day, ph, {total}
        from (select k.*, min(dist) over (partition by cell_id) as near from ({knn}) k) n
        cross join ({days}) dd cross join (select cast(unnest(range(24)) as int) as ph) hh
        left join ({values}) val using ({source_id}, prism_day, ph)
        group by cell_id, prism_day, ph"""


_DAYS = f"select distinct {PRISM_DAY} as prism_day from coarse_hour"


def _rounds(columns: tuple[str, ...], digits: int = 3) -> str:
    return ", ".join(f"round({v}, {digits}) as {v}" for v in columns)


@query(f"""
    select cell_id, prism_day, ph, {_rounds(('sp', 'v10'))}
    from ({sql_idw(f"select src_id, {PRISM_DAY} as prism_day, {PH} as ph, sp, v10 from coarse_hour", ('sp', 'v10'), _DAYS, 1500.0)}) i""")
def idw_hourly(v: Views) -> DataFrame:
    values = v.coarse_hour.select(
        "src_id", shifted_day_of(c("d"), c("hr")).alias("prism_day"), ((c("hr") + 12) % 24).alias("ph"), "sp", "v10")
    packed = pack_hours(values, ["src_id", "prism_day"], ["sp", "v10"])
    days = values.select("prism_day").distinct()
    return rounded(idw(_neighbours(v), packed, ["cell_id"], "src_id", ["sp", "v10"], days, cutoff_m=1500.0), 3)


_WEATHER_VALUES = f"""
    select coalesce(i.src_id, l.src_id) as src_id, coalesce(i.prism_day, l.prism_day) as prism_day, coalesce(i.ph, l.ph) as ph,
           sp, u10, v10, lwdown, lwnet
    from (select src_id, {PRISM_DAY} as prism_day, {PH} as ph, sp, u10, v10 from coarse_hour) i
    full join (select src_id, {PRISM_DAY} as prism_day, {PH} as ph, lwdown, lwnet from ({SQL_LONGWAVE}) w) l
      on i.src_id = l.src_id and i.prism_day = l.prism_day and i.ph = l.ph"""
SQL_WEATHER = sql_idw(_WEATHER_VALUES, WEATHER, _DAYS, 8000.0)


def _days(v: Views) -> DataFrame:
    return v.coarse_hour.select(shifted_day_of(c("d"), c("hr")).alias("prism_day")).distinct()


@query(f"select cell_id, prism_day, ph, {_rounds(WEATHER)} from ({SQL_WEATHER}) i")
def coarse_weather_on_grid(v: Views) -> DataFrame:
    return rounded(coarse_weather(_neighbours(v), v.acc_hour, _days(v), ["cell_id"]), 3)


_HOURLY_SUN = f"""
    select point, d, cast(floor(slot/2e0) as int) as hr,
           case when count(ghi) = 2 then avg(ghi) end as ghi, case when count(dhi) = 2 then avg(dhi) end as dhi,
           case when count(dni) = 2 then avg(dni) end as dni,
           case when count(sza) = 2 then degrees(acos(least(1e0, greatest(-1e0, avg(cos(radians(sza/1e2))))))) end as sza,
           case when count(alb) = 2 then avg({sql_clip('(alb/1e3)', '0e0', '1e0')}) end as alb
    from half_hour group by point, d, cast(floor(slot/2e0) as int)"""
_SUN_VALUES = f"select point, {PRISM_DAY} as prism_day, {PH} as ph, ghi, dhi, dni, sza, alb from ({_HOURLY_SUN}) h"
SQL_SUN = sql_idw(_SUN_VALUES, RADIATION, _DAYS, 4000.0, "point")


@query(f"select cell_id, prism_day, ph, {_rounds(RADIATION)} from ({SQL_SUN}) i")
def radiation_on_grid(v: Views) -> DataFrame:
    nn = neighbour_table(v.cells, v.src, ["cell_id"], "src_id")
    return rounded(radiation(nn, v.half_hour, _days(v), ["cell_id"]), 3)


# Daily fine cells with nodata removed, on their nearest coarse cell.
_DAILY = f"""
    select g.cell_id, g.lat, g.lon, g.near_lat, g.near_lon, k.prism_day, tmin, tmax, nullif(tdmean, -9999e0) as tdmean
    from ({SQL_CELL_GRID}) g join cell_day k using (cell_id)"""
SQL_FINE = f"""
    select cell_id, lat, lon, prism_day, ph, t2m, td_mean,
           case when t2m is not null then {sql_clip(sql_es('td'), f'least(5e-2, {sql_es("t2m")})', sql_es('t2m'))} end as ea
    from (select f.cell_id, f.lat, f.lon, f.prism_day, h.ph, {sql_clip('(tmin + (t.t2m - lo)/(hi - lo)*(tmax - tmin))', 'tmin', 'tmax')} as t2m,
                 case when nd = 24 then t.d2m + (tdmean - md) end as td, case when nd = 24 then md end as td_mean
          from ({_DAILY}) f
          join (select lat as near_lat, lon as near_lon, prism_day, min(t2m) as lo, max(t2m) as hi, avg(d2m) as md, count(d2m) as nd
                from (select src_id, {PRISM_DAY} as prism_day, {PH} as ph, t2m - 273.15e0 as t2m, d2m - 273.15e0 as d2m from coarse_hour) a
                join coarse_cells using (src_id) group by lat, lon, prism_day
                having max(t2m) > min(t2m) and min(ph) < 12 and max(ph) >= 12) s using (near_lat, near_lon, prism_day)
          cross join (select cast(unnest(range(24)) as int) as ph) h
          left join (select lat as near_lat, lon as near_lon, {PRISM_DAY} as prism_day, {PH} as ph, t2m - 273.15e0 as t2m, d2m - 273.15e0 as d2m
                     from coarse_hour join coarse_cells using (src_id)) t using (near_lat, near_lon, prism_day, ph)
          where tmax > tmin) z"""


def daily_on_grid(v: Views) -> DataFrame:
    daily = v.cell_day.withColumn("tdmean", sentinel_to_null(c("tdmean"), -9999.0))
    return daily.join(v.cells.select("cell_id", "lat", "lon"), "cell_id")


def coarse_celsius(v: Views) -> DataFrame:
    return v.coarse_hour.join(v.coarse_cells, "src_id").withColumns({
        n: kelvin_to_celsius(c(n)) for n in ("t2m", "d2m")}).select("lat", "lon", "d", "hr", "t2m", "d2m")


@query(f"select cell_id, prism_day, ph, round(t2m, 6) as t2m, round(ea, 6) as ea from ({SQL_FINE}) f")
def temperature_and_humidity_on_grid(v: Views) -> DataFrame:
    return rounded(temperature_and_humidity(
        daily_on_grid(v), coarse_celsius(v), ["cell_id"], v.coarse_cells))


@query(f"""
    select s.station_id, m.cell_id as cell_id, round(m.dist, 3) as dist_m_model, round(e.dist, 3) as dist_m_era, m.dist <= 800 as keep_model,
           e.dist <= 9000 as keep_era, m.dist <= 800 and e.dist <= 9000 as keep_both
    from stations s join ({sql_knn('stations', 'station_id', 'pred_cells', 'cell_id', 1)}) m using (station_id)
    join ({sql_knn('stations', 'station_id', 'coarse_cells', 'src_id', 1)}) e using (station_id)""")
def station_nearest_cell(v: Views) -> DataFrame:
    placed = with_xy(v.stations)
    out = nearest_one(placed, with_xy(v.pred_cells), ["station_id"], "cell_id", "dist_m_model")
    out = nearest_one(out, with_xy(v.coarse_cells), ["station_id"], "src_id", "dist_m_era")
    return rounded(keep_flags(out).select(
        "station_id", "cell_id", "dist_m_model", "dist_m_era", "keep_model", "keep_era", "keep_both"), 3)


@query(f"""
    select count(*) as candidates, count(*) filter (m.dist <= 800) as n_keep_model, count(*) filter (e.dist <= 9000) as n_keep_era,
           count(*) filter (m.dist <= 800 and e.dist <= 9000) as n_keep_both
    from ({sql_knn('stations', 'station_id', 'pred_cells', 'cell_id', 1)}) m
    join ({sql_knn('stations', 'station_id', 'coarse_cells', 'src_id', 1)}) e using (station_id)""")
def station_flag_counts(v: Views) -> DataFrame:
    placed = with_xy(v.stations)
    out = nearest_one(placed, with_xy(v.pred_cells), ["station_id"], "cell_id", "dist_m_model")
    out = nearest_one(out, with_xy(v.coarse_cells), ["station_id"], "src_id", "dist_m_era")
    return flag_counts(keep_flags(out))



@query("""
    select cell_id, prism_day, ph, round(a, 6) as ta, round(b, 6) as tb, round(g, 6) as tg
    from (select cell_id, prism_day, ph, max(temp_c) as a from grid_hour where l_linenumber % 2 = 0 group by all) x
    join (select cell_id, prism_day, ph, max(ghi) as b from grid_hour where l_linenumber <= 5 group by all) y using (cell_id, prism_day, ph)
    join (select cell_id, prism_day, ph, max(rh) as g from grid_hour where l_linenumber <> 4 group by all) z using (cell_id, prism_day, ph)""")
def layer_alignment(v: Views) -> DataFrame:
    keys = ["cell_id", "prism_day", "ph"]
    g = v.grid_hour
    return rounded(align_layers(_split_layers(g, keys), keys))


def _split_layers(g: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Three layers that each lack some keys."""
    return {
        "ta": g.where("l_linenumber % 2 = 0").groupBy(*keys).agg(F.max("temp_c").alias("ta")),
        "tb": g.where("l_linenumber <= 5").groupBy(*keys).agg(F.max("ghi").alias("tb")),
        "tg": g.where("l_linenumber <> 4").groupBy(*keys).agg(F.max("rh").alias("tg")),
    }


@query("""
    select cell_id, prism_day, ph from grid_hour where l_linenumber % 2 = 0
    intersect select cell_id, prism_day, ph from grid_hour where l_linenumber <= 5
    intersect select cell_id, prism_day, ph from grid_hour where l_linenumber <> 4""")
def common_layer_keys(v: Views) -> DataFrame:
    keys = ["cell_id", "prism_day", "ph"]
    return common_keys(list(_split_layers(v.grid_hour, keys).values()), keys)


@query("""
    select src_id, d, hr, round(sp, 6) as sp from (select distinct src_id from src) s left join coarse_hour using (src_id)""")
def source_alignment(v: Views) -> DataFrame:
    layer = v.coarse_hour.select("src_id", "d", "hr", "sp")
    return rounded(align_to_sources(v.src, layer, ["src_id"], ["src_id", "d", "hr"]))
