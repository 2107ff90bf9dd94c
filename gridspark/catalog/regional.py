"""Queries on regional means, population years, lookups and data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views
from gridspark.catalog.physics import sql_heat_stress
from gridspark.catalog.registry import query, rounded, settled, sql_heat_index, sql_settled
from gridspark.functions.geo import area_weight
from gridspark.functions.heat import heat_index_c
from gridspark.functions.time import shifted_day
from gridspark.operators.quality import (
    days_to_run, duplicate_keys, match_rate, missing_inputs, uncovered, worst_groups,
)
from gridspark.operators.regions import (
    attach_population, attach_regions, dense_hours, name_regions, region_means, tract_table,
)
from gridspark.plans.heatstress import LAYERS, heat_stress
from gridspark.sources.regions import population_of_years, resolve_population_years

c = F.col


def _weighted(column: str, name: str) -> str:
    return (
        f"sum({column}*w_area)/nullif(sum(case when {column} is not null then w_area end), 0) as {name}_area, "
        f"sum({column}*w_pop)/nullif(sum(case when {column} is not null then w_pop end), 0) as {name}_pop"
    )


_CELLS = f"""
    select tract_code, prism_day, ph, temp_c, rh, {sql_heat_index('temp_c', 'rh')} as hi,
           case when cos(radians(lat)) > 0 then cos(radians(lat)) end as w_area, case when pop > 0 then pop end as w_pop
    from grid_hour join cells using (cell_id) where tract_code >= 0"""
SQL_MEANS = f"""
    select tract_code, prism_day, ph, {_weighted('temp_c', 'temp_c')}, {_weighted('rh', 'rh')}, {_weighted('hi', 'hi')}
    from ({_CELLS}) a group by tract_code, prism_day, ph"""
_COLUMNS = [f"{m}_{w}" for m in ("temp_c", "rh", "hi") for w in ("area", "pop")]
_ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in _COLUMNS)


def cell_hours(v: Views) -> DataFrame:
    """Hourly cell metrics."""
    return v.grid_hour.select("cell_id", "prism_day", "ph", "temp_c", "rh", heat_index_c(c("temp_c"), c("rh")).alias("hi"))


def cell_map(v: Views) -> DataFrame:
    """Everything about a cell in one table, so that hourly rows meet it in one join."""
    return v.cells.select("cell_id", "lat", "tract_code", "pop")


def _means(v: Views) -> DataFrame:
    mapped = attach_regions(cell_hours(v), cell_map(v), ["cell_id"])
    return region_means(
        mapped, ["temp_c", "rh", "hi"], ["tract_code", "prism_day", "ph"], area_weight(c("lat")), c("pop"))


@query(f"select tract_code, prism_day, ph, {_ROUNDED} from ({SQL_MEANS}) m")
def tract_hour_weighted_means(v: Views) -> DataFrame:
    return rounded(_means(v).drop("covered"))


_DENSE = f"""
    select k.tract_code, k.prism_day, h.ph, {', '.join(_COLUMNS)}
    from (select distinct tract_code, prism_day from ({_CELLS}) a where temp_c is not null or rh is not null) k
    cross join (select cast(unnest(range(24)) as int) as ph) h
    left join ({SQL_MEANS}) m on m.tract_code = k.tract_code and m.prism_day = k.prism_day and m.ph = h.ph"""


@query(f"""
    select GEOID, prism_day, ph, round(lat, 6) as lat, round(lon, 6) as lon, {_ROUNDED}
    from ({_DENSE}) d join tract_lut using (tract_code) left join tract_points using (GEOID)""")
def tract_dense_spine(v: Views) -> DataFrame:
    dense = dense_hours(_means(v), ["tract_code", "prism_day"])
    return rounded(name_regions(dense, v.tract_lut, v.tract_points))


@query(f"""
    select GEOID, prism_day, ph, {', '.join(f'round({m}_area, 6) as {m}_area, cast(null as double) as {m}_pop' for m in ('temp_c', 'rh', 'hi'))}
    from ({_DENSE}) d join tract_lut using (tract_code)""")
def tract_area_only(v: Views) -> DataFrame:
    table = tract_table(cell_hours(v), cell_map(v).drop("pop"), v.tract_lut, ["cell_id"], population=False)
    return rounded(table.drop("lat", "lon"))


_STRESS = sql_heat_stress(
    "select l_orderkey, cell_id, prism_day, ph, temp_c as t2m, ea, sp, u10, v10, lwdown, lwnet, ghi, dhi, dni, sza, alb from grid_hour",
    "cell_id, prism_day, ph")
_STRESS_COLUMNS = ("temp_C_used", "rh_pct_used", "HI_C", "WBGT_C", "UTCI_C")


@query(f"""
    select GEOID, k.prism_day, h.ph, {', '.join(f'round({m}_{w}, 3) as {m}_{w}' for m in _STRESS_COLUMNS for w in ('area', 'pop'))}
    from (select distinct tract_code, prism_day from grid_hour join cells using (cell_id) where tract_code >= 0 and temp_c is not null) k
    cross join (select cast(unnest(range(24)) as int) as ph) h
    left join (select tract_code, prism_day, ph, {', '.join(_weighted(m, m) for m in _STRESS_COLUMNS)}
               from (select s.*, tract_code, cos(radians(lat)) as w_area, case when pop > 0 then pop end as w_pop
                     from ({_STRESS}) s join cells using (cell_id) where tract_code >= 0) a group by tract_code, prism_day, ph) m
      on m.tract_code = k.tract_code and m.prism_day = k.prism_day and m.ph = h.ph
    join tract_lut l on l.tract_code = k.tract_code""")
def tract_heat_stress(v: Views) -> DataFrame:
    layers = v.grid_hour.withColumnRenamed("temp_c", "t2m").select("cell_id", "prism_day", "ph", *LAYERS)
    cells = heat_stress(layers)
    return rounded(tract_table(cells, cell_map(v), v.tract_lut, ["cell_id"]).drop("lat", "lon"), 3)


@query("""
    select y.yr, p.pop_year, case when p.pop_year is null then
             case when y.yr > 2020 then 'population ends at 2020' else 'no population for the year' end end as problem
    from (select distinct cast(1990 + p_size as int) as yr from part) y
    left join (select distinct yr as pop_year from pop_year) p on p.pop_year = y.yr or (y.yr < 2000 and p.pop_year = 2000)""")
def population_year_fallback(v: Views) -> DataFrame:
    years = v.part.select((c("p_size") + 1990).alias("yr"))
    return resolve_population_years(years, v.pop_year, strict=False)


@query(f"""
    select tract_code, yr, {sql_settled('(sum(temp_c*pop)/nullif(sum(case when temp_c is not null then pop end), 0))')} as temp_c_pop,
           {sql_settled('(sum(temp_c*w)/nullif(sum(case when temp_c is not null then w end), 0))')} as temp_c_area
    from (select tract_code, y.yr, temp_c, case when q.pop > 0 then q.pop end as pop,
                 case when cos(radians(lat)) > 0 then cos(radians(lat)) end as w
          from grid_hour g join cells m using (cell_id) cross join (select 1998 as yr union all select 2000 union all select 2010) y
          join pop_year q on q.cell_id = g.cell_id and q.yr = case when y.yr < 2000 then 2000 else y.yr end
          where tract_code >= 0) a group by tract_code, yr""")
def weights_population_years(v: Views) -> DataFrame:
    years = v.spark.createDataFrame([(1998,), (2000,), (2010,)], "yr int")
    people = population_of_years(v.pop_year, resolve_population_years(years, v.pop_year))
    each_year = v.cells.select("cell_id", "lat", "tract_code", F.explode(F.array(*[F.lit(y) for y in (1998, 2000, 2010)])).alias("yr"))
    mapped = attach_population(each_year, people.select("cell_id", "yr", "pop"), ["cell_id", "yr"])
    rows = attach_regions(v.grid_hour.select("cell_id", "temp_c"), mapped, ["cell_id"])
    means = region_means(rows, ["temp_c"], ["tract_code", "yr"], area_weight(c("lat")), c("pop"))
    return means.select("tract_code", "yr", *[settled(c(m)).alias(m) for m in ("temp_c_pop", "temp_c_area")])


# Data checks.
@query("""
    select cell_id, prism_day, ph, count(*) as n from grid_hour group by cell_id, prism_day, ph having count(*) > 1""")
def duplicate_cell_hours(v: Views) -> DataFrame:
    return duplicate_keys(v.grid_hour, ["cell_id", "prism_day", "ph"])


@query("""
    select o_orderkey, o_custkey from orders where not exists (
        select 1 from (select distinct user_id from events) e where e.user_id = o_custkey)""")
def coverage_gaps(v: Views) -> DataFrame:
    return uncovered(v.orders.select("o_orderkey", "o_custkey"), v.events.select(c("user_id").alias("o_custkey")), ["o_custkey"])


@query("""
    select count(*) as rows_seen, count(c.cell_id) as rows_matched, round(count(c.cell_id)/cast(count(*) as double), 6) as match_rate
    from grid_hour g left join (select distinct cell_id from cells where tract_code >= 0) c on c.cell_id = g.cell_id""")
def tract_match_rate(v: Views) -> DataFrame:
    return rounded(match_rate(v.grid_hour, v.cells.where("tract_code >= 0"), ["cell_id"]))


@query("""
    select l_suppkey, count(*) as n from lineitem where l_orderkey % 13 = 0 group by l_suppkey order by n desc, l_suppkey limit 10""")
def worst_sources(v: Views) -> DataFrame:
    return worst_groups(v.lineitem, c("l_orderkey") % 13 == 0, "l_suppkey")


@query("""
    select distinct layer, d from (
        select l.layer, cast(e.ts + interval 12 hour as date) - o.o as d
        from events e cross join (select 0 as o union all select 1) o
        cross join (select 'tmin' as layer, 0 as two union all select 'tmax', 0 union all select 'view', 1 union all select 'click', 1 union all select 'error', 1) l
        where l.two >= o.o) need
    where not exists (select 1 from (select event_type as layer, cast(ts as date) as d from events where value > 60
                                     union all select 'tmin', cast(ts as date) from events) h
                      where h.layer = need.layer and h.d = need.d)""")
def missing_layer_days(v: Views) -> DataFrame:
    days = v.events.select(shifted_day(c("ts")).alias("prism_day")).distinct()
    have = v.events.where("value > 60").select(c("event_type").alias("layer"), c("ts").cast("date").alias("d")).unionByName(
        v.events.select(F.lit("tmin").alias("layer"), c("ts").cast("date").alias("d")))
    return missing_inputs(days, have, ["tmin", "tmax"], ["view", "click", "error"])


@query("""
    select distinct cast(o_orderdate as date) as prism_day from orders
    where cast(o_orderdate as date) not in (select cast(l_shipdate as date) from lineitem where l_quantity > 45)""")
def days_still_to_run(v: Views) -> DataFrame:
    days = v.orders.select(c("o_orderdate").cast("date").alias("prism_day")).distinct()
    done = v.lineitem.where("l_quantity > 45").select(c("l_shipdate").cast("date").alias("prism_day"))
    return days_to_run(days, done)
