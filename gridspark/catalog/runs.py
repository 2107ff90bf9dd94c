"""The whole chain from inputs to the regional table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views
from gridspark.catalog.physics import sql_heat_stress
from gridspark.catalog.registry import query, rounded
from gridspark.catalog.space import SQL_FINE, SQL_SUN, SQL_WEATHER, daily_on_grid
from gridspark.catalog.regional import _weighted
from gridspark.functions.humidity import kelvin_to_celsius
from gridspark.plans.fields import neighbour_table
from gridspark.plans.run import CELL, Inputs, mapped_cells, regional_table, regional_table_of, run_days
from gridspark.session import Scratch, materialise, shuffles_freed
from gridspark.sources.sinks import read_long

METRICS = ("temp_C_used", "rh_pct_used", "HI_C", "WBGT_C", "UTCI_C")
# The polynomial of the last one loses digits to cancellation; the one before it is iterated.
DIGITS = {"temp_C_used": 7, "rh_pct_used": 7, "HI_C": 7, "WBGT_C": 3, "UTCI_C": 3}

_ALL = f"""
    select f.cell_id, f.prism_day, f.ph, f.t2m, f.ea, sp, u10, v10, lwdown, lwnet, ghi, dhi, dni, sza, alb
    from ({SQL_FINE}) f join ({SQL_WEATHER}) w using (cell_id, prism_day, ph) join ({SQL_SUN}) s using (cell_id, prism_day, ph)
    join cell_day k on k.cell_id = f.cell_id and k.prism_day = f.prism_day
    where f.td_mean is not null and k.tdmean <> -9999e0"""
_MEANS = f"""
    select tract_code, prism_day, ph, {', '.join(_weighted(m, m) for m in METRICS)}
    from (select h.*, m.tract_code, cos(radians(m.lat)) as w_area, case when p.pop > 0 then p.pop end as w_pop
          from ({sql_heat_stress(_ALL, 'cell_id, prism_day, ph')}) h join cells m using (cell_id)
          join pop_year p on p.cell_id = m.cell_id and p.yr = extract(year from prism_day) where m.tract_code >= 0) a
    group by tract_code, prism_day, ph"""


def inputs_of(v: Views, store: Callable[[DataFrame], DataFrame] = materialise) -> Inputs:
    """All input tables from the carrier views; those that a run reads more than once are stored, as its inputs are."""
    weather = v.acc_hour.join(v.coarse_cells, "src_id").withColumns({n: kelvin_to_celsius(F.col(n)) for n in ("t2m", "d2m")})
    nn = store(neighbour_table(v.cells, v.src, CELL, "src_id"))
    people = v.pop_year.join(v.cells.select("cell_id", "lat", "lon"), "cell_id").drop("cell_id")
    return Inputs(
        daily=store(daily_on_grid(v).drop("cell_id")), coarse=store(weather),
        coarse_grid=v.coarse_cells.select("lat", "lon"), half_hours=store(v.half_hour), weather_nn=nn, radiation_nn=nn,
        cell_regions=v.cells.select("lat", "lon", "tract_code"), codes=v.tract_lut, population=store(people),
        representative=v.tract_points)


SQL_RUN = f"""
    select GEOID, k.prism_day, h.ph, round(pt.lat, 6) as lat, round(pt.lon, 6) as lon, 2010 as pop_year,
           {', '.join(f'round({m}_{w}, {DIGITS[m]}) as {m}_{w}' for m in METRICS for w in ('area', 'pop'))}
    from (select distinct tract_code, prism_day from ({_MEANS}) q where {' or '.join(f'{m}_area is not null' for m in METRICS)}) k
    cross join (select cast(unnest(range(24)) as int) as ph) h
    left join ({_MEANS}) m on m.tract_code = k.tract_code and m.prism_day = k.prism_day and m.ph = h.ph
    join tract_lut l on l.tract_code = k.tract_code left join tract_points pt using (GEOID)"""


@query(SQL_RUN)
def regional_run(v: Views) -> DataFrame:
    inputs = inputs_of(v)
    return _as_compared(regional_table(inputs, inputs.daily.select("prism_day")))


def _as_compared(table: DataFrame) -> DataFrame:
    return rounded(table, 7, lat=6, lon=6, **{f"{m}_{w}": 3 for m in ("WBGT_C", "UTCI_C") for w in ("area", "pop")})


@query(SQL_RUN)
def regional_run_by_shuffle(v: Views) -> DataFrame:
    """The same run when the packed sources are too large to broadcast."""
    inputs = inputs_of(v)
    return _as_compared(regional_table(inputs, inputs.daily.select("prism_day"), broadcast_bytes=0))


def _off(computed: DataFrame, stored: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """prism_day, n, off: stored rows of each day, and keys whose stored values are not the computed ones within storage precision."""
    kept = stored.select(*keys, *[F.col(x).cast("double").alias(f"_{x}") for x in columns], F.lit(1).alias("_n"))

    def apart(x: str) -> Column:
        near = F.abs(F.col(x) - F.col(f"_{x}")) <= 1e-5 * (10 + F.abs(x))
        return ~F.coalesce(near, F.col(x).isNull() & F.col(f"_{x}").isNull())

    both = computed.select(*keys, *columns, F.lit(1).alias("_m")).join(kept, keys, "full")
    off = F.col("_n").isNull() | F.col("_m").isNull() | reduce(or_, map(apart, columns))
    return both.groupBy("prism_day").agg(F.count("_n").alias("n"), F.count(F.when(off, 1)).alias("off"))


@query(f"""
    with c as ({sql_heat_stress(_ALL, 'cell_id, prism_day, ph')}),
    r as ({SQL_RUN.replace('round(pt.lat, 6) as lat, round(pt.lon, 6) as lon, ', '')})
    select 'cells' as output, prism_day, count(*) as n, 0 as off, round(avg(temp_C_used), 2) as temp, round(avg(HI_C), 2) as hi
    from c group by prism_day
    union all select 'regions', prism_day, count(*), 0, round(avg(temp_C_used_area), 2), round(avg(HI_C_pop), 2) from r group by prism_day""")
def run_outputs(v: Views) -> DataFrame:
    """Two outputs of a run, the cells asked for after a first day's regions: each is stored for the days it lacks, and read back.

    off counts what differs from the same tables computed anew: the cells from the inputs, the regions from those cells.
    """
    columns = [f"{m}_{w}" for m in METRICS for w in ("area", "pop")]
    single = [F.col(x).cast("float").alias(x) for x in CELL]
    found = []
    with shuffles_freed(v.spark), Scratch(v.spark) as store:
        inputs = inputs_of(v, store)
        days = store(inputs.daily.select("prism_day").distinct())
        path, cells_path = store.folder(), store.folder()
        first = days.orderBy("prism_day").limit(1)
        assert run_days(v.spark, inputs, first, path, 2010) == 1
        assert run_days(v.spark, inputs, days, path, 2010, long_path=cells_path) == days.count()
        assert run_days(v.spark, inputs, days, path, 2010, long_path=cells_path) == 0
        with Scratch(v.spark) as steps:
            computed = store(mapped_cells(inputs, days, steps))
        # Compared day by day, as they are stored: what one comparison moves is freed before the next.
        for day in sorted(r[0] for r in days.collect()):
            anew, its_day = (df.where(F.col("prism_day") == F.lit(day)) for df in (computed, days))
            cells = read_long(v.spark, cells_path, [day])
            regions = v.spark.read.parquet(path).where(F.col("prism_day") == F.lit(day)).withColumn(
                "ph", (F.col("time").cast("int") + 12) % 24)
            for name, off, stored, temp, hi in (
                ("cells", _off(anew.select(*single, "prism_day", "ph", *METRICS), cells, [*CELL, "prism_day", "ph"], list(METRICS)),
                 cells, "temp_C_used", "HI_C"),
                ("regions", _off(regional_table_of(anew, inputs, its_day), regions, ["GEOID", "prism_day", "ph"], columns),
                 regions, "temp_C_used_area", "HI_C_pop"),
            ):
                found += off.join(stored.groupBy("prism_day").agg(F.avg(temp).alias("temp"), F.avg(hi).alias("hi")), "prism_day").select(
                    F.lit(name), "prism_day", "n", F.col("off").cast("int"), F.round("temp", 2), F.round("hi", 2)).collect()
    # One row for each output and day.
    return v.spark.createDataFrame(found, "output string, prism_day date, n bigint, off int, temp double, hi double")
