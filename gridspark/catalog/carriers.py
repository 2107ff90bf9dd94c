"""The given tables reshaped into the engine's input forms.

One text per view; it runs unchanged in Spark SQL and in the oracle's SQL. Literals carry an
exponent so that both read them as double. Missing values are put in on purpose. Every view
covers its whole table and grows with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("part", "supplier", "customer", "orders", "lineitem", "events")

_FRAC_A = "({0}*7.548776662e-1 - floor({0}*7.548776662e-1))"
_FRAC_B = "({0}*5.698402910e-1 - floor({0}*5.698402910e-1))"
_DAY = "date '2010-07-01' + cast(l_linenumber % 3 as int)"
_HOUR = "cast(l_orderkey % 24 as int)"


def _near(key: str, rows_per_key: str) -> str:
    """Coordinates spread over the strip the fine cells cover."""
    return (
        f"30e0 + ({key}*{rows_per_key} + {_FRAC_A.format(key)})*8.3e-3 as lat, "
        f"-100e0 + 4.15e-1*{_FRAC_B.format(key)} as lon"
    )


VIEWS = {
    # Fine grid of 50 columns, regions of eight cells; every 23rd cell is outside all regions, every 17th is unpopulated.
    "cells": """
        select p_partkey as cell_id, cast(floor(p_partkey/5e1) as bigint) as row_id, p_partkey % 50 as col_id,
               30e0 + floor(p_partkey/5e1)*8.3e-3 as lat, -100e0 + (p_partkey % 50)*8.3e-3 as lon,
               case when p_partkey % 23 = 0 then -1 else cast(floor(p_partkey/8e0) as int) end as tract_code,
               case when p_partkey % 17 = 0 then 0e0 else p_retailprice end as pop
        from {part}""",
    "tract_lut": """
        select distinct tract_code, concat('G', lpad(cast(tract_code as string), 6, '0')) as GEOID
        from {cells} where tract_code >= 0""",
    "tract_points": """
        select GEOID, 30e0 + tract_code*1e-2 as lat, -100e0 + tract_code*1e-2 as lon
        from {tract_lut} where tract_code % 10 <> 0""",
    "pop_year": " union all ".join(
        f"select p_partkey as cell_id, {year} as yr, p_retailprice*({year} - 1999) as pop from {{part}}"
        for year in (2000, 2001, 2010)
    ),
    # Hourly values on the fine grid.
    "grid_hour": f"""
        select l_partkey as cell_id, {_DAY} as prism_day, {_HOUR} as ph,
               case when l_orderkey % 13 = 0 then null else l_quantity - 5e0 end as temp_c,
               l_discount*1e3 as rh, l_tax*2e2 - 4e0 as u10, l_discount*1e2 - 3e0 as v10,
               case when l_orderkey % 19 = 0 then null else l_extendedprice/1e2 end as ghi,
               l_extendedprice*l_tax/1e1 as dhi, l_extendedprice/1.3e2 as dni, l_linenumber*1.8e1 as sza,
               case when l_orderkey % 31 = 0 then null else l_discount*2e0 end as alb,
               2.9e2 + l_quantity*3e0 as lwdown, l_tax*1e3 - 9e1 as lwnet, 9.5e4 + l_extendedprice/1e1 as sp,
               5e-1 + l_quantity/4e0 as ea, l_orderkey, l_linenumber
        from {{lineitem}}""",
    # Coarse regular grid and irregular source points, one per supplier.
    "coarse_cells": """
        select s_suppkey as src_id, 30e0 + floor(s_suppkey/1e1)*3.32e-2 as lat,
               -100e0 + (s_suppkey % 10)*4.15e-2 as lon
        from {supplier}""",
    "src": f"select s_suppkey as src_id, {_near('s_suppkey', '4e-1')} from {{supplier}}",
    "coarse_hour": f"""
        select l_suppkey as src_id, {_DAY} as d, {_HOUR} as hr,
               case when (l_suppkey + l_orderkey % 24) % 37 = 0 then null else avg(l_quantity) + 2.7315e2 end as t2m,
               case when (l_suppkey + l_orderkey % 24) % 61 = 0 then null else min(l_quantity)/2e0 + 2.7015e2 end as d2m,
               9.5e4 + avg(l_extendedprice)/1e1 as sp, avg(l_discount)*1e2 - 5e0 as u10,
               case when (l_suppkey + l_orderkey % 24) % 11 = 0 then null else avg(l_tax)*1e2 - 4e0 end as v10,
               sum(l_extendedprice)*3e0 as down, sum(l_extendedprice*(l_tax - 4e-2))*3e0 as net
        from {{lineitem}} group by l_suppkey, {_DAY}, {_HOUR}, l_orderkey % 24""",
    # Counters that restart every day.
    "acc_hour": """
        select src_id, d, hr, t2m, d2m, sp, u10, v10,
               sum(down) over (partition by src_id, d order by hr) as strd,
               sum(net) over (partition by src_id, d order by hr) as str
        from {coarse_hour}""",
    "half_hour": f"""
        select l_suppkey as point, {_DAY} as d, cast(l_orderkey % 48 as int) as slot,
               case when (l_suppkey + l_orderkey % 48) % 41 = 0 then null else avg(l_extendedprice)/1e2 end as ghi,
               avg(l_extendedprice*l_tax)/1e2 as dhi, avg(l_extendedprice)/1.3e2 as dni,
               avg(l_quantity)*2e2 as sza, avg(l_discount)*2.4e4 - 1e2 as alb
        from {{lineitem}} group by l_suppkey, {_DAY}, cast(l_orderkey % 48 as int), l_orderkey % 48""",
    # Daily extremes on the fine grid; -9999 marks nodata.
    "cell_day": f"""
        select l_partkey as cell_id, {_DAY} as prism_day, min(l_quantity) as tmin, max(l_quantity) as tmax,
               case when (l_partkey + l_linenumber % 3) % 29 = 0 then -9999e0 else avg(l_quantity)/2e0 - 3e0 end as tdmean
        from {{lineitem}} group by l_partkey, {_DAY}, l_linenumber % 3""",
    # Stations, their hourly observations, and predictions on a grid near some of them.
    "stations": f"select c_custkey as station_id, {_near('c_custkey', '2.6666667e-2')}, c_nationkey as nation from {{customer}}",
    "obs_hour": """
        select user_id as station_id, cast(ts as date) as d, cast(extract(hour from ts) as int) as hr,
               avg(value)/1e1 as temp_C_obs, avg(value)/2e1 + 5e-1 as ea_hPa_obs, min(value)/4e0 + 1e1 as rh_pct_obs,
               avg(value)/1e1 - user_id % 9 as td_obs
        from {events} group by user_id, cast(ts as date), cast(extract(hour from ts) as int)""",
    "pred_cells": f"""
        select cell_id, lat + 2e-3 as lat, lon + 1e-3 as lon
        from (select cell_id, {_near('(cell_id*4)', '2.6666667e-2')}
              from (select distinct cast(floor(user_id/4e0) as bigint) as cell_id from {{events}}) a) b""",
    "pred_hour": """
        select cast(floor(user_id/4e0) as bigint) as cell_id, cast(ts as date) as d,
               cast(extract(hour from ts) as int) as hr,
               avg(value)/9.7e0 as temp_C_model, avg(value)/2.1e1 + 4e-1 as ea_hPa_model, min(value)/3.9e0 + 1.1e1 as rh_pct_model,
               max(value)/9.9e0 as temp_C_era, max(value)/1.9e1 as ea_hPa_era,
               case when count(*) > 3 then null else max(value)/4.1e0 + 9e0 end as rh_pct_era
        from {events} group by cast(floor(user_id/4e0) as bigint), cast(ts as date), cast(extract(hour from ts) as int)""",
}


def _names(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


class Views:
    """Carrier views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                text = VIEWS[name]
                df = self.spark.sql(text, **{n: getattr(self, n) for n in set(_names(text))})
            else:
                raise AttributeError(name)
            self._made[name] = df
        return self._made[name]


def with_views(body: str) -> str:
    """`body` with a WITH clause for every view it reads, directly or through another view.

    A body may start with its own `WITH name AS (...)`.
    """
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                ordered.append(name)

    need(body)
    clauses = []
    for name in ordered:
        text = VIEWS[name]
        clauses.append(f"{name} as ({text.format(**{n: n for n in _names(text)})})")
    body = body.strip()
    own = re.match(r"with\s+(?!recursive)", body, re.IGNORECASE)
    if own:
        return f"with {', '.join([*clauses, body[own.end():]])}"
    return f"with {', '.join(clauses)} {body}" if clauses else body
