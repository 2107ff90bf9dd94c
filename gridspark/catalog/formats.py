"""Queries on file formats: the given tables rendered in an input format and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views
from gridspark.catalog.registry import query, rounded, sql_es, sql_rh, stamp
from gridspark.functions.geo import packed_key
from gridspark.functions.time import shifted_day_of
from gridspark.operators.calendar import realign
from gridspark.operators.quality import worst_groups
from gridspark.operators.reshape import long_to_wide
from gridspark.operators.align import align_layers
from gridspark.session import shared_folder
from gridspark.sources.layers import daily_cells, day_layer_rows, point_metadata
from gridspark.sources.predictions import coarse_predictions, long_predictions, model_predictions, wide_layer_rows
from gridspark.sources.stations import (
    HEAT01_COLUMNS, conus_station_name, load_radiation_stations, parse_heat01, parse_isd_lite, parse_station_history,
    rejected_heat01, rejected_isd_lite, stations_without_coordinates,
)

c = F.col


@query("""
    select lpad(cast(c_custkey as varchar), 6, '0') as USAF, lpad(cast(c_nationkey as varchar), 5, '0') as WBAN,
           lpad(cast(c_custkey as varchar), 6, '0') || '-' || lpad(cast(c_nationkey as varchar), 5, '0') as station_id,
           round(c_acctbal/1e2, 2) as LAT, round(-7e1 - c_acctbal/1e2, 2) as LON
    from customer
    where c_mktsegment <> 'MACHINERY' and c_custkey % 11 <> 0 and c_custkey % 13 <> 0
      and round(c_acctbal/1e2, 2) between 24.0 and 50.5 and round(-7e1 - c_acctbal/1e2, 2) between -125.0 and -66.0
      and 1990 + c_nationkey <= 2010""")
def station_history_filter(v: Views) -> DataFrame:
    k = c("c_custkey")
    lines = v.customer.select(
        k.cast("string").alias("USAF"), c("c_nationkey").cast("string").alias("WBAN"),
        F.when(c("c_mktsegment") == "MACHINERY", "CA").otherwise("US").alias("CTRY"),
        F.when(k % 11 == 0, "").otherwise(F.round(c("c_acctbal") / 100, 2).cast("string")).alias("LAT"),
        F.round(F.lit(-70.0) - c("c_acctbal") / 100, 2).cast("string").alias("LON"),
        F.concat((c("c_nationkey") + 1990).cast("string"), F.lit("0101")).alias("BEGIN"),
        F.when(k % 13 == 0, "unknown").otherwise("20201231").alias("END"))
    out = parse_station_history(lines, "2010-01-01", "2010-12-31")
    return out.select("USAF", "WBAN", "station_id", "LAT", "LON")


# Tenths as written to the file; every 17th temperature and 7th dewpoint is missing, every 29th hour invalid.
_T = "cast(floor(value) as int)"
_LINES = f"""
    select event_id, user_id, ts, case when event_id % 17 = 0 then null else {_T}/1e1 end as t,
           case when event_id % 7 = 0 then null else ({_T} - user_id % 90)/1e1 end as td from events where event_id % 29 <> 0"""


@query(f"""
    select cast(user_id as varchar) as station_id, date_trunc('hour', ts) as time_utc, round(t, 6) as temp_C_obs,
           round({sql_es('td')}, 6) as ea_hPa_obs,
           round(case when td is not null then {sql_rh(sql_es('td'), 't')} end, 6) as rh_pct_obs
    from ({_LINES}) l where t is not null""")
def isd_lite_lines(v: Views) -> DataFrame:
    t = F.floor("value").cast("int")
    k = c("event_id")
    text = F.concat_ws(
        "   ", F.date_format("ts", "yyyy MM dd"), F.when(k % 29 == 0, "25").otherwise(F.date_format("ts", "HH")),
        F.when(k % 17 == 0, "-9999").otherwise(t.cast("string")),
        F.when(k % 7 == 0, "-9999").otherwise((t - c("user_id") % 90).cast("string")),
        F.lit("10132   -9999     36      0 -9999 -9999"))
    lines = v.events.select(c("user_id").cast("string").alias("station_id"), text.alias("value"))
    return rounded(parse_isd_lite(lines))


@query("""
    select cast(user_id as varchar) as station_id, problem, count(*) as n from (
        select user_id, case when event_id % 31 = 0 then 'fields' when event_id % 29 = 0 then 'time'
                             when event_id % 37 = 0 then 'temperature' when event_id % 41 = 0 then 'dewpoint' end as problem from events) l
    where problem is not null group by user_id, problem""")
def rejected_isd_lines(v: Views) -> DataFrame:
    """Lines cut short, of an hour 25, and with letters for numbers, counted by station; missing values are none of them."""
    k = c("event_id")
    value = F.concat_ws(
        " ", F.date_format("ts", "yyyy MM dd"), F.when(k % 29 == 0, "25").otherwise(F.date_format("ts", "HH")),
        F.when(k % 37 == 0, "x12").when(k % 17 == 0, "-9999").otherwise("120"),
        F.when(k % 41 == 0, "1O2").when(k % 7 == 0, "-9999").otherwise("80"), F.lit("10132 -9999 36 0 -9999 -9999"))
    lines = v.events.select(c("user_id").cast("string").alias("station_id"), F.when(
        k % 31 == 0, F.substring_index(value, " ", 5)).otherwise(value).alias("value"))
    return rejected_isd_lite(lines)


@query("""
    select case when user_id % 2 = 0 then 'TX_Even' else 'TX_Odd' end as name, count(*) as n from events
    where event_id % 13 = 0 or event_id % 17 = 0 group by user_id % 2""")
def rejected_csv_lines(v: Views) -> DataFrame:
    """Station files with lines of too few and too many fields."""
    base = shared_folder(v.spark)
    k = c("event_id")
    fields = F.concat_ws(",", k.cast("string"), F.date_format("ts", "yyyyMMddHH"), *[F.lit("1.0")] * (len(HEAT01_COLUMNS) - 2))
    text = F.when(k % 13 == 0, F.substring_index(fields, ",", 9)).when(k % 17 == 0, F.concat(fields, F.lit(",2.0"))).otherwise(fields)
    for rest, name in enumerate(("TX_Even", "TX_Odd")):
        v.events.where(c("user_id") % 2 == rest).select(text.alias("value")).write.text(f"{base}/CRNHE0101-{name}.csv")
    return rejected_heat01(v.spark, f"{base}/CRNHE0101-*.csv").select("name", "n")


@query(f"""
    select lpad(cast(user_id as varchar), 5, '0') as station_id, date_trunc('hour', ts) as time_utc,
           3e1 + user_id % 30 as LAT, -9e1 as LON, round(value, 6) as temp_C_obs, round(event_id % 100 + 1e0, 6) as rh_pct_obs,
           round((event_id % 100 + 1e0)/1e2*{sql_es('value')}, 6) as ea_hPa_obs, round(value*2e0, 6) as HI_C_obs, round(value/2e0, 6) as WBGT_C_obs
    from events where event_id % 50 <> 0 and event_id % 19 <> 0 and event_id % 23 <> 0 and 30 + user_id % 30 between 24.0 and 50.5
      and event_id % 31 <> 0 and event_type <> 'error'""")
def heat01_rows(v: Views) -> DataFrame:
    k = c("event_id")
    text = {
        "WBANNO": F.when(k % 50 == 0, "WBANNO").otherwise(c("user_id").cast("string")),
        "DATE_TIME": F.when(k % 31 == 0, "2024013299").otherwise(F.date_format("ts", "yyyyMMddHH")),
        "LONGITUDE": F.lit("-90.0"), "LATITUDE": (c("user_id") % 30 + 30).cast("string"),
        "RELATIVE_HUMIDITY": F.when(k % 19 == 0, " -9999").otherwise((k % 100 + 1).cast("string")),
        "DRY_BULB_TEMPERATURE_C": F.when(k % 23 == 0, "NA").otherwise(c("value").cast("string")),
        "HEAT_INDEX_C": (c("value") * 2).cast("string"), "WET_BULB_GLOBE_TEMPERATURE_C": (c("value") / 2).cast("string"),
    }
    name = F.when(c("event_type") == "error", "AK_Barrow").otherwise("TX_Austin")
    lines = v.events.where(conus_station_name(name)).select(*[
        text.get(n, F.lit("-9999.0")).alias(n) for n in HEAT01_COLUMNS])
    return rounded(parse_heat01(lines, 2024))


_NO_PLACE = "event_id % 37 = 0 or user_id % 10 = 3"


@query(f"""
    select cast(user_id as varchar) as station_id, ts as time_utc, round(value, 6) as LAT, round(value - 1e2, 6) as LON,
           round(value*2e0, 6) as TMRT_C_obs, round(value/2e0, 6) as UTCI_C_obs from events where not ({_NO_PLACE})""")
def radiation_station_rows(v: Views) -> DataFrame:
    return rounded(load_radiation_stations(_radiation(v)))


def _radiation(v: Views) -> DataFrame:
    lost = F.expr(_NO_PLACE)
    return v.events.select(
        c("user_id").alias("station"), c("ts").alias("timestamp_utc"),
        F.when(lost, F.lit(float("nan"))).otherwise(c("value")).alias("lat"), (c("value") - 100).alias("lon"),
        (c("value") * 2).alias("TMRT_C"), (c("value") / 2).alias("UTCI_C"))


@query(f"""
    select user_id as station_id, count(*) as n from events where {_NO_PLACE} group by user_id order by n desc, user_id limit 10""")
def stations_losing_rows(v: Views) -> DataFrame:
    return stations_without_coordinates(_radiation(v))


@query("""
    select cast(floor(p_partkey/5e1) as bigint) as row, p_partkey % 50 as col, prism_day,
           round(5e1 + (floor(p_partkey/5e1) + 5e-1)*(-8.3e-3), 6) as lat, round(-125e0 + (p_partkey % 50 + 5e-1)*8.3e-3, 6) as lon,
           round(tmin, 6) as tmin, round(tmax, 6) as tmax, round(nullif(tdmean, -9999e0), 6) as tdmean,
           coalesce(tmax > tmin, false) as usable
    from cell_day join part on p_partkey = cell_id""")
def daily_cell_layers(v: Views) -> DataFrame:
    base = v.cell_day.withColumns({"row": F.floor(c("cell_id") / 50).cast("bigint"), "col": c("cell_id") % 50})
    layer = lambda n: base.select("row", "col", "prism_day", c(n).alias("value"))
    out = daily_cells(layer("tmin"), layer("tmax"), layer("tdmean"), -9999.0, (50.0, -125.0), (-8.3e-3, 8.3e-3))
    return rounded(out.withColumn("usable", F.coalesce(c("tmax") > c("tmin"), F.lit(False))))


@query("""
    select round(round_even(lat*1e6, 0)/1e6, 6) as lat, round(round_even(lon*1e6, 0)/1e6, 6) as lon, k.d, k.hr, round(h.t2m - 273.15e0, 6) as t2m
    from (select src_id, d, cast(unnest(range(24)) as int) as hr from (select distinct src_id, d from coarse_hour) a) k
    join coarse_cells using (src_id) left join coarse_hour h on h.src_id = k.src_id and h.d = k.d and h.hr = k.hr""")
def day_layer_hours(v: Views) -> DataFrame:
    rows = v.coarse_hour.join(v.coarse_cells, "src_id")
    wide = long_to_wide(rows, ["lat", "lon", "d"], "t2m", "hr", "t2m_h")
    return rounded(day_layer_rows(wide, "t2m", kelvin=True, reject_duplicates=True))


@query("""
    select s_suppkey as point, round(s_acctbal/1e2, 6) as lat, round(s_acctbal/5e1, 6) as lon from supplier where s_suppkey % 7 <> 0 and s_nationkey <> 3""")
def point_list(v: Views) -> DataFrame:
    lost = lambda bad, x: F.when(~bad, x)
    meta = v.supplier.select(
        c("s_suppkey").alias("point"), lost(c("s_suppkey") % 7 == 0, c("s_acctbal") / 100).alias("latitude"),
        F.when(c("s_nationkey") == 3, F.lit(float("nan"))).otherwise(c("s_acctbal") / 50).alias("longitude"))
    return rounded(point_metadata(meta))


def _sql_key(lat: str, lon: str, decimals: int) -> str:
    return f"cast(round_even({lat}*1e{decimals}, 0) as bigint)*1000000000 + cast(round_even({lon}*1e{decimals}, 0) as bigint)"


_KEYED = f"select src_id, {_sql_key('lat', 'lon', 4)} as key from coarse_cells"


@query(f"""
    select key, prism_day, cast(prism_day as timestamp) - interval 12 hour + to_hours(ph) as time_utc, round(t, 6) as temp_C_era,
           round({sql_es('td')}, 6) as ea_hPa_era, round(case when td is not null and t is not null then {sql_rh(sql_es('td'), 't')} end, 6) as rh_pct_era
    from (select key, cast(case when hr >= 12 then d + 1 else d end as date) as prism_day, cast((hr + 12) % 24 as int) as ph,
                 t2m - 273.15e0 as t, d2m - 273.15e0 as td from coarse_hour join ({_KEYED}) k using (src_id)) a""")
def coarse_product_rows(v: Views) -> DataFrame:
    keyed = v.coarse_cells.select("src_id", packed_key(c("lat"), c("lon"), 4).alias("key"))
    hourly = v.coarse_hour.join(keyed, "src_id").select("key", "d", "hr", "t2m", "d2m")
    return rounded(coarse_predictions(hourly))


@query(f"""
    select key, prism_day, cast(prism_day as timestamp) - interval 12 hour + to_hours(ph) as time_utc, round(a, 6) as temp_C_model,
           round(b, 6) as ea_hPa_model, round(case when a is not null and b is not null then {sql_rh('b', 'a')} end, 6) as rh_pct_model
    from (select {_sql_key('lat', 'lon', 6)} as key, prism_day, cast(unnest(range(24)) as int) as ph, cell_id
          from (select distinct cell_id, prism_day from grid_hour) g join cells using (cell_id) where cell_id in (select c_custkey from customer where c_mktsegment = 'MACHINERY')) k
    left join (select cell_id, prism_day, ph, max(temp_c) as a, max(ea) as b from grid_hour group by cell_id, prism_day, ph) m using (cell_id, prism_day, ph)""")
def wide_product_rows(v: Views) -> DataFrame:
    rows = v.grid_hour.join(v.cells.select("cell_id", "lat", "lon"), "cell_id")
    wanted = v.cells.join(
        v.customer.where("c_mktsegment = 'MACHINERY'").select(c("c_custkey").alias("cell_id")), "cell_id", "left_semi"
    ).select(packed_key(c("lat"), c("lon"), 6).alias("key"))
    layers = {}
    for var, column in (("t2m", "temp_c"), ("ea", "ea")):
        wide = long_to_wide(rows, ["lat", "lon", "prism_day"], column, "ph", f"{var}_ph")
        layers[var] = wide_layer_rows(wide, var, [var], wanted, 6)
    return rounded(model_predictions(align_layers(layers, ["key", "prism_day", "ph"], everywhere=False)))


@query(f"""
    select {_sql_key('lat', 'lon', 6)} as key, prism_day,
           cast(prism_day as timestamp) - interval 12 hour + to_hours(ph) as time_utc, round(temp_c, 6) as temp_C_model, round(rh, 6) as rh_pct_model
    from grid_hour join cells using (cell_id)""")
def long_product_rows(v: Views) -> DataFrame:
    from gridspark.functions.time import time_columns

    rows = v.grid_hour.join(v.cells.select("cell_id", "lat", "lon"), "cell_id").withColumns(
        {**time_columns(c("prism_day"), c("ph")), "temp_C_used": c("temp_c"), "rh_pct_used": c("rh")})
    return rounded(long_predictions(rows, None, ["temp_C_used", "rh_pct_used"]))
