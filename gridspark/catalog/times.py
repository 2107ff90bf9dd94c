"""Queries on days, hours, reshaping, resampling and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views
from gridspark.catalog.registry import query, rounded, sql_clip, stamp
from gridspark.functions.time import (
    day_timestamps, in_day_range, pack_time, season, shifted_day, shifted_hour, stamp_from_parts, stamp_from_text,
    time_columns, unpack_time, window_label, window_tag,
)
from gridspark.operators.accumulate import deaccumulate, longwave
from gridspark.operators.calendar import present_both_days, realign
from gridspark.operators.metrics import variable_label
from gridspark.operators.reshape import half_hour_to_hour, hour_columns, long_to_wide, wide_to_long
from gridspark.operators.templates import day_anomalies, full_day_mean

c = F.col

# SQL of a UTC day and hour realigned to the 12Z-to-12Z day.
PRISM_DAY = "cast(case when hr >= 12 then d + 1 else d end as date)"
PH = "cast((hr + 12) % 24 as int)"


@query("""
    select event_id, cast(ts + interval 12 hour as date) as prism_day,
           cast((extract(hour from ts) + 12) % 24 as int) as ph
    from events""")
def prism_day_of_event(v: Views) -> DataFrame:
    return v.events.select("event_id", shifted_day(c("ts")).alias("prism_day"), shifted_hour(c("ts")).alias("ph"))


@query(f"""
    select src_id, prism_day, ph, round(t2m, 6) as t2m
    from (select *, max(case when ph < 12 then 1 else 0 end) over (partition by src_id, prism_day) as early,
                 max(case when ph >= 12 then 1 else 0 end) over (partition by src_id, prism_day) as late
          from (select src_id, {PRISM_DAY} as prism_day, {PH} as ph, t2m from coarse_hour) a) b
    where early = 1 and late = 1""")
def prism_day_realign(v: Views) -> DataFrame:
    rows = realign(v.coarse_hour.select("src_id", "d", "hr", "t2m"))
    return rounded(present_both_days(rows, ["src_id"]).select("src_id", "prism_day", "ph", "t2m"))


@query("""
    select prism_day, time_utc from (
        select prism_day, unnest(generate_series(cast(prism_day as timestamp) - interval 12 hour,
               cast(prism_day as timestamp) + interval 11 hour, interval 1 hour)) as time_utc
        from (select distinct cast(ts + interval 12 hour as date) as prism_day from events) a) b""")
def prism_day_hours(v: Views) -> DataFrame:
    days = v.events.select(shifted_day(c("ts")).alias("prism_day")).distinct()
    return days.select("prism_day", F.explode(day_timestamps(c("prism_day"))).alias("time_utc"))


@query("""
    select l_orderkey, l_linenumber, cell_id, cast(extract(year from u) as int) as year,
           cast(extract(month from u) as int) as month, cast(extract(day from u) as int) as day,
           cast((ph + 12) % 24 as int) as time, cast(extract(year from prism_day) as int) as p_year,
           cast(extract(day from prism_day) as int) as p_day, ph as p_time,
           cast(extract(year from u) as bigint)*1000000 + cast(extract(month from u) as bigint)*10000
             + cast(extract(day from u) as bigint)*100 + (ph + 12) % 24 as time_key,
           cast(extract(day from u) as int) as day_back, cast((ph + 12) % 24 as int) as time_back
    from (select *, cast(case when ph < 12 then prism_day - 1 else prism_day end as date) as u from grid_hour) g""")
def time_columns_both_modes(v: Views) -> DataFrame:
    utc = time_columns(c("prism_day"), c("ph"), "utc")
    label = time_columns(c("prism_day"), c("ph"), "prism")
    key = pack_time(utc["year"], utc["month"], utc["day"], utc["time"])
    back = unpack_time(key)
    return v.grid_hour.select(
        "l_orderkey", "l_linenumber", "cell_id", *[x.alias(n) for n, x in utc.items()],
        label["year"].alias("p_year"), label["day"].alias("p_day"), label["time"].alias("p_time"),
        key.alias("time_key"), back["day"].alias("day_back"), back["time"].alias("time_back"))


_SEASON = """case when month({0}) in (12, 1, 2) then 'DJF' when month({0}) in (3, 4, 5) then 'MAM'
    when month({0}) in (6, 7, 8) then 'JJA' else 'SON' end"""


@query(f"""
    select o_orderkey, {_SEASON.format('o_orderdate')} as season,
           case when month(a) = month(b) then strftime(a, '%Y %b %d') || '–' || strftime(b, '%d')
                else strftime(a, '%Y %b %d') || '–' || strftime(b, '%b %d') end || ' (' || {_SEASON.format('a')} || ')' as label,
           case when a = b then strftime(a, '%Y-%m-%d') else strftime(a, '%Y-%m-%d') || '_to_' || strftime(b, '%Y-%m-%d') end as tag
    from (select o_orderkey, o_orderdate, cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(o_orderkey % 9 as int) as b from orders) o""")
def season_and_window_labels(v: Views) -> DataFrame:
    day = c("o_orderdate").cast("date")
    end = F.date_add(day, (c("o_orderkey") % 9).cast("int"))
    return v.orders.select(
        "o_orderkey", season(day).alias("season"), window_label(day, end).alias("label"), window_tag(day, end).alias("tag"))


@query("""
    select p_partkey, case p_size % 8 when 0 then 'Air temperature (°C)' when 1 then 'Vapor pressure (hPa)'
        when 2 then 'Relative humidity (%)' when 3 then 'Heat Index (°C)' when 4 then 'Wet-Bulb Globe Temperature (°C)'
        when 5 then 'Mean radiant temperature (°C)' when 6 then 'UTCI (°C)' else 'other' end as label
    from part""")
def variable_labels(v: Views) -> DataFrame:
    names = ["temp_C", "ea_hPa", "rh_pct", "HI_C", "WBGT_C", "TMRT_C", "UTCI_C", "other"]
    name = F.get(F.array(*[F.lit(n) for n in names]), c("p_size") % 8)
    return v.part.select("p_partkey", variable_label(name).alias("label"))


@query("""
    select o_orderkey,
           try_strptime(case when o_orderkey % 7 = 0 then '20011399' else strftime(o_orderdate, '%Y%m%d') end
                        || lpad(cast(o_orderkey % 30 as varchar), 2, '0'), '%Y%m%d%H') as from_text,
           case when o_orderkey % 40 < 24 then
             try_strptime(cast(2000 + o_orderkey % 3 as varchar) || '-' || cast(o_orderkey % 14 as varchar) || '-'
               || cast(o_orderkey % 33 as varchar) || ' ' || cast(o_orderkey % 40 as varchar), '%Y-%m-%d %H') end as from_parts
    from orders""")
def timestamps_from_text(v: Views) -> DataFrame:
    k = c("o_orderkey")
    text = F.concat(
        F.when(k % 7 == 0, F.lit("20011399")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")),
        F.lpad((k % 30).cast("string"), 2, "0"))
    part = lambda x: x.cast("int")
    return v.orders.select(
        "o_orderkey", stamp_from_text(text).alias("from_text"),
        stamp_from_parts(part(2000 + k % 3), part(k % 14), part(k % 33), part(k % 40)).alias("from_parts"))


@query("""
    select station_id, w.w as window_id, count(*) as n
    from obs_hour join (select 1 as w, date '2024-01-05' as a, date '2024-01-11' as b
                        union all select 2, date '2024-01-11', date '2024-01-20') w
      on d + to_hours(hr) >= cast(a as timestamp) - interval 12 hour and d + to_hours(hr) < cast(b as timestamp) + interval 12 hour
    group by station_id, w.w""")
def observation_window(v: Views) -> DataFrame:
    obs = v.obs_hour.withColumn("time_utc", stamp("d", "hr"))
    spans = [(1, "2024-01-05", "2024-01-11"), (2, "2024-01-11", "2024-01-20")]
    hits = [
        obs.where(in_day_range(c("time_utc"), F.lit(a).cast("date"), F.lit(b).cast("date"))).withColumn("window_id", F.lit(i))
        for i, a, b in spans
    ]
    return hits[0].unionByName(hits[1]).groupBy("station_id", "window_id").agg(F.count(F.lit(1)).alias("n"))


_PIVOT = ", ".join(f"round(max(case when hr = {h} then t2m end), 6) as t2m_h{h:02d}" for h in range(24))


@query(f"select src_id, d, {_PIVOT} from coarse_hour group by src_id, d")
def pivot_hours(v: Views) -> DataFrame:
    return rounded(long_to_wide(v.coarse_hour, ["src_id", "d"], "t2m", "hr", "t2m_h"))


@query("""
    select k.src_id, k.d, k.hr, round(h.t2m - 273.15e0, 6) as t2m
    from (select src_id, d, cast(unnest(range(24)) as int) as hr from (select distinct src_id, d from coarse_hour) a) k
    left join coarse_hour h on h.src_id = k.src_id and h.d = k.d and h.hr = k.hr""")
def unpivot_hours(v: Views) -> DataFrame:
    wide = long_to_wide(v.coarse_hour, ["src_id", "d"], "t2m", "hr", "t2m_h")
    rows = wide_to_long(wide, ["src_id", "d"], hour_columns(wide.columns, ["none", "t2m"]), "t2m")
    return rounded(rows.withColumn("t2m", c("t2m") - F.lit(273.15)))


def _half(expr: str) -> str:
    return f"select point, d, cast(floor(slot/2e0) as int) as hr, {expr} from half_hour group by point, d, cast(floor(slot/2e0) as int)"


@query(_half("round(case when count(ghi) = 2 then avg(ghi) end, 9) as ghi"))
def half_hour_flux(v: Views) -> DataFrame:
    return rounded(half_hour_to_hour(v.half_hour, ["point", "d"], {"ghi": "flux"}), 9)


@query(_half(f"round(case when count(alb) = 2 then avg({sql_clip('(alb/1e3)', '0e0', '1e0')}) end, 6) as alb"))
def half_hour_albedo(v: Views) -> DataFrame:
    return rounded(half_hour_to_hour(v.half_hour, ["point", "d"], {"alb": "albedo"}))


@query(_half("round(case when count(sza) = 2 then degrees(acos(least(1e0, greatest(-1e0, avg(cos(radians(sza/1e2))))))) end, 6) as sza"))
def half_hour_zenith(v: Views) -> DataFrame:
    return rounded(half_hour_to_hour(v.half_hour, ["point", "d"], {"sza": "zenith"}))


def sql_flux(value: str) -> str:
    """De-accumulated hourly flux of a counter in acc_hour: lead over the whole series of a source."""
    w = "over (partition by src_id order by d, hr)"
    return (
        f"case when lead(d + to_hours(hr)) {w} = d + to_hours(hr) + interval 1 hour"
        f" then (lead({value}) {w} - case when hr = 0 then 0e0 else {value} end)/3600e0 end"
    )


@query(f"select src_id, d, hr, round({sql_flux('strd')}, 6) as strd from acc_hour")
def deaccumulate_flux(v: Views) -> DataFrame:
    return rounded(deaccumulate(v.acc_hour, ["src_id"], ["strd"]))


SQL_LONGWAVE = f"""
    select src_id, d, hr, case when down >= 0 then down end as lwdown, net as lwnet, down - net as lwup
    from (select src_id, d, hr, {sql_flux('strd')} as down, {sql_flux('str')} as net from acc_hour) f"""


@query(f"""
    select src_id, {PRISM_DAY} as prism_day, {PH} as ph, round(lwdown, 8) as lwdown, round(lwnet, 8) as lwnet, round(lwup, 8) as lwup
    from ({SQL_LONGWAVE}) l""")
def longwave_flux(v: Views) -> DataFrame:
    return rounded(realign(longwave(v.acc_hour, ["src_id"])).select("src_id", "prism_day", "ph", "lwdown", "lwnet", "lwup"), 8)


@query(f"""
    select src_id, prism_day, ph, round(m, 6) as day_mean, round(t2m - m, 6) as anomaly, round(lo - m, 6) as amin,
           round(hi - m, 6) as amax, round(case when hi > lo then (t2m - lo)/(hi - lo) end, 6) as frac
    from (select *, avg(t2m) over w as m, min(t2m) over w as lo, max(t2m) over w as hi
          from (select src_id, {PRISM_DAY} as prism_day, {PH} as ph, t2m from coarse_hour) a
          window w as (partition by src_id, prism_day)) b""")
def prism_window_stats(v: Views) -> DataFrame:
    rows = realign(v.coarse_hour.select("src_id", "d", "hr", "t2m"))
    out = day_anomalies(rows, ["src_id"], "t2m")
    return rounded(out.select("src_id", "prism_day", "ph", "day_mean", "anomaly", "amin", "amax", "frac"))


@query(f"""
    select src_id, prism_day, round(avg(d2m), 6) as day_mean
    from (select src_id, {PRISM_DAY} as prism_day, d2m from coarse_hour) a
    group by src_id, prism_day having count(d2m) = 24""")
def full_day_dewpoint(v: Views) -> DataFrame:
    return rounded(full_day_mean(realign(v.coarse_hour.select("src_id", "d", "hr", "d2m")), ["src_id"], "d2m"))
