"""Queries on stations, matching and error statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views
from gridspark.catalog.registry import query, rounded, stamp
from gridspark.catalog.space import sql_knn
from gridspark.functions.time import shifted_day
from gridspark.operators.metrics import all_metrics, metrics_suite
from gridspark.operators.percentile import exact_percentiles
from gridspark.operators.stations import (
    first_coordinates, keep_flags, on_stations, spread_subset, wanted_cells, with_observations,
)
from gridspark.plans.validation import (
    TABLE_HEADS, in_windows, isd_comparisons, isd_paired, map_stations, network_comparison, summary_table, surfrad_comparison,
    uscrn_comparisons, window_extract, windows_of, write_validation,
)
from gridspark.operators.neighbours import with_xy
from gridspark.session import materialise, shared_folder
from gridspark.streaming.live_metrics import live_metrics

c = F.col
MET = ("temp_C", "ea_hPa", "rh_pct")

# Station s sits on cell s/4; both sides share date and hour.
_PAIRS = """
    select o.station_id, cast(case when o.hr >= 12 then o.d + 1 else o.d end as date) as prism_day, o.d, o.hr,
           o.temp_C_obs, o.ea_hPa_obs, o.rh_pct_obs, p.* exclude (cell_id, d, hr)
    from obs_hour o join pred_hour p on p.cell_id = cast(floor(o.station_id/4e0) as bigint) and p.d = o.d and p.hr = o.hr"""


def observations(v: Views) -> DataFrame:
    return v.obs_hour.withColumn("time_utc", stamp("d", "hr")).drop("d", "hr", "td_obs")


def predictions(v: Views) -> DataFrame:
    """Predictions by key and time, with the day label."""
    return v.pred_hour.withColumn("time_utc", stamp("d", "hr")).withColumn("prism_day", shifted_day(c("time_utc"))).drop(
        "d", "hr").withColumnRenamed("cell_id", "key")


def _station_keys(v: Views) -> DataFrame:
    return v.events.select(c("user_id").alias("station_id")).distinct().withColumn(
        "key", F.floor(c("station_id") / 4).cast("bigint"))


def _pairs(v: Views) -> DataFrame:
    placed = observations(v).join(_station_keys(v), "station_id")
    return placed.join(predictions(v), ["key", "time_utc"])


def _sql_stats(variable: str, prefix: str = "", product: str = "model") -> str:
    e = f"({variable}_{product} - {variable}_obs)"
    name = lambda s: f"{prefix}_{s}" if prefix else s
    return (
        f"count({e}) as {name('N')}, round(avg({e}), 7) as {name('bias')}, round(avg(abs({e})), 7) as {name('mae')}, "
        f"round(sqrt(avg({e}*{e})), 7) as {name('rmse')}"
    )


def _by_variable(template: str) -> str:
    return " union all ".join(template.format(v=v, stats=_sql_stats(v)) for v in MET)


@query(_by_variable(f"select '{{v}}' as var, {{stats}} from ({_PAIRS}) p"))
def pred_obs_metrics_overall(v: Views) -> DataFrame:
    suite = metrics_suite(_pairs(v), MET, "x", "_model", store=False)
    return _plain(suite["overall"])


@query(_by_variable(f"select '{{v}}' as var, station_id, {{stats}} from ({_PAIRS}) p group by station_id"))
def pred_obs_metrics_by_station(v: Views) -> DataFrame:
    return _plain(metrics_suite(_pairs(v), MET, "x", "_model", store=False)["by_station"])


@query(_by_variable(f"select '{{v}}' as var, prism_day, {{stats}} from ({_PAIRS}) p group by prism_day"))
def pred_obs_metrics_by_day(v: Views) -> DataFrame:
    return _plain(metrics_suite(_pairs(v), MET, "x", "_model", store=False)["by_day"])


def _plain(df: DataFrame) -> DataFrame:
    return rounded(df.withColumnsRenamed({f"x_{s}": s for s in ("N", "bias", "mae", "rmse")}), 7)


@query(_by_variable(f"""
    select case grouping(station_id, prism_day) when 3 then 'overall' when 1 then 'station' else 'day' end as level, '{{v}}' as var,
           coalesce(station_id, -1) as station_id, coalesce(strftime(prism_day, '%Y-%m-%d'), '') as prism_day, {{stats}} from ({_PAIRS}) p group by grouping sets ((), (station_id), (prism_day))"""))
def pred_obs_metrics_all_levels(v: Views) -> DataFrame:
    out = all_metrics(_pairs(v), MET, "_model").withColumns({
        "station_id": F.coalesce("station_id", F.lit(-1)), "prism_day": F.coalesce(c("prism_day").cast("string"), F.lit(""))})
    return rounded(out, 7)


_NINE = " and ".join(f"{v}_{s} is not null" for v in MET for s in ("obs", "model", "era"))


@query(" union all ".join(f"""
    select '{x}' as var, count(*) as paired_N,
           round(avg({x}_model - {x}_obs), 7) as model_bias, round(avg(abs({x}_model - {x}_obs)), 7) as model_mae,
           round(sqrt(avg(({x}_model - {x}_obs)*({x}_model - {x}_obs))), 7) as model_rmse,
           round(avg({x}_era - {x}_obs), 7) as era_bias, round(avg(abs({x}_era - {x}_obs)), 7) as era_mae,
           round(sqrt(avg(({x}_era - {x}_obs)*({x}_era - {x}_obs))), 7) as era_rmse,
           round(sqrt(avg(({x}_era - {x}_obs)*({x}_era - {x}_obs))) - sqrt(avg(({x}_model - {x}_obs)*({x}_model - {x}_obs))), 7) as rmse_era_minus_model
    from ({_PAIRS}) p where {_NINE}""" for x in MET))
def paired_metrics_two_products(v: Views) -> DataFrame:
    stations = _station_keys(v).select(
        "station_id", c("key").alias("key_model"), c("key").alias("key_era"), F.lit(True).alias("keep_both"))
    model = predictions(v).select("key", "time_utc", "prism_day", *[f"{x}_model" for x in MET])
    coarse = predictions(v).select("key", "time_utc", "prism_day", *[f"{x}_era" for x in MET])
    return rounded(isd_paired(stations, observations(v), model, coarse), 7)


@query("""
    select l_suppkey, round(median(l_extendedprice), 6) as p50, round(quantile_cont(l_extendedprice, 0.9), 6) as p90
    from lineitem group by l_suppkey""")
def group_percentiles(v: Views) -> DataFrame:
    return rounded(exact_percentiles(v.lineitem, ["l_suppkey"], "l_extendedprice", {"p50": 0.5, "p90": 0.9}))


@query("""
    select station_id, p.d, p.hr, round(temp_C_model, 6) as temp_C_model
    from pred_hour p join (select distinct user_id as station_id, cast(floor(user_id/4e0) as bigint) as cell_id from events) s using (cell_id)""")
def station_cell_broadcast(v: Views) -> DataFrame:
    layer = v.pred_hour.select(c("cell_id").alias("key"), "d", "hr", "temp_C_model")
    return rounded(on_stations(layer, _station_keys(v), ["key"]).select("station_id", "d", "hr", "temp_C_model"))


@query("""
    select cell_id, prism_day, ph, round(ghi, 6) as ghi from grid_hour
    where cell_id in (select p_partkey from part where p_brand = 'Brand#7')""")
def wanted_cells_only(v: Views) -> DataFrame:
    wanted = v.part.where("p_brand = 'Brand#7'").select(c("p_partkey").alias("cell_id"))
    return rounded(wanted_cells(v.grid_hour, wanted, ["cell_id"]).select("cell_id", "prism_day", "ph", "ghi"))


@query("select station_id, nation from stations where station_id in (select user_id from events)")
def stations_with_observations(v: Views) -> DataFrame:
    return with_observations(v.stations, v.events.select(c("user_id").alias("station_id"))).select("station_id", "nation")


@query("""
    select user_id as station_id, arg_min(value, ts) as LAT, arg_min(value*2e0, ts) as LON from events group by user_id""")
def first_station_coordinates(v: Views) -> DataFrame:
    obs = v.events.select(
        c("user_id").alias("station_id"), c("ts").alias("time_utc"), c("value").alias("LAT"), (c("value") * 2).alias("LON"))
    return first_coordinates(obs)


@query("""
    select station_id, nation from (
        select *, row_number() over (partition by floor(lat/2e-2), floor(lon/5e-2) order by (station_id*7919) % 104729, station_id) as rnd,
               (station_id*7919) % 104729 as o from stations) a
    order by rnd, o, station_id limit 500""")
def stratified_stations(v: Views) -> DataFrame:
    # Squares in degrees are passed as multiples of one step, so longitude is scaled to match.
    s = v.stations.withColumn("lon_scaled", c("lon") / 2.5)
    out = spread_subset(s, 500, step_deg=0.02, lat="lat", lon="lon_scaled", order=(c("station_id") * 7919) % 104729)
    return out.select("station_id", "nation")


# Windows, distance rules and the summary table, by brute force.
WINDOWS = [("2024-01-03", "2024-01-09"), ("2024-01-15", "2024-01-21"), ("2024-01-20", "2024-01-31")]
_WINDOWS = " union all ".join(f"select {i} as window_id, date '{a}' as a, date '{b}' as b" for i, (a, b) in enumerate(WINDOWS))
_LABEL = """case when month(a) = month(b) then strftime(a, '%Y %b %d') || '–' || strftime(b, '%d')
    else strftime(a, '%Y %b %d') || '–' || strftime(b, '%b %d') end || ' (DJF)'"""
_MAPPED = f"""
    select m.station_id, m.cell_id, m.dist as dist_model, e.src_id % (select count(*) from pred_cells) as era_cell, e.dist as dist_era
    from ({sql_knn('stations', 'station_id', 'pred_cells', 'cell_id', 1)}) m
    join ({sql_knn('stations', 'station_id', 'coarse_cells', 'src_id', 1)}) e using (station_id)"""


def _sql_table(product: str, reference: str, label: str, near: str, cell: str, dist: str, suffix: str, variables: dict[str, str]) -> str:
    rows = []
    for var, name in variables.items():
        e = f"({var}_{suffix} - {var}_obs)"
        rows.append(f"""
            select {_LABEL} as window_label, strftime(a, '%Y-%m-%d') as window_start, strftime(b, '%Y-%m-%d') as window_end,
                   '{product}' as product, '{reference}' as reference, '{name}' as variable, n_stations, n_hours,
                   '{label}' as distance_filter, round(p50, 3) as dist_median_m, round(p90, 3) as dist_p90_m,
                   round(bias, 6) as bias, round(rmse, 6) as rmse
            from (select window_id, a, b, count(*) as n_stations, cast(sum(n) as bigint) as n_hours, median(d) as p50, quantile_cont(d, 0.9) as p90,
                         sum(s)/sum(n) as bias, sqrt(sum(q)/sum(n)) as rmse
                  from (select window_id, a, b, station_id, max({dist}) as d, count({e}) as n, sum({e}) as s, sum({e}*{e}) as q
                        from obs_hour o join mapped using (station_id) join ({_WINDOWS}) w
                          on cast(case when o.hr >= 12 then o.d + 1 else o.d end as date) between a and b
                        join pred_hour p on p.cell_id = {cell} and p.d = o.d and p.hr = o.hr
                        where {near} group by window_id, a, b, station_id) x
                  where n > 0 group by window_id, a, b) y""")
    return " union all ".join(rows)


_NAMES = {"temp_C": "Air temperature (°C)", "ea_hPa": "Vapor pressure (hPa)", "rh_pct": "Relative humidity (%)"}
_MODEL_ROWS = _sql_table("gridded meteorology", "ISD-Lite", "≤800 m", "dist_model <= 800", "mapped.cell_id", "dist_model", "model", _NAMES)
_ERA_ROWS = _sql_table("ERA5-Land meteorology", "ISD-Lite", "≤9 km", "dist_era <= 9000", "era_cell", "dist_era", "era", _NAMES)
_TABLE = f"with mapped as ({_MAPPED}) select * from ({_MODEL_ROWS} union all {_ERA_ROWS}) t"


def _mapped_stations(v: Views) -> DataFrame:
    stations = v.stations.withColumnsRenamed({"lat": "LAT", "lon": "LON"})
    cells = with_xy(v.pred_cells).withColumnRenamed("cell_id", "key")
    coarse = with_xy(v.coarse_cells).withColumnRenamed("src_id", "key")
    out = map_stations(map_stations(stations, cells, "model"), coarse, "era")
    n = v.pred_cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    return keep_flags(out.withColumn("key_era", c("key_era") % n))


def _table(v: Views) -> DataFrame:
    windows = windows_of(v.spark, WINDOWS)
    obs = materialise(in_windows(observations(v), windows))
    model = predictions(v).select("key", "time_utc", "prism_day", *[f"{x}_model" for x in MET])
    coarse = predictions(v).select("key", "time_utc", "prism_day", *[f"{x}_era" for x in MET])
    return summary_table(isd_comparisons(_mapped_stations(v), obs, model, coarse), windows)


@query(_TABLE)
def validation_table(v: Views) -> DataFrame:
    return rounded(_table(v), dist_median_m=3, dist_p90_m=3)


@query(f"{_TABLE} where window_start = '2024-01-15' and window_end = '2024-01-21'")
def validation_window_extract(v: Views) -> DataFrame:
    return rounded(window_extract(_table(v), "2024-01-15", "2024-01-21"), dist_median_m=3, dist_p90_m=3)


@query(f"with mapped as ({_MAPPED}) " + _sql_table(
    "gridded meteorology", "USCRN (heat01)", "≤800 m", "dist_model <= 800", "mapped.cell_id", "dist_model", "model", _NAMES))
def network_validation(v: Views) -> DataFrame:
    windows = windows_of(v.spark, WINDOWS)
    placed = v.stations.select("station_id", c("lat").alias("LAT"), c("lon").alias("LON"))
    obs = in_windows(observations(v).join(placed, "station_id"), windows)
    cells = with_xy(v.pred_cells).withColumnRenamed("cell_id", "key")
    model = predictions(v).select("key", "time_utc", "prism_day", *[f"{x}_model" for x in MET])
    found = network_comparison(obs, cells, model, "gridded meteorology", "USCRN (heat01)", MET)
    return rounded(summary_table([found], windows), dist_median_m=3, dist_p90_m=3)


# Heat-stress and radiant values of the other networks, made from the same carriers.
_OBS_MORE = """(select *, temp_C_obs*1.1e0 as HI_C_obs, temp_C_obs*9e-1 as WBGT_C_obs, temp_C_obs*2e0 as TMRT_C_obs,
    case when station_id % 5 = 0 then null else temp_C_obs + 3e0 end as UTCI_C_obs from obs_hour)"""
_PRED_MORE = """(select *, temp_C_era*1.1e0 as HI_C_model, ea_hPa_era + 4e0 as WBGT_C_model, temp_C_era*2.1e0 as TMRT_C_model,
    temp_C_model + 2e0 as UTCI_C_model from pred_hour)"""
_INDEX_NAMES = {"temp_C": _NAMES["temp_C"], "rh_pct": _NAMES["rh_pct"], "HI_C": "Heat Index (°C)", "WBGT_C": "Wet-Bulb Globe Temperature (°C)"}
_RADIANT_NAMES = {"TMRT_C": "Mean radiant temperature (°C)", "UTCI_C": "UTCI (°C)"}


def _sql_network(product: str, reference: str, names: dict[str, str]) -> str:
    rows = _sql_table(product, reference, "≤800 m", "dist_model <= 800", "mapped.cell_id", "dist_model", "model", names)
    rows = rows.replace("from obs_hour o", f"from {_OBS_MORE} o").replace("join pred_hour p", f"join {_PRED_MORE} p")
    return f"with mapped as ({_MAPPED}) {rows}"


def _network(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Windows, observations with coordinates, grid and predictions with the further values."""
    windows = windows_of(v.spark, WINDOWS)
    placed = v.stations.select("station_id", c("lat").alias("LAT"), c("lon").alias("LON"))
    t = c("temp_C_obs")
    # Read for the stations, the days and the pairs of every comparison.
    obs = materialise(in_windows(observations(v).join(placed, "station_id"), windows).withColumns({
        "HI_C_obs": t * 1.1, "WBGT_C_obs": t * 0.9, "TMRT_C_obs": t * 2, "UTCI_C_obs": F.when(c("station_id") % 5 != 0, t + 3)}))
    cells = with_xy(v.pred_cells).withColumnRenamed("cell_id", "key")
    model = predictions(v).withColumns({
        "HI_C_model": c("temp_C_era") * 1.1, "WBGT_C_model": c("ea_hPa_era") + 4, "TMRT_C_model": c("temp_C_era") * 2.1,
        "UTCI_C_model": c("temp_C_model") + 2})
    return windows, obs, cells, model


@query(_sql_network("gridded heat-stress indices", "USCRN (heat01)", _INDEX_NAMES))
def uscrn_indices_validation(v: Views) -> DataFrame:
    windows, obs, cells, model = _network(v)
    found = uscrn_comparisons(obs, cells, model, model)[1]
    return rounded(summary_table([found], windows), dist_median_m=3, dist_p90_m=3)


@query(_sql_network("radiation-driven UTCI", "SURFRAD", _RADIANT_NAMES))
def surfrad_validation(v: Views) -> DataFrame:
    windows, obs, cells, model = _network(v)
    return rounded(summary_table([surfrad_comparison(obs, cells, model)], windows), dist_median_m=3, dist_p90_m=3)


@query(f"""
    select prism_day, count(*) as n, round(avg(temp_C_model - temp_C_obs), 7) as bias,
           round(avg(abs(temp_C_model - temp_C_obs)), 7) as mae,
           round(sqrt(avg((temp_C_model - temp_C_obs)*(temp_C_model - temp_C_obs))), 7) as rmse
    from ({_PAIRS}) p group by prism_day""")
def live_day_metrics(v: Views) -> DataFrame:
    obs = observations(v).join(_station_keys(v), "station_id").withColumn("hour_utc", c("time_utc"))
    static = predictions(v).select("key", c("time_utc").alias("hour_utc"), "temp_C_model")
    return rounded(live_metrics(obs, static, "temp_C_obs", "temp_C_model"), 7)


_ALL_ROWS = [
    _sql_network(product, reference, names).split(f"with mapped as ({_MAPPED}) ")[1] for product, reference, names in (
        ("gridded meteorology", "USCRN (heat01)", _NAMES), ("gridded heat-stress indices", "USCRN (heat01)", _INDEX_NAMES),
        ("radiation-driven UTCI", "SURFRAD", _RADIANT_NAMES))]


@query(f"with mapped as ({_MAPPED}) select * from ({' union all '.join(f'({r})' for r in _ALL_ROWS)}) t")
def validation_job(v: Views) -> DataFrame:
    """All comparisons of two networks run as one job; the combined table read back from its file."""
    folder = shared_folder(v.spark)
    windows, obs, cells, model = _network(v)
    met, indices = uscrn_comparisons(obs, cells, model, model)
    write_validation({"uscrn_met": met, "uscrn_hsi": indices, "surfrad": surfrad_comparison(obs, cells, model)}, windows, folder)
    table = v.spark.read.option("header", True).csv(f"{folder}/validation_table")
    kinds = {"n_stations": "long", "n_hours": "long", **{x: "double" for x in ("dist_median_m", "dist_p90_m", "bias", "rmse")}}
    named = table.select(*[c(f"`{head}`").cast(kinds.get(name, "string")).alias(name) for name, head in TABLE_HEADS.items()])
    return rounded(named, dist_median_m=3, dist_p90_m=3)
