"""Queries that write files under the shared folder and read them back, and queries that run as streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views
from gridspark.catalog.checks import _PAIRS, _station_keys, observations, predictions
from gridspark.catalog.registry import query, rounded
from gridspark.operators.align import join_layers
from gridspark.operators.quality import input_fingerprints, layer_fingerprints, match_counts
from gridspark.session import materialise, shared_folder
from gridspark.sources.layers import POINT_FILES, SLOT_COLUMNS, read_point_layers
from gridspark.sources.sinks import committed_results, finished_results, write_bucketed, write_days, write_layer, write_regions
from gridspark.streaming.incremental import stream_days
from gridspark.streaming.live_metrics import live_metrics

c = F.col

_COUNTS = """
    select l.GEOID, prism_day, ph, count(*) as n from grid_hour join cells using (cell_id)
    join tract_lut l using (tract_code) group by l.GEOID, prism_day, ph"""


def _region_hours(v: Views) -> DataFrame:
    """GEOID, lat, lon, prism_day, ph, n: a regional table of whole numbers, which storage keeps exactly."""
    counted = v.grid_hour.join(v.cells.select("cell_id", "tract_code"), "cell_id").join(v.tract_lut, "tract_code").groupBy(
        "GEOID", "prism_day", "ph").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"lat": F.lit(30.0), "lon": F.lit(-100.0)})


@query(f"""
    select GEOID, prism_day, pop_year, vintage, cast(sum(n) as bigint) as n, count(*) as hours from ({_COUNTS}) r
    cross join (select 2010 as vintage, 2010 as pop_year union all select 2020, 2010 union all select 2020, -1) k
    group by GEOID, prism_day, pop_year, vintage""")
def regional_files_two_vintages(v: Views) -> DataFrame:
    path = shared_folder(v.spark)
    table = materialise(_region_hours(v))
    for vintage, pop_year in ((2010, 2010), (2020, 2010), (2020, None), (2010, 2010)):
        write_regions(table.withColumn("pop_year", F.lit(pop_year).cast("int")), path, vintage)
    return v.spark.read.parquet(path).groupBy(
        "GEOID", "prism_day", F.coalesce(c("pop_year").cast("int"), F.lit(-1)).alias("pop_year"), "vintage").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("hours"))


# Averages differ in their last digits from engine to engine, and rounding would part some of them. Moved off the
# halves by a fixed odd share of the last digit, they round alike.
_WHOLE = "cast(floor(%s*1e6 + 2.71828e-1) as bigint)"


@query(f"""
    select p.point, p.d, s.slot, {_WHOLE % 'h.ghi'} as ghi, {_WHOLE % 'h.dhi'} as dhi, {_WHOLE % 'h.dni'} as dni, {_WHOLE % 'h.sza'} as sza,
           case when p.point % 5 <> 0 then {_WHOLE % 'h.alb'} end as alb
    from (select distinct point, d from half_hour) p cross join (select cast(unnest(range(48)) as int) as slot) s
    left join half_hour h on h.point = p.point and h.d = p.d and h.slot = s.slot""")
def point_layer_files(v: Views) -> DataFrame:
    """Five layers a day as Spark writes them; every fifth point is absent from one of them."""
    base = shared_folder(v.spark)
    days = sorted(r[0] for r in v.half_hour.select("d").distinct().collect())
    for day in days:
        for var, name in POINT_FILES.items():
            rows = v.half_hour.where(c("d") == F.lit(day))
            if var == "alb":
                rows = rows.where("point % 5 <> 0")
            wide = rows.groupBy("point").agg(*[
                F.max(F.when(c("slot") == n, c(var))).alias(column) for n, column in enumerate(SLOT_COLUMNS)])
            wide.write.parquet(f"{base}/{day:%Y}/{day:%Y-%m-%d}/{name}")
    rows = read_point_layers(v.spark, base, str(days[0]), str(days[-1]))
    return rows.select("point", "d", "slot", *[F.expr(_WHOLE % var).alias(var) for var in POINT_FILES])


@query("""
    select cell_id, prism_day, ph, round(cast(n as double), 6) as n from (
        select cell_id, prism_day, ph, count(*) as n from grid_hour group by cell_id, prism_day, ph) a""")
def grid_layer_files(v: Views) -> DataFrame:
    """A day layer written wide, one column an hour, and read back long."""
    path = shared_folder(v.spark)
    counted = v.grid_hour.groupBy("cell_id", "prism_day", "ph").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Cell numbers as coordinates survive single precision.
    placed = counted.select(c("cell_id").cast("double").alias("lat"), F.lit(0.0).alias("lon"), "prism_day", "ph", "n")
    write_layer(placed, path, "n")
    stored = v.spark.read.parquet(path)
    hours = F.explode(F.array(*[
        F.struct(F.lit(h).alias("ph"), c(f"n_ph{h:02d}").cast("double").alias("n")) for h in range(24)]))
    return rounded(stored.select(c("lat").cast("long").alias("cell_id"), "prism_day", hours.alias("_h")).select(
        "cell_id", "prism_day", "_h.ph", "_h.n").where("n IS NOT NULL"))


@query(f"""
    select prism_day, n, bias, mae, rmse from (
        select prism_day, count(*) as n, round(avg(temp_C_model - temp_C_obs), 7) as bias,
               round(avg(abs(temp_C_model - temp_C_obs)), 7) as mae,
               round(sqrt(avg((temp_C_model - temp_C_obs)*(temp_C_model - temp_C_obs))), 7) as rmse
        from ({_PAIRS}) p group by prism_day) a
    where prism_day + interval 12 hour <= (select max(d + hr*interval 1 hour) - interval 6 hour from obs_hour)""")
def live_day_metrics_stream(v: Views) -> DataFrame:
    """The metrics as a stream over files: days are given out once the watermark has passed them."""
    arrivals, out, marks = (shared_folder(v.spark) for _ in range(3))
    obs = observations(v).join(_station_keys(v), "station_id").withColumn("hour_utc", c("time_utc"))
    obs.write.parquet(arrivals)
    static = predictions(v).select("key", c("time_utc").alias("hour_utc"), "temp_C_model")
    stream = v.spark.readStream.schema(obs.schema).parquet(arrivals)
    live_metrics(stream, static, "temp_C_obs", "temp_C_model").writeStream.outputMode("append").option(
        "checkpointLocation", marks).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return rounded(v.spark.read.parquet(out), 7)


@query(f"""
    select GEOID, prism_day, ph, n, vintage from ({_COUNTS}) r cross join (select 2010 as vintage union all select 2020) k""")
def region_days_stream(v: Views) -> DataFrame:
    """Days that arrive in files, some of them twice, each run once under each vintage."""
    arrivals, out = shared_folder(v.spark), shared_folder(v.spark)
    # Both vintages and both arrivals read the region-hours, the days are listed four times.
    table = materialise(_region_hours(v).withColumn("ph_kept", c("ph")))
    days = materialise(v.grid_hour.select("prism_day").distinct())
    first = days.agg(F.min("prism_day").alias("prism_day"))

    def runner(vintage: int):
        return lambda todo: write_regions(table.join(todo, "prism_day", "left_semi"), out, vintage)

    def label(vintage: int):
        return lambda df: df.select("prism_day", F.lit(None).cast("int").alias("pop_year"), F.lit(vintage).alias("vintage"))

    marks = {2010: shared_folder(v.spark), 2020: shared_folder(v.spark)}
    for batch in (first, days):
        batch.write.mode("append").parquet(arrivals)
        for vintage, folder in marks.items():
            stream_days(v.spark, arrivals, out, folder, runner(vintage), label=label(vintage)).awaitTermination()
    assert finished_results(v.spark, out).count() == committed_results(v.spark, out).count() == 2 * days.count()
    return v.spark.read.parquet(out).select(
        "GEOID", "prism_day", c("ph_kept").cast("int").alias("ph"), c("n").cast("long").alias("n"), "vintage")


_LAYERS = {"temp_c": "l_linenumber % 2 = 0", "ghi": "l_quantity > 10", "alb": "l_orderkey % 3 <> 0"}
_LAYER_KEYS = ("cell_id", "prism_day", "ph")


def _layer_sql(name: str) -> str:
    where = _LAYERS[name].replace("l_quantity", "(temp_c + 5)")
    return f"select cell_id, prism_day, ph, max({name}) as {name} from grid_hour where {where} group by cell_id, prism_day, ph"


@query(f"""
    select cell_id, prism_day, ph, round(temp_c, 6) as temp_c, round(ghi, 6) as ghi, round(alb, 6) as alb
    from ({_layer_sql('temp_c')}) a join ({_layer_sql('ghi')}) b using (cell_id, prism_day, ph) join ({_layer_sql('alb')}) d using (cell_id, prism_day, ph)""")
def bucketed_layers(v: Views) -> DataFrame:
    """Layers stored in buckets of their keys, joined without an exchange."""
    base = shared_folder(v.spark)
    stored = {}
    for name, condition in _LAYERS.items():
        rows = v.grid_hour.where(condition.replace("l_quantity", "(temp_c + 5)")).groupBy(*_LAYER_KEYS).agg(F.max(name).alias(name))
        table = f"layer_{name}_{base.rsplit('-', 1)[1]}"
        write_bucketed(rows, table, _LAYER_KEYS, 8, f"{base}/{name}")
        stored[name] = v.spark.table(table)
    return rounded(join_layers(stored, _LAYER_KEYS))


@query("""
    select count(*) as rows_seen, count(c.cell_id) as rows_matched,
           (select count(*) from (select distinct cell_id, prism_day, ph from grid_hour join cells using (cell_id) where tract_code >= 0) d) as written
    from grid_hour g left join (select distinct cell_id from cells where tract_code >= 0) c on c.cell_id = g.cell_id""")
def match_counts_on_the_run(v: Views) -> DataFrame:
    """The rows seen and matched by a job that writes a table, counted as they pass."""
    path = shared_folder(v.spark)
    matched, counts = match_counts(v.grid_hour, v.cells.where("tract_code >= 0"), ["cell_id"])
    matched.groupBy(*_LAYER_KEYS).agg(F.max("temp_c").alias("temp_c")).write.parquet(path)
    found = counts.get
    return v.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written")).select(
        F.lit(found["rows_seen"]).alias("rows_seen"), F.lit(found["rows_matched"]).alias("rows_matched"), "written")


@query(f"select GEOID, prism_day, ph, n from ({_COUNTS}) r")
def corrected_days_stream(v: Views) -> DataFrame:
    """A day delivered in part and again in full: its result is made anew, those of the others are left alone."""
    store, arrivals, out, marks = (shared_folder(v.spark) for _ in range(4))
    rows = v.grid_hour.select("cell_id", "prism_day", "ph", "l_orderkey", "l_linenumber")
    days = rows.select("prism_day").distinct()
    first = days.agg(F.min("prism_day")).scalar()
    cells = v.cells.select("cell_id", "tract_code").join(v.tract_lut, "tract_code")
    done: list = []

    def stored() -> DataFrame:
        return v.spark.read.parquet(store)

    def label(df: DataFrame) -> DataFrame:
        listed = [r[0] for r in df.select("prism_day").collect()]  # a calendar's days
        known = layer_fingerprints(stored().where(c("prism_day").isin(listed)), "rows", "prism_day")
        return df.join(input_fingerprints(df, known, ["rows"], []), "prism_day").select(
            "prism_day", F.lit(None).cast("int").alias("pop_year"), F.lit(2010).alias("vintage"), "fingerprint")

    def run(todo: DataFrame) -> None:
        listed = sorted(r[0] for r in todo.collect())
        done.append(listed)
        counted = stored().where(c("prism_day").isin(listed)).join(cells, "cell_id").groupBy("GEOID", "prism_day", "ph").agg(
            F.count(F.lit(1)).alias("n"))
        write_regions(counted.withColumns({"lat": F.lit(30.0), "lon": F.lit(-100.0), "ph_kept": c("ph")}), out, 2010)

    in_part = (c("prism_day") != first) | (c("l_orderkey") % 3 != 0)
    for delivery in (rows.where(in_part), rows.where(c("prism_day") == first), rows.where(c("prism_day") == first)):
        write_days(delivery, store)
        days.write.mode("append").parquet(arrivals)
        stream_days(v.spark, arrivals, out, marks, run, label=label).awaitTermination()
    # All days at first, the corrected one alone after that, and none for a delivery of the same rows.
    assert [len(d) for d in done] == [days.count(), 1]
    return v.spark.read.parquet(out).select(
        "GEOID", "prism_day", c("ph_kept").cast("int").alias("ph"), c("n").cast("long").alias("n"))


_ARRIVED = f"""
    with p as (select *, d + hr*interval 1 hour as t from ({_PAIRS}) a),
    e as (select min(t) + (date_diff('hour', min(t), max(t))*4//10)*interval 1 hour as cut1,
                 min(t) + (date_diff('hour', min(t), max(t))*7//10)*interval 1 hour as cut2 from p),
    a as (select p.*, case when t >= cut2 then 3 when t >= cut1 then 2
                           when t < cut1 - interval 60 hour and station_id % 11 = 2 then 3
                           when t >= cut1 - interval 3 hour and station_id % 2 = 1 then 2 else 1 end as arrival
          from p cross join e),
    w as (select k.arrival, max(a.t) - interval 6 hour as mark from (select 1 as arrival union all select 2 union all select 3) k
          join a on a.arrival <= k.arrival group by k.arrival)"""


@query(f"""
    {_ARRIVED}
    select prism_day, count(*) as n, round(avg(temp_C_model - temp_C_obs), 6) as bias, round(avg(abs(temp_C_model - temp_C_obs)), 6) as mae,
           round(sqrt(avg((temp_C_model - temp_C_obs)*(temp_C_model - temp_C_obs))), 6) as rmse
    from a left join w on w.arrival = a.arrival - 1
    where prism_day + interval 12 hour > coalesce(mark, timestamp '1900-01-01') and prism_day + interval 12 hour <= (select max(mark) from w)
    group by prism_day""")
def late_day_metrics_stream(v: Views) -> DataFrame:
    """Three arrivals with a restart before each: rows late within the bound still count, rows of closed days do not."""
    arrivals, out, marks = (shared_folder(v.spark) for _ in range(3))
    obs = observations(v).join(_station_keys(v), "station_id").withColumn("hour_utc", c("time_utc"))
    static = predictions(v).select("key", c("time_utc").alias("hour_utc"), "temp_C_model")
    # The stream's rows are the paired ones, so the cuts are taken from them, as in the SQL.
    paired = materialise(obs.join(static.select("key", "hour_utc"), ["key", "hour_utc"], "left_semi"))
    low, high = paired.agg(F.min("time_utc"), F.max("time_utc")).first()
    span = (high - low) // timedelta(hours=1)
    cut1, cut2 = (F.lit(low + timedelta(hours=span * tenths // 10)) for tenths in (4, 7))
    t, hours = c("time_utc"), lambda n: F.make_dt_interval(hours=F.lit(n))
    arrival = F.when(t >= cut2, 3).when(t >= cut1, 2).when(
        (t < cut1 - hours(60)) & (c("station_id") % 11 == 2), 3).when(
        (t >= cut1 - hours(3)) & (c("station_id") % 2 == 1), 2).otherwise(1)
    for number in (1, 2, 3):
        paired.where(arrival == number).write.mode("append").parquet(arrivals)
        stream = v.spark.readStream.schema(paired.schema).parquet(arrivals)
        live_metrics(stream, static, "temp_C_obs", "temp_C_model").writeStream.outputMode("append").option(
            "checkpointLocation", marks).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return rounded(v.spark.read.parquet(out))
