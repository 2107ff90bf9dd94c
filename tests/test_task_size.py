"""Steps whose tasks must not grow with the rows of one day or one file."""

from datetime import date

from pyspark.sql import functions as F

from gridspark.operators.quality import missing_inputs
from gridspark.sources import layers, predictions, sinks


def test_available_layers_are_combined_before_the_join(spark):
    days = spark.createDataFrame([(date(2010, 7, 1),)], "prism_day date")
    have = spark.range(1000).select(F.lit("t").alias("layer"), F.lit(date(2010, 7, 1)).alias("d"))
    found = missing_inputs(days, have, ["t"], ["u"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    right = plan[plan.index("Join LeftAnti"):].rsplit("+- Aggregate", 1)[1]
    assert "Range" in right and "Generate" not in right
    assert found.count() == 2


def test_rows_of_one_place_are_dealt_to_all_files(spark, tmp_path):
    """Cells beyond the curve's end share a place on it."""
    path = str(tmp_path / "cells")
    cells = spark.range(8_000).select((F.col("id") + 200.0).alias("lat"), F.lit(-100.0).alias("lon"), F.col("id").alias("key"))
    sinks.write_for_lookups(cells, path, "key", 8)
    held = [r["count"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert sum(held) == 8_000 and max(held) < 2_000
    assert sinks.lookup_files(36_000_000, 8) == 36 and sinks.lookup_files(600_000, 8) == 8


def test_day_layers_may_be_folders(spark, tmp_path):
    """Layers of a day written by many tasks."""
    hours = [f"t2m_ph{h:02d}" for h in range(24)]
    wide = spark.range(40).select((F.col("id") + 0.0).alias("lat"), F.lit(1.0).alias("lon"), *[
        (F.col("id") + h).cast("double").alias(x) for h, x in enumerate(hours)])
    for name in ("2010-07-01", "2010-07-02"):
        for var in ("t2m", "ea"):
            dated = wide.withColumn("prism_day", F.lit(name).cast("date"))
            dated.withColumnsRenamed({x: x.replace("t2m", var) for x in hours}).repartition(4).write.parquet(
                str(tmp_path / "wide" / f"{var}_{name}.parquet"))
    named = wide.withColumnsRenamed({x: x.replace("ph", "h") for x in hours})
    for name in ("2010-07-01", "2010-07-02"):
        named.repartition(4).write.parquet(str(tmp_path / "named" / "t2m" / f"{name}.parquet"))
    rows = layers.read_day_layers(spark, str(tmp_path / "named"), "t2m", "2010-07-01", "2010-07-02")
    assert [(r.d, r["count"]) for r in rows.groupBy("d").count().orderBy("d").collect()] == [
        (date(2010, 7, 1), 960), (date(2010, 7, 2), 960)]
    found = predictions.list_pattern(spark, str(tmp_path / "wide"), "{var}_{date}.parquet", "t2m").collect()
    assert sorted(str(r.prism_day) for r in found) == ["2010-07-01", "2010-07-02"]
    got = predictions.read_wide_predictions(
        spark, str(tmp_path / "wide"), "{var}_{date}.parquet", {"t2m": "t2m", "ea": "ea"}, "2010-07-01", "2010-07-02", None)
    assert got.groupBy("prism_day").count().orderBy("prism_day").collect() == [
        (date(2010, 7, 1), 960), (date(2010, 7, 2), 960)]
    assert got.agg(F.sum("temp_C_model")).first()[0] == 2 * sum(i + h for i in range(40) for h in range(24))
