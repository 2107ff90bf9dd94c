"""Steps that spread days into hours: what their rows carry, and over how many tasks they go."""

import re
from datetime import date

from pyspark.sql import functions as F

from gridspark.operators.interpolate import idw, pack_hours, spread_hours
from tests.test_plans import days_of, inputs  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hours_are_spread_without_the_day(spark):
    packed = pack_hours(spark.createDataFrame([(1, 0, 5.0), (1, 23, 6.0), (2, 1, 7.0)], "id int, ph int, x double"), ["id"], ["x"])
    rows = packed.withColumnRenamed("hours", "a").withColumn("b", F.when(F.col("id") == 1, F.col("a")))
    found = spread_hours(rows, ["a", "b"])
    got = {(r.id, r.ph): (r.a, r.b) for r in found.collect()}
    assert sorted(got) == [(i, h) for i in (1, 2) for h in range(24)]
    present = {k: (a and a.x, b and b.x) for k, (a, b) in got.items() if a or b}
    assert present == {(1, 0): (5.0, 5.0), (1, 23): (6.0, 6.0), (2, 1): (7.0, None)}
    unneeded = re.search(r"Generate inline\(.*\), \[([\d, ]+)\], false", plan_of(found))
    assert unneeded and len(unneeded.group(1).split(",")) == 2


def test_targets_of_one_file_are_dealt_before_their_hours(spark):
    near = spark.range(50).coalesce(1).select(
        F.col("id").alias("cell"), F.array(F.struct(F.lit(1.0).alias("dist"), F.lit(1).alias("id"))).alias("nn"))
    day = spark.createDataFrame([(date(2010, 7, 1),)], "prism_day date")
    hours = spark.range(24).select(F.lit(1).alias("src"), F.lit(date(2010, 7, 1)).alias("prism_day"), F.col("id").cast("int").alias("ph"), F.lit(2.0).alias("x"))
    found = idw(near, pack_hours(hours, ["src", "prism_day"], ["x"]), ["cell"], "src", ["x"], day)
    plan = plan_of(found)
    assert "RepartitionByExpression [cell" in plan[plan.index("Generate"):]
    assert found.where("x = 2").count() == 50 * 24


def test_daily_rows_are_dealt_by_tile(spark, inputs):  # noqa: F811
    from gridspark.plans import run
    plan = plan_of(run.hourly_inputs(inputs, inputs.daily, days_of(spark)))
    assert re.search(r"RepartitionByExpression \[_ty#\d+L, _tx#\d+L, prism_day", plan)
    # By dictionaries: the first one is left behind before the next is joined.
    plan = plan_of(run.hourly_inputs(inputs, inputs.daily, days_of(spark), broadcast_bytes=0))
    assert not re.search(r"Project \[[^\n]*_templates#[^\n]*\n[^\n]*Join LeftOuter", plan)


def test_regions_of_cells_at_hand(spark, inputs):  # noqa: F811
    """Coordinates in double precision meet the region map as they are."""
    from gridspark.plans import run
    from gridspark.session import materialise
    days = days_of(spark)
    cells = materialise(run.heat_stress_cells(inputs, days)).withColumn("lat", F.col("lat") + 1e-9)
    moved = run.Inputs(**{**vars(inputs), "cell_regions": inputs.cell_regions.withColumn("lat", F.col("lat") + 1e-9)})
    if inputs.population is not None:
        moved.population = inputs.population.withColumn("lat", F.col("lat") + 1e-9)
    found = run.regional_table_of(cells, moved, days)
    assert found.count() == run.regional_table(inputs, days).count() > 0
