"""What a run puts on disk besides its results, and what it moves to sum its regions."""

import os
import time
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from gridspark.catalog.carriers import TABLES
from gridspark.operators.regions import dense_hours, name_regions
from gridspark.plans import run
from gridspark.session import FREE_SHUFFLES, materialise, shared_folder, shuffles_freed
from tests.test_catalog import FOLDER, plain
from tests.test_plans import DAYS, days_of, inputs  # noqa: F401


def stored(spark):
    return set(os.listdir(os.path.dirname(shared_folder(spark)).removeprefix("file:")))


def test_a_run_deletes_what_it_writes_on_the_way(spark, inputs, tmp_path):  # noqa: F811
    before = stored(spark)
    path, long = str(tmp_path / "out"), str(tmp_path / "long")
    assert run.run_days(spark, inputs, days_of(spark, DAYS[:1]), path, 2010) == 1
    assert run.run_days(spark, inputs, days_of(spark), path, 2010, long_path=long) == 2
    assert stored(spark) == before


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_two_outputs_leave_no_tables(spark):
    before = stored(spark)
    found = driver.queries()["run_outputs"](spark, FOLDER)
    assert stored(spark) == before and spark.conf.get(FREE_SHUFFLES) == "false"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    result = con.execute(driver.oracle_sql()["run_outputs"])
    names = [d[0] for d in result.description]
    assert plain(found.columns, [tuple(r) for r in found.collect()]) == plain(names, result.fetchall())


def test_regions_are_summed_from_mapped_cells_without_a_join(spark, inputs, tmp_path, monkeypatch):  # noqa: F811
    """The cells carry their region and weight, so no hour is dealt by its coordinates, and none is read back."""
    monkeypatch.setattr(run, "read_long", None)
    assert run.run_days(spark, inputs, days_of(spark), str(tmp_path / "out"), 2010, long_path=str(tmp_path / "long")) == 2
    cells = materialise(run.mapped_cells(inputs, days_of(spark)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = run.regional_table_of(cells, inputs, days_of(spark))
        assert "hashpartitioning(lat" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    columns = ["HI_C_area", "HI_C_pop", "WBGT_C_area", "UTCI_C_pop"]
    order = lambda df: df.orderBy("GEOID", "prism_day", "ph").select("GEOID", "prism_day", "ph", *columns).collect()
    one, two = order(found), order(run.regional_table(inputs, days_of(spark)))
    assert len(one) == len(two) == 96
    for a, b in zip(one, two):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-5)


def test_a_cell_of_two_regions_is_stored_once(spark, inputs, tmp_path):  # noqa: F811
    """Cells in the long table once, and in the sums of both regions."""
    twice = replace(inputs, cell_regions=inputs.cell_regions.unionByName(
        inputs.cell_regions.where("tract_code = 1").withColumn("tract_code", F.lit(0))))
    path, long = str(tmp_path / "out"), str(tmp_path / "long")
    assert run.run_days(spark, twice, days_of(spark, DAYS[:1]), path, 2010, long_path=long) == 1
    assert spark.read.parquet(long).count() == 8 * 24
    assert spark.read.parquet(path).groupBy("GEOID").count().count() == 2


def test_hours_of_a_region_move_once(spark):
    """Names and points meet them where they were packed."""
    means = spark.range(96).selectExpr("cast(id div 48 as int) as tract_code", "date '2010-07-01' + cast(id div 24 % 2 as int) as prism_day",
                                       "cast(id % 24 as int) as ph", "id + 0.5D as x", "id <> 3 as covered")
    codes = spark.createDataFrame([(0, "A"), (1, "B")], "tract_code int, GEOID string")
    points = spark.createDataFrame([("A", 1.0, 2.0)], "GEOID string, lat double, lon double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        named = name_regions(dense_hours(means, ["tract_code", "prism_day"]), codes, points)
        plan = named._jdf.queryExecution().executedPlan().toString()
        rows = named.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan[:plan.index("Generate")]
    assert len(rows) == 96 and {(r.GEOID, r.lat, r.lon) for r in rows} == {("A", 1.0, 2.0), ("B", None, None)}
    assert sorted(r.x for r in rows) == [n + 0.5 for n in range(96)]


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    held = lambda: {n for n in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
                    .mkString("\n").split("\n") if "shuffle_" in n}
    before = held()
    with shuffles_freed(spark):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "t"))
        for _ in range(50):
            if not held() - before:
                break
            time.sleep(0.1)
        assert not held() - before
