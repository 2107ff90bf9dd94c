"""Registered queries against their oracle SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from gridspark.catalog import ORACLES, QUERIES
from gridspark.catalog.carriers import TABLES, VIEWS, Views, with_views

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["heat_index_hourly", "wbgt_index", "tract_dense_spine", "longwave_flux", "knn4", "radiation_on_grid",
          "temperature_and_humidity_on_grid", "pred_obs_metrics_by_station", "group_percentiles", "isd_lite_lines"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def plain(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v)[:19]
    return sorted((tuple(clean(r[i]) for i in order) for r in records), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    result = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(names, result.fetchall())


def test_carrier_views_agree(spark, duck):
    views = Views(spark, FOLDER)
    for name in VIEWS:
        assert getattr(views, name).count() == duck.execute(with_views(f"select count(*) from {name}")).fetchone()[0], name


def test_flagship(spark):
    out = driver.entry(spark)
    assert out.count() > 0 and out.count() % 24 == 0
