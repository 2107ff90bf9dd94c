"""Queries on copies of the given tables with shifted keys, as larger inputs have them."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from gridspark.catalog.carriers import TABLES
from tests.test_catalog import FOLDER, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
# Cells of these keys lie on both sides of 90 degrees.
PAST_THE_POLE = {"p_partkey": 361_350, "l_partkey": 361_350}


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The smallest tables with their part keys moved, and a connection that reads them."""
    folder, con = str(tmp_path_factory.mktemp("shifted")), duckdb.connect()
    for table in TABLES:
        source = f"{FOLDER}/{table}.parquet"
        names = [r[0] for r in con.execute(f"describe select * from '{source}'").fetchall()]
        moved = ", ".join(f"{n} + {PAST_THE_POLE.get(n)} as {n}" if n in PAST_THE_POLE else n for n in names)
        con.execute(f"copy (select {moved} from '{source}') to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["packed_keys", "weights_population_years"])
def test_weights_past_the_pole(spark, shifted, name):
    folder, con = shifted
    df = driver.queries()[name](spark, folder)
    result = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(names, result.fetchall())
