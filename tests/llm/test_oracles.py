"""Queries against their SQL, and the optional import."""

import duckdb
import pytest

import __spark_entry__ as driver
from gridspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(result.fetchall())


def test_one_query_per_operator_is_registered():
    registered = driver.queries()
    assert "pipeline" in registered
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in registered) == 1
