"""Tables that a query hands on several times are made once."""

import pytest

from gridspark.catalog import QUERIES, files


@pytest.mark.parametrize("name", ["region_days_stream", "regional_files_two_vintages"])
def test_region_hours_are_not_counted_again_for_each_write(spark, monkeypatch, name):
    read = []
    write = files.write_regions
    monkeypatch.setattr(files, "write_regions", lambda df, *a: read.append(df.inputFiles()) or write(df, *a))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(read) == 4 and not [f for found in read for f in found if "lineitem" in f]
