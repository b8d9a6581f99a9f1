"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "n_cues", "n_texts", "n_reused", "n_to_compute"] and df.count() > 0
