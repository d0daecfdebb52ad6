"""Every registered query with SQL equals DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from matchloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def tidy(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{float(value):.9g}"


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_equals_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE[name]}) q").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(tuple(map(tidy, r)) for r in rows) == sorted(tuple(map(tidy, r)) for r in want) and rows


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).columns


def test_suppression_across_classes_over_all_frames(spark, sf):
    """Every frame of ``events`` has rows, those too that ``tracks`` leaves out as holes."""
    got = plans.QUERIES["d03_suppress_across_classes"](spark, sf).select("match_id", "frame_idx").distinct().count()
    assert got == spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id div 500", "event_id % 500").distinct().count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
