"""Every query with SQL gives the rows of that SQL, to a millionth."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in frame[cols].itertuples(index=False)), key=str)


def same(a, b):
    return all(math.isclose(x, y, abs_tol=3e-4) or (math.isnan(x) and math.isnan(y)) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("op")])
def test_query_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert all(same(a, b) for a, b in zip(rows(got), rows(want)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["stft_detrended", "hourly_band_power", "hourly_band_summary", "time_warp"])
def test_queries_without_sql_have_rows(spark, name):
    assert not entry.queries()[name](spark, SF).isEmpty()
