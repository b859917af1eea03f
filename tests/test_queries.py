"""Each library query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from seqweft.plans import columns, evaluation, joins, queries, records, sources  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].map(lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_window_poa_reads_whole_turns(spark, tmp_path):
    turns = [(1, 0, "a whole turn that is longer than its first letters"), (1, 1, "a whole turn that is longer than its first letters"), (2, 0, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.sequence for r in queries.window_poa(spark, str(tmp_path)).collect()}
    assert got == {1: turns[0][2].upper(), 2: ""}
