"""Queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from scanloom.plans import oracle, queries

DATA = Path("/root/testdata/sf0.001")


def normal(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, str(DATA)).toPandas(), duck.sql(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["row", "col", "b1", "b2"]
    assert {*entry.oracle_sql()} <= {*entry.queries()}
    assert {*queries.queries()} == {*oracle.SQL}


def test_random_grid(spark):
    one, two = (queries.random_grid(spark, str(DATA)).groupBy("b1").count().collect() for _ in range(2))
    assert sorted(one) == sorted(two) and sum(r["count"] for r in one) == 65_000


def test_stdout_has_every_row(spark, duck):
    lines = queries.stdout_lines(spark, str(DATA)).collect()
    rows = {int(r.line.split()[0].removeprefix("row=")) for r in lines}
    assert rows == {r for (r,) in duck.sql("SELECT vec_id FROM embeddings").fetchall()} and len(rows) > 20


def test_truncate_has_every_order_and_stops_at_a_short_line(spark, duck):
    from scanloom.sources.grids import fit_lines

    rows = {r.row for r in queries.csv_mismatch_truncate_all(spark, str(DATA)).collect()}
    assert rows == {r for (r,) in duck.sql("SELECT DISTINCT l_orderkey FROM lineitem").fetchall()}
    lines = spark.createDataFrame([(4, [9, 9]), (3, [7]), (0, [1, 2, 3]), (2, [5, 6]), (5, [8])], "row long, px array<int>").repartition(3)
    assert sorted((r.row, r.px) for r in fit_lines(lines, 2, "truncate").collect()) == [(0, [1, 2]), (2, [5, 6])]
