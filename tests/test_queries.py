"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

from pathlib import Path

import duckdb
import pytest

from tallyward.plans.every import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    as_text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(as_text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in ORACLES:
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
