"""Every registered query of the crawl engine against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from crawlscape import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    found = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(found) > 0
        return
    wanted = duck.execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert canonical(found) == canonical(wanted)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_zigzag_of_a_zero_step_is_one_bit(spark, tmp_path):
    rows = [(0, "1970-01-01 00:00:00"), (26_322, "1973-01-01 18:00:00"), (1, "1970-01-01 00:00:00"), (0, "1970-01-02 00:00:00"), (5, None), (None, "1970-01-02 00:00:00")]
    made = spark.createDataFrame(rows, "o_orderkey long, at string").selectExpr("1L as o_custkey", "o_orderkey", "'O' as o_orderstatus", "1d as o_totalprice", "cast(at as timestamp_ntz) as o_orderdate")
    made.write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    found = catalog.queries()["zigzag_widths"](spark, str(tmp_path)).toPandas()
    assert canonical(found) == canonical(con.execute(catalog.oracle_sql()["zigzag_widths"]).df()) == [("", "2"), ("1", "2"), ("2", "1"), ("6", "1")]
