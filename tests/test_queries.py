"""Every query with SQL against DuckDB, over whole tables of the smallest scale."""

import duckdb
import pandas as pd
import pytest

from lattika.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: df[c].map(lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(round(float(v), 6)) if isinstance(v, float) else str(v)) for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, data, duck, name):
    ours = catalogue.queries()[name](spark, data).toPandas()
    pd.testing.assert_frame_equal(plain(ours), plain(duck.sql(catalogue.oracle_sql()[name]).df()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
