"""The whole-store look-ups on tables with odd rows, and what they shuffle."""

import duckdb
import pandas as pd
import pytest
from test_queries import TABLES, plain

from lattika.operators import kg as K
from lattika.operators import kg_tables as T
from lattika.plans import catalogue

WHOLE = ["kg_flatten_names", "kg_triples_named", "kg_two_hop_flatten", "kg_format_triples"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory, data):
    """Suppliers, parts and customers without names or rows, two names of a supplier, equal lines, lines without an order, large orders, a nation without a row."""
    to = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    of = lambda t: f"read_parquet('{data}/{t}.parquet')"
    changed = {
        "supplier": f"SELECT * REPLACE (CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS s_name) FROM {of('supplier')} WHERE s_suppkey <> 3 AND s_suppkey < 30 UNION ALL SELECT * REPLACE ('A ' || s_name AS s_name, 7 AS s_nationkey) FROM {of('supplier')} WHERE s_suppkey = 5",
        "part": f"SELECT * FROM {of('part')} WHERE p_partkey % 5 <> 1",
        "customer": f"SELECT * FROM {of('customer')} WHERE c_custkey % 7 <> 2",
        "nation": f"SELECT * FROM {of('nation')} WHERE n_nationkey <> 4",
        "orders": f"SELECT * FROM {of('orders')} WHERE o_orderkey % 6 <> 1",
        "lineitem": f"SELECT * FROM {of('lineitem')} UNION ALL SELECT * FROM {of('lineitem')} WHERE l_linenumber = 1 UNION ALL SELECT * REPLACE (2 AS l_orderkey, l_orderkey % 90 + 10 AS l_linenumber) FROM {of('lineitem')} WHERE l_orderkey < 90",
    }
    for t in TABLES:
        con.sql(f"COPY ({changed.get(t, f'SELECT * FROM {of(t)}')}) TO '{to}/{t}.parquet' (FORMAT parquet)")
    return str(to)


@pytest.mark.parametrize("name", WHOLE)
def test_odd_rows(spark, odd, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet')")
    pd.testing.assert_frame_equal(plain(catalogue.queries()[name](spark, odd).toPandas()), plain(con.sql(catalogue.oracle_sql()[name]).df()))


def test_general_operators_agree(spark, odd):
    kg, labels = K.distinct_triples(spark, odd), K.names(spark, odd)
    candidates = K.flatten_candidates(kg, labels)
    pairs = [(candidates, T.flatten_candidates(spark, odd)), (K.get_triples(kg, labels), T.get_triples(spark, odd)), (K.through_mediator(kg, labels, candidates), T.through_mediators(spark, odd))]
    for general, ours in pairs:
        pd.testing.assert_frame_equal(plain(ours.toPandas()), plain(general.toPandas()))


def shuffled(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


@pytest.mark.parametrize("name", WHOLE)
def test_keys_are_shuffled(spark, data, name):
    """Numbers of line items are shuffled, not ids: at most 120 bytes for each, where ids took 240 to 350."""
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    before = shuffled(spark)
    catalogue.queries()[name](spark, data).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 120 * lines
