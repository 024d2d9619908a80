"""Queries over rows of the sampling pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.functions import graders as G
from lattika.operators import kg as K
from lattika.operators import kg_tables as T
from lattika.operators import samples as S
from lattika.plans.kg_queries import SQL as KG_SQL


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wrap_fetch(spark, sf):
    return S.wrap_fetch(_t(spark, sf, "nation").select("n_nationkey"), "n_nationkey", 20, 12)


def buffer_pop(spark, sf):
    first, rest = S.pop_first(_t(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 5)
    return first.withColumn("popped", F.lit(True)).unionByName(rest.withColumn("popped", F.lit(False)))


def buffer_first(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    return S.buffer_then_data(c.filter("s = 'BUILDING'"), c.filter("s <> 'BUILDING'"), "k", 400)


def index_inverse(spark, sf):
    rows = _t(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.row_number().over(K.W.partitionBy("n_regionkey").orderBy(F.col("n_nationkey").desc())).alias("place"))
    return S.inverse_index(rows, "n_regionkey", "place", "n_nationkey").select("n_regionkey", F.array_join("order", ",").alias("order"))


def train_columns(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.split("o_orderpriority", "").alias("tokens"), F.lit(None).cast("array<int>").alias("mask"), F.col("o_totalprice").alias("reward"), (F.col("o_orderstatus") == "F").alias("removed"))
    x = S.train_columns(o, "tokens", "mask", "reward", "removed")
    return x.select("o_orderkey", "total_length", "response_length", F.size("loss_mask").alias("n"), F.exists("loss_mask", lambda m: m == 1).alias("on"))


def rank_split(spark, sf):
    return S.split_ranks(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 8)


def task_status(spark, sf):
    k = F.pmod("event_id", F.lit(4))
    result = F.when(k == 0, "max_turns").when(k == 1, "error").when(k == 2, "aborted").otherwise(F.col("event_type"))
    status, n = S.task_sample(result, F.when(k == 0, F.array(F.lit(1))), F.when(k < 2, F.array(F.lit(1), F.lit(2))))
    return _t(spark, sf, "events").select("event_id", status.alias("status"), n.alias("n"))


def outcome_scaling(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey", F.col("o_totalprice").alias("reward"))
    text = F.concat(F.lit("Judgment: 1 ... Judgment: "), F.pmod("c", F.lit(3)).cast("string"))
    chosen = o.select("c").distinct().select("c", (G.selected_index(text) == 1).alias("right"))
    return S.outcome_scaling(o, chosen, "c").select("o_orderkey", F.round("reward", 4).alias("reward"))


def quantile_bins(spark, sf):
    return S.quantile_bins(_t(spark, sf, "documents"), "n_chars", [0.1, 0.25, 0.5, 0.75])


def kg_format_triples(spark, sf):
    return T.triple_prompts(spark, sf).select("asked", F.md5("prompt").alias("digest"))


def kg_reselect(spark, sf):
    p = _t(spark, sf, "part")
    pool = p.select(F.col("p_brand").alias("q"), F.col("p_name").alias("name")).distinct()
    picked = p.groupBy(F.col("p_brand").alias("q")).agg(F.sort_array(F.collect_set("p_name"), asc=False).alias("names"))
    return S.reselect(pool, picked, "q").select("q", "name", "rank")


SQL = {
    "wrap_fetch": "SELECT n_nationkey, p AS place, CAST((p + 20) // 25 AS INT) AS epoch FROM (SELECT n_nationkey, unnest([k - 20, k + 5]) AS p FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation)) WHERE p >= 0 AND p < 12",
    "buffer_pop": "WITH f AS (SELECT user_id FROM events GROUP BY 1 ORDER BY min(event_id), user_id LIMIT 5) SELECT event_id, user_id, user_id IN (SELECT user_id FROM f) AS popped FROM events",
    "buffer_first": "SELECT c_custkey AS k, c_mktsegment AS s FROM customer ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_custkey LIMIT 400",
    "index_inverse": "SELECT n_regionkey, string_agg(CAST(p AS VARCHAR), ',' ORDER BY n_nationkey) AS \"order\" FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS p FROM nation) GROUP BY 1",
    "train_columns": "SELECT o_orderkey, CAST(length(o_orderpriority) AS INT) AS total_length, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE length(o_orderpriority) END AS INT) AS response_length, CAST(length(o_orderpriority) AS INT) AS n, o_orderstatus <> 'F' AS \"on\" FROM orders",
    "rank_split": "SELECT o_orderkey, CAST(k % 8 AS INT) AS rank, k // 8 AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)",
    "task_status": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'truncated' WHEN 1 THEN 'failed' WHEN 2 THEN 'aborted' ELSE CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END END AS status, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM events",
    "outcome_scaling": "SELECT o_orderkey, round(o_totalprice * CASE WHEN o_custkey % 3 = 1 THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END, 4) AS reward FROM orders",
    "quantile_bins": "WITH d AS (SELECT n_chars / max(n_chars) OVER () AS s FROM documents) SELECT CAST((s > 0.1)::INT + (s > 0.25)::INT + (s > 0.5)::INT + (s > 0.75)::INT AS INT) AS bin, count(*) AS n FROM d GROUP BY 1",
    "kg_format_triples": f"WITH x AS ({KG_SQL['kg_triples_named']}) SELECT asked, md5(string_agg('[' || head_name || ', ' || relation || ', ' || tail_name || ']', chr(10) ORDER BY '[' || head_name || ', ' || relation || ', ' || tail_name || ']')) AS digest FROM x GROUP BY 1",
    "kg_reselect": "SELECT * FROM (SELECT p_brand AS q, p_name AS name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name DESC) AS INT) AS rank FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE rank <= 8",
}
QUERIES = {name: globals()[name] for name in SQL}
