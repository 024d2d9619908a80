"""Queries over groups of samples, sequences and buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattika.functions import arrays as A
from lattika.operators import rollout as R


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _samples(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("i"), (F.col("o_orderstatus") == "F").cast("double").alias("r"), F.col("o_totalprice").alias("price"))


def group_norm(spark, sf):
    return R.normalize_rewards(_samples(spark, sf), "g", "r").select("g", "i", F.round("normalized", 6).alias("z"))


def group_baseline(spark, sf):
    return R.normalize_rewards(_samples(spark, sf), "g", "r", by_deviation=False).select("g", "i", F.round("normalized", 6).alias("z"))


def buffer_norm(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", (F.col("value") / 100).alias("r"))
    return R.normalize_valid(e, "user_id", "r").select("event_id", F.round("normalized", 6).alias("z"))


def zero_std_filter(spark, sf):
    return R.deviation_verdict(_samples(spark, sf), "g", "r")


def oversample_fill(spark, sf):
    return R.fill_batch(_samples(spark, sf), "g", "r", 256)


def zero_std_counts(spark, sf):
    return R.spread_free_groups(_samples(spark, sf), "g", "r")


def pass_at_k(spark, sf):
    return R.pass_rates(_samples(spark, sf), "g", "r", [1, 2, 4, 8])


def eval_report(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("reward"), F.round(F.avg((F.col("n_chars") > 4000).cast("int")), 6).alias("truncated"), F.count("*").alias("n"))


def reward_share(spark, sf):
    g = _t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))


def sample_metrics(spark, sf):
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return c.agg(F.round(F.avg("turns"), 6).alias("turns_mean"), F.max("turns").alias("turns_max"), F.min("turns").alias("turns_min"), F.round(F.avg((F.col("chars") > 1000).cast("int")), 6).alias("clipped"), F.sum("chars").alias("chars"))


def length_statistics(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang").agg(*R.statistics(F.col("n_chars")))


def throughput_metrics(spark, sf):
    """Tokens a second over all, and of the longest samples."""
    o = _t(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("s"), F.col("o_custkey").alias("n"))
    top = o.groupBy("o_orderpriority").agg(F.max("n").alias("top"))
    g = o.join(top, "o_orderpriority").groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.avg(F.when(F.col("n") == F.col("top"), F.col("n") / F.col("s"))).alias("longest"))
    return g.select("o_orderpriority", F.round(F.col("n") / F.col("s"), 6).alias("rate"), F.round("longest", 6).alias("longest"))


def ratio_kinds(spark, sf):
    """Mean of ratios and ratio of sums."""
    return _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_tax") / F.col("l_quantity")), 6).alias("mean_of_ratios"), F.round(F.sum("l_tax") / F.sum("l_quantity"), 6).alias("ratio_of_sums"))


def weighted_merge(spark, sf):
    part = _t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return part.groupBy("event_type").agg(F.round(R.merge_means(part, "mean", "n"), 6).alias("mean"), F.sum("n").alias("n"))


def length_histogram(spark, sf):
    d = _t(spark, sf, "documents").select("n_chars")
    cut = F.when(F.col("n_chars") < 500, "0").when(F.col("n_chars") < 1000, "500").when(F.col("n_chars") < 2000, "1000").when(F.col("n_chars") < 4000, "2000").otherwise("4000")
    return d.groupBy(cut.alias("bin")).agg(F.count("*").alias("n"))


def group_meta(spark, sf):
    g = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("r"))
    return g.agg(F.sum("n").alias("total"), F.count("*").alias("groups"), F.round(F.avg("n"), 6).alias("size"), F.round(F.avg("r"), 6).alias("reward"))


def sample_fan_out(spark, sf):
    return R.fan_out(_t(spark, sf, "part").select("p_partkey"), 4, "p_partkey").select("p_partkey", "group_index", "sample", "index")


def trim_batch(spark, sf):
    return R.trim(_samples(spark, sf), "i", 64).select("i")


def debug_halves(spark, sf):
    return R.halves(_samples(spark, sf), "i", 0.3).select("i")


def epoch_shuffle(spark, sf):
    """A permutation: every position once."""
    p = R.epoch_order(_t(spark, sf, "part").select("p_partkey"), "p_partkey", 7, 1)
    return p.agg(F.count("*").alias("n"), F.countDistinct("position").alias("positions"), F.min("position").alias("first"), F.max("position").alias("last"))


def _steps(spark, sf):
    """Steps of at most 64 documents: a bounded batch is what is balanced."""
    return _t(spark, sf, "documents").select(F.floor(F.col("doc_id") / 64).alias("step"), "doc_id", "n_chars")


def balanced_parts(spark, sf):
    return R.assign(_steps(spark, sf), "step", "doc_id", "n_chars", lambda x: R.balance(x, min(8, len(x))))


def first_fit_bins(spark, sf):
    return R.assign(_steps(spark, sf), "step", "doc_id", "n_chars", lambda x: R.first_fit(x, 8192))


def size_chunks(spark, sf):
    return R.assign(_steps(spark, sf), "step", "doc_id", "n_chars", lambda x: R.chunk_by_size(x, 16384))


def pack_offsets(spark, sf):
    return R.running_offsets(_steps(spark, sf), "step", "doc_id", "n_chars")


def _seqs(spark, sf):
    """Sequences of an order's lines."""
    line = _t(spark, sf, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("r"), F.col("l_tax").alias("v"), (F.col("l_returnflag") == "N").cast("int").alias("m"))
    x = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    part = lambda f: F.transform("x", lambda s: s[f])
    return x.select("l_orderkey", part("r").alias("r"), part("v").alias("v"), part("m").alias("m"))


def _long(rows: DataFrame, value, digits: int = 6):
    return rows.select("l_orderkey", F.posexplode(value).alias("t", "y")).select("l_orderkey", "t", F.round("y", digits).alias("x"))


def discounted_return(spark, sf):
    return _long(_seqs(spark, sf), A.discounted_returns(F.lit(1.0), F.col("r"), F.col("m"), 0.1, 0.9), 10)


def gae(spark, sf):
    return _long(_seqs(spark, sf), A.advantages(F.col("r"), F.col("v"), 0.99, 0.95))


def group_returns(spark, sf):
    return _long(_seqs(spark, sf), A.broadcast_reward(F.size("r").cast("double"), F.col("r"), 0.1))


def masked_mean(spark, sf):
    s = _seqs(spark, sf)
    return s.agg(F.round(F.sum(A.masked_mean(F.col("r"), F.col("m"))), 6).alias("mean_of_means"), F.round(F.sum(A.masked_sum(F.col("r"), F.col("m"))), 6).alias("total"))


def whiten(spark, sf):
    return _long(A.whiten(_seqs(spark, sf), "r", "m"), F.col("r"))


KINDS = ("k1", "k2", "k3", "low")


def kl_kinds(spark, sf):
    s = _seqs(spark, sf)
    k = [A.approximate_kl(F.col("r"), F.col("v"), x) for x in ("k1", "k2", "k3", "low_var_kl")]
    each = s.select("l_orderkey", F.posexplode(F.arrays_zip(*[x.alias(n) for x, n in zip(k, KINDS, strict=True)])).alias("t", "y"))
    return each.select("l_orderkey", "t", *[(F.round(F.col("y")[n], 6) + 0.0).alias(n) for n in KINDS])


def policy_loss(spark, sf):
    s = _seqs(spark, sf).withColumn("kl", F.zip_with("v", "r", lambda a, b: 10 * (a - b))).withColumn("adv", F.zip_with("r", "v", lambda a, b: a - b))
    x = s.select("l_orderkey", F.posexplode(A.policy_loss(F.col("kl"), F.col("adv"), 0.2, 0.28, 3.0)).alias("t", "y"))
    return x.select("l_orderkey", "t", (F.round("y.loss", 6) + 0.0).alias("loss"), F.col("y.clipped").alias("clipped"))


def sequence_kl(spark, sf):
    s = _seqs(spark, sf).withColumn("kl", A.sequence_kl(F.col("r"), F.col("v"), F.col("m")))
    adv = F.zip_with("r", "v", lambda a, b: a - b)
    return s.select("l_orderkey", (F.round("kl", 6) + 0.0).alias("kl"), A.total(A.off_policy_mask(adv, F.col("kl"), 0.0123)).alias("kept"))


def is_weights(spark, sf):
    s = _seqs(spark, sf).withColumns({"a": F.transform("r", lambda x: x * 20), "b": F.transform("v", lambda x: x * 20)})
    w = A.importance_weights(s, "a", "b", "m", mode="truncate", high=2.0, reject=True, reject_low=0.5, reject_high=2.0, veto=0.2, normalize=True)
    return w.select("l_orderkey", F.round(A.total(F.col("weights")), 6).alias("w"), A.total(F.col("new_mask")).alias("m"))


def is_weights_sequence(spark, sf):
    w = A.importance_weights(_seqs(spark, sf), "r", "v", "m", level="sequence", mode="clip", low=0.9, high=1.1)
    g = A.importance_weights(_seqs(spark, sf), "r", "v", "m", level="geometric", mode="mask", low=0.97, high=1.03)
    one = w.select("l_orderkey", F.round(A.total(F.col("weights")), 6).alias("clip"))
    return one.join(g.select("l_orderkey", A.total(F.col("new_mask")).alias("mask")), "l_orderkey")


def ratio_bounds(spark, sf):
    s = _seqs(spark, sf)
    both = F.arrays_zip(A.ratio_clamp(F.col("r"), F.col("v"), 0.98, 1.02).alias("clamped"), A.ratio_inside(F.col("r"), F.col("v"), 0.98, 1.02).alias("inside"))
    return s.select("l_orderkey", F.posexplode(both).alias("t", "y")).select("l_orderkey", "t", F.round("y.clamped", 6).alias("clamped"), F.round("y.inside", 6).alias("inside"))


def value_loss(spark, sf):
    return _long(_seqs(spark, sf), A.value_loss(F.col("r"), F.col("v"), F.transform("v", lambda x: x * 2), 0.02))


def response_lengths(spark, sf):
    return _seqs(spark, sf).select("l_orderkey", A.response_length(F.col("m")).alias("n"), F.size(A.pad_to(F.col("m"), 8)).alias("padded"))


def mask_segments(spark, sf):
    s = _seqs(spark, sf)
    return s.select("l_orderkey", F.array_join(A.mask_segments(F.transform("r", lambda x: F.format_string("%.2f,", x)), F.col("m")), "|").alias("text"))


def pack_unpack(spark, sf):
    s = _seqs(spark, sf).select((F.floor(F.col("l_orderkey") / 50)).alias("pack"), "l_orderkey", F.transform("m", lambda x: x.cast("long")).alias("m"))
    packed = R.pack(s, "pack", "l_orderkey", "m")
    back = R.unpack(packed, "pack")
    return back.select("pack", F.col("place").cast("long").alias("place"), F.array_join("tokens", "").alias("tokens"))


def skip_list(spark, sf):
    e = _t(spark, sf, "events").select("user_id")
    done = _t(spark, sf, "events").filter("event_type = 'click'").select("user_id")
    return R.skip_finished(e, done, "user_id").groupBy("user_id").agg(F.count("*").alias("left"))


def buffer_valid_groups(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "props")
    return R.valid_groups(e, "user_id", 16, F.coalesce(F.trim("props"), F.lit("")) != "").select("event_id", "user_id")


def newest_groups(spark, sf):
    return R.newest_groups(_t(spark, sf, "events"), "user_id", "ts", 20)


def windowed_counts(spark, sf):
    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def repetition(spark, sf):
    """Texts that repeat themselves, over whole documents joined by source."""
    return _t(spark, sf, "documents").select("doc_id", R.repeats_itself(F.col("text")).alias("repeats"))


_S = "s AS (SELECT o_custkey AS g, o_orderkey AS i, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM orders)"
_V = "v AS (SELECT g, stddev_samp(r) AS d, min(r) AS a FROM s GROUP BY g), k AS (SELECT g, coalesce(d > 0, false) AS keep, CASE WHEN NOT coalesce(d > 0, false) THEN 'zero_std_' || CASE WHEN a = 1 THEN '1.0' ELSE '0.0' END END AS reason FROM v)"
_Q = "q AS (SELECT l_orderkey, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY l_orderkey) AS len, l_discount AS r, l_tax AS v, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END))"

SQL = {
    "group_norm": f"WITH {_S} SELECT g, i, round((r - avg(r) OVER w) / (coalesce(stddev_samp(r) OVER w, 0) + 1e-6), 6) AS z FROM s WINDOW w AS (PARTITION BY g)",
    "group_baseline": f"WITH {_S} SELECT g, i, round(r - avg(r) OVER (PARTITION BY g), 6) AS z FROM s",
    "buffer_norm": """WITH e AS (SELECT event_id, user_id, value / 100 AS r, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN value / 100 END AS x FROM events), f AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS d, max(x) OVER w AS t FROM e WINDOW w AS (PARTITION BY user_id))
 SELECT event_id, round(CASE WHEN x IS NULL OR t = 0 THEN r WHEN d < 1e-8 THEN 0 ELSE (r - m) / (d + 1e-8) END, 6) AS z FROM f""",
    "zero_std_filter": f"WITH {_S}, {_V} SELECT g, keep, reason FROM k",
    "oversample_fill": f"WITH {_S}, {_V}, p AS (SELECT g, row_number() OVER (ORDER BY g) AS position FROM k WHERE keep) SELECT k.g, keep, reason, position, position IS NOT NULL AS taken FROM k LEFT JOIN (SELECT * FROM p WHERE position <= 256) p ON p.g = k.g",
    "zero_std_counts": f"WITH {_S}, v AS (SELECT g, min(r) AS a, max(r) AS b FROM s GROUP BY g) SELECT round(a, 1) AS reward, count(*) AS groups FROM v WHERE a = b GROUP BY 1",
    "pass_at_k": f"""WITH {_S}, n AS (SELECT g, count(*) AS n, sum(r) AS c FROM s GROUP BY g), x AS (SELECT k, CASE WHEN n - c < k THEN 1.0 ELSE 1 - list_product(list_transform(range(0, k), lambda i: (n - c - i) / (n - i))) END AS p FROM n, (SELECT unnest([1, 2, 4, 8]) AS k) WHERE n >= k)
 SELECT CAST(k AS INT) AS k, round(avg(p), 6) AS rate FROM x GROUP BY k""",
    "eval_report": "SELECT source, round(avg(quality), 6) AS reward, round(avg(CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END), 6) AS truncated, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "reward_share": "SELECT event_type, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type",
    "sample_metrics": "WITH c AS (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) SELECT round(avg(turns), 6) AS turns_mean, max(turns) AS turns_max, min(turns) AS turns_min, round(avg(CASE WHEN chars > 1000 THEN 1 ELSE 0 END), 6) AS clipped, CAST(sum(chars) AS BIGINT) AS chars FROM c",
    "length_statistics": "SELECT lang, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, max(n_chars) AS max, min(n_chars) AS min FROM documents GROUP BY lang",
    "throughput_metrics": "WITH o AS (SELECT o_orderpriority, o_totalprice AS s, o_custkey AS n, max(o_custkey) OVER (PARTITION BY o_orderpriority) AS top FROM orders) SELECT o_orderpriority, round(sum(n) / sum(s), 6) AS rate, round(avg(CASE WHEN n = top THEN n / s END), 6) AS longest FROM o GROUP BY 1",
    "ratio_kinds": "SELECT l_returnflag, round(avg(l_tax / l_quantity), 6) AS mean_of_ratios, round(sum(l_tax) / sum(l_quantity), 6) AS ratio_of_sums FROM lineitem GROUP BY 1",
    "weighted_merge": "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1",
    "length_histogram": "SELECT CASE WHEN n_chars < 500 THEN '0' WHEN n_chars < 1000 THEN '500' WHEN n_chars < 2000 THEN '1000' WHEN n_chars < 4000 THEN '2000' ELSE '4000' END AS bin, count(*) AS n FROM documents GROUP BY 1",
    "group_meta": "WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS r FROM events GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS groups, round(avg(n), 6) AS size, round(avg(r), 6) AS reward FROM g",
    "sample_fan_out": "SELECT p_partkey, g AS group_index, CAST(s AS INT) AS sample, g * 4 + s AS index FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS g FROM part), (SELECT unnest(range(4)) AS s)",
    "trim_batch": "SELECT o_orderkey AS i FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders) WHERE k <= n - n % 64",
    "debug_halves": "SELECT o_orderkey AS i FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders) WHERE k <= CAST(floor(n * 0.3) AS BIGINT) // 2 OR k > n - (CAST(floor(n * 0.3) AS BIGINT) - CAST(floor(n * 0.3) AS BIGINT) // 2)",
    "epoch_shuffle": "SELECT count(*) AS n, count(*) AS positions, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM part",
    "pack_offsets": "SELECT CAST(floor(doc_id / 64) AS BIGINT) AS step, doc_id, n_chars, CAST(sum(n_chars) OVER w AS BIGINT) AS stop, CAST(sum(n_chars) OVER w AS BIGINT) - n_chars AS start FROM documents WINDOW w AS (PARTITION BY floor(doc_id / 64) ORDER BY doc_id)",
    "discounted_return": f"""WITH {_Q}, z AS (SELECT *, max(CASE WHEN m = 1 THEN t END) OVER (PARTITION BY l_orderkey) AS last FROM q), y AS (SELECT *, -0.1 * r * m + CASE WHEN t = last THEN 1 ELSE 0 END AS own FROM z)
 SELECT a.l_orderkey, CAST(a.t AS INT) AS t, round(sum(b.own * 0.9 ** (b.t - a.t)), 10) AS x FROM y a JOIN y b ON a.l_orderkey = b.l_orderkey AND b.t >= a.t GROUP BY ALL""",
    "gae": f"""WITH {_Q}, d AS (SELECT *, r + 0.99 * coalesce(lead(v) OVER (PARTITION BY l_orderkey ORDER BY t), 0) - v AS d FROM q)
 SELECT a.l_orderkey, CAST(a.t AS INT) AS t, round(sum(b.d * (0.99 * 0.95) ** (b.t - a.t)), 6) AS x FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND b.t >= a.t GROUP BY ALL""",
    "group_returns": f"WITH {_Q} SELECT l_orderkey, CAST(t AS INT) AS t, round(len - 0.1 * r, 6) AS x FROM q",
    "masked_mean": f"WITH {_Q}, o AS (SELECT l_orderkey, sum(r * m) AS s, greatest(sum(m), 1) AS n FROM q GROUP BY 1) SELECT round(sum(s / n), 6) AS mean_of_means, round(sum(s), 6) AS total FROM o",
    "whiten": f"WITH {_Q}, z AS (SELECT sum(r * m) / sum(m) AS mean, (sum(r * r * m) / sum(m) - (sum(r * m) / sum(m)) ** 2) * sum(m) / (sum(m) - 1) AS var FROM q) SELECT l_orderkey, CAST(t AS INT) AS t, round((r - mean) / sqrt(var + 1e-8), 6) AS x FROM q, z",
    "kl_kinds": f"WITH {_Q} SELECT l_orderkey, CAST(t AS INT) AS t, round(r - v, 6) + 0.0::DOUBLE AS k1, round((r - v) ** 2 / 2, 6) + 0.0::DOUBLE AS k2, round(exp(v - r) - 1 - (v - r), 6) + 0.0::DOUBLE AS k3, round(least(greatest(exp(v - r) - 1 - (v - r), -10), 10), 6) + 0.0::DOUBLE AS low FROM q",
    "policy_loss": f"""WITH {_Q}, z AS (SELECT l_orderkey, t, exp(-10 * (v - r)) AS ratio, r - v AS a FROM q), y AS (SELECT *, -ratio * a AS p, -least(greatest(ratio, 0.8), 1.28) * a AS b FROM z)
 SELECT l_orderkey, CAST(t AS INT) AS t, round(CASE WHEN a < 0 THEN least(-3.0 * a, greatest(p, b)) ELSE greatest(p, b) END, 6) + 0.0::DOUBLE AS loss, CASE WHEN b > p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS clipped FROM y""",
    "sequence_kl": f"""WITH {_Q}, k AS (SELECT l_orderkey, sum((v - r) * m) / greatest(sum(m), 1) AS kl FROM q GROUP BY 1)
 SELECT l_orderkey, round(any_value(kl), 6) + 0.0::DOUBLE AS kl, CAST(sum(CASE WHEN r - v < 0 AND kl > 0.0123 THEN 0 ELSE 1 END) AS DOUBLE) AS kept FROM q JOIN k USING (l_orderkey) GROUP BY 1""",
    "is_weights": f"""WITH {_Q}, w AS (SELECT l_orderkey, m, least(exp(20 * r - 20 * v), 2.0) * m AS w, exp(20 * r - 20 * v) AS raw, max(CASE WHEN m = 1 AND 20 * r - 20 * v < ln(0.2) THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS bad FROM q), z AS (SELECT sum(w * m) / sum(m) AS mean FROM w)
 SELECT l_orderkey, round(sum(w / mean), 6) AS w, CAST(sum(CASE WHEN bad = 0 AND raw BETWEEN 0.5 AND 2.0 THEN m ELSE 0 END) AS DOUBLE) AS m FROM w, z GROUP BY 1""",
    "is_weights_sequence": f"""WITH {_Q}, k AS (SELECT l_orderkey, sum((r - v) * m) AS s, sum((r - v) * m) / greatest(sum(m), 1) AS g, sum(m) AS n FROM q GROUP BY 1)
 SELECT l_orderkey, round(least(greatest(exp(s), 0.9), 1.1) * n, 6) AS clip, CASE WHEN exp(g) BETWEEN 0.97 AND 1.03 THEN CAST(n AS DOUBLE) ELSE 0.0::DOUBLE END AS mask FROM k""",
    "ratio_bounds": f"WITH {_Q} SELECT l_orderkey, CAST(t AS INT) AS t, round(least(greatest(exp(r - v), 0.98), 1.02), 6) AS clamped, round(CASE WHEN exp(r - v) BETWEEN 0.98 AND 1.02 THEN exp(r - v) ELSE 0 END, 6) AS inside FROM q",
    "value_loss": f"WITH {_Q} SELECT l_orderkey, CAST(t AS INT) AS t, round(greatest((r - 2 * v) ** 2, (v + least(greatest(r - v, -0.02), 0.02) - 2 * v) ** 2), 6) AS x FROM q",
    "response_lengths": f"WITH {_Q} SELECT l_orderkey, CAST(coalesce(any_value(len) - min(CASE WHEN m = 1 THEN t END), 0) AS INT) AS n, CAST(ceil(any_value(len) / 8.0) * 8 AS INT) AS padded FROM q GROUP BY 1",
    "mask_segments": f"""WITH {_Q}, g AS (SELECT *, sum(1 - m) OVER (PARTITION BY l_orderkey ORDER BY t) AS run FROM q), h AS (SELECT l_orderkey, run, string_agg(printf('%.2f,', r), '' ORDER BY t) AS x FROM g WHERE m = 1 GROUP BY ALL)
 SELECT o.l_orderkey, coalesce(string_agg(x, '|' ORDER BY run), '') AS text FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN h USING (l_orderkey) GROUP BY 1""",
    "pack_unpack": f"WITH {_Q}, s AS (SELECT l_orderkey, string_agg(CAST(m AS VARCHAR), '' ORDER BY t) AS tokens FROM q GROUP BY 1) SELECT CAST(floor(l_orderkey / 50) AS BIGINT) AS pack, row_number() OVER (PARTITION BY floor(l_orderkey / 50) ORDER BY l_orderkey) - 1 AS place, tokens FROM s",
    "skip_list": "WITH c AS (SELECT user_id, count(*) - sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1) SELECT user_id, CAST(n AS BIGINT) AS left FROM c WHERE n > 0",
    "buffer_valid_groups": "SELECT event_id, user_id FROM (SELECT *, count(*) OVER w AS n, sum(CASE WHEN trim(coalesce(props, '')) <> '' THEN 1 ELSE 0 END) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id)) WHERE n >= 16 AND f >= 16",
    "newest_groups": "SELECT user_id, max(ts) AS newest FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "windowed_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
#: Largest differencing, first fit and compression have no SQL form.
ROWS_ONLY = ["balanced_parts", "first_fit_bins", "size_chunks", "repetition"]
QUERIES = {name: globals()[name] for name in [*SQL, *ROWS_ONLY]}
