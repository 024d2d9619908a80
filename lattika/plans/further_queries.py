"""Queries over lists, answers, caches, batches and buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.functions import graders as G
from lattika.functions import text as X
from lattika.operators import curation as C
from lattika.operators import kg as K
from lattika.operators import retrieval as R
from lattika.operators import samples as S
from lattika.plans.text_queries import _chats
from lattika.sources import lists as L
from lattika.sources.readers import shared_folder
from lattika.streaming import buffer as B


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def list_items(spark, sf):
    """Lists of part names and IRIs, some between fences, some broken."""
    k = F.pmod("p_partkey", F.lit(3))
    body = F.concat(F.lit('["'), F.col("p_name"), F.lit('", "http://rdf.freebase.com/ns/a/b.'), F.col("p_size").cast("string"), F.lit('"]'))
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("no list "), F.col("p_name")))
    items = _t(spark, sf, "part").select("p_partkey", L.list_items(text).alias("x"))
    return items.select("p_partkey", F.array_join("x", "|").alias("items"), L.dotted(F.get("x", 1)).alias("dotted"))


def name_paths(spark, sf):
    """Paths of items with the keys, kinds and arrows that data sets have."""
    k = F.pmod("p_partkey", F.lit(8))
    n, m = F.col("p_name"), F.regexp_replace("p_brand", "#", "")
    quoted = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    item = (
        F.when(k == 0, quoted('{"namePath": "', n, ' -> r --> ', m, '"}'))
        .when(k == 1, quoted('{"path": [" ', n, '", "", "r", "', m, '"], "names": "x -> y"}'))
        .when(k == 2, quoted('{"name_path1": "', n, '→r→', m, '", "name_path2": "a -> ', m, '"}'))
        .when(k == 3, quoted('{"id": "7", "other": "', n, ' → ', m, '"}'))
        .when(k == 4, quoted('{"name_path": null, "namepath": "', n, '-->', m, '"}'))
        .when(k == 5, quoted('{"id": 7, "text": "', n, '"}'))
        .when(k == 6, quoted(n, " -> ", m))
    )
    paths = _t(spark, sf, "part").select("p_partkey", C.name_paths(item).alias("x"))
    return paths.select("p_partkey", F.array_join(F.transform("x", lambda p: F.array_join(p, "|")), ";").alias("paths"))


def path_drop_counts(spark, sf):
    """How many paths from customers to nations stay, and why others go: structure, steps, names."""
    rows = _t(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 11 > 0, F.array("c_name", F.lit("customer.nation"), F.when(F.col("c_custkey") % 13 == 0, F.col("c_name")).otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))))).alias("path"),
        F.array(F.struct(F.lit("").alias("relation_uri"), F.col("c_mktsegment").alias("relation"), F.lit("x").alias("relation_name"), F.lit(None).cast("string").alias("node_name"), F.concat(F.lit(" N"), F.col("c_nationkey").cast("string")).alias("node"), F.when(F.col("c_custkey") % 7 == 0, "m.0").otherwise("x").alias("node_uri"))).alias("steps"),
    )
    return C.drop_counts(C.filter_paths(rows, "path", predicates=["BUILDING"], names=["n3", "n4"], steps="steps"))


def graph_of_texts(spark, sf):
    """Triples of lists as JSON and as texts of lists."""
    s, o = F.col("c_name"), F.col("c_nationkey").cast("string")
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('[["'), s, F.lit('", "p.q", "'), o, F.lit('"], ["x", "y"]]'))).otherwise(F.concat(F.lit("[['"), s, F.lit("', 'p.q', '"), o, F.lit("'], ['a', 'b', 'c']]")))
    return C.graph_triples(_t(spark, sf, "customer").select(text.alias("graph")), "graph")


def token_prefixes(spark, sf):
    token = F.concat(F.element_at(F.array(F.lit("m"), F.lit("ns"), F.lit("g"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int")), F.lit(":"), F.col("p_type"))
    return _t(spark, sf, "part").select("p_partkey", C.has_excluded_prefix(token).alias("by_default"), C.has_excluded_prefix(token, ["m", "g"]).alias("with_nodes"))


def math_values(spark, sf):
    """Answers equal in text, by value, with units, as tuples; and others."""
    n = F.col("p_size").cast("string")
    k = F.pmod("p_partkey", F.lit(10))
    said = (
        F.when(k == 0, F.concat(n, F.lit("\\text{ cm}"))).when(k == 1, F.concat(n, F.lit(" meters"))).when(k == 2, F.concat(n, F.lit("(x+1)"))).when(k == 3, F.concat(F.lit("\\frac{"), n, F.lit("}{3}")))
        .when(k == 4, F.concat(F.lit("("), n, F.lit(", 1,000]"))).when(k == 5, F.concat(n, F.lit("\\sqrt{4}"))).when(k == 6, F.concat(F.lit("x^2-"), n, F.lit("^2"))).when(k == 7, F.concat(n, F.lit("\\%"))).when(k == 8, F.concat(n, F.lit(" million"))).otherwise(F.concat(F.lit("y+"), n))
    )
    gold = (
        F.when(k == 0, n).when(k == 1, n).when(k == 2, F.concat(n, F.lit("x+"), n)).when(k == 3, F.concat(n, F.lit("/3"))).when(k == 4, F.concat(F.lit("("), n, F.lit(",1000]")))
        .when(k == 5, F.concat(n, F.lit("x"))).when(k == 6, F.concat(F.lit("(x-"), n, F.lit(")(x+"), n, F.lit(")"))).when(k == 7, n).when(k == 8, n).otherwise(F.concat(n, F.lit("+y+1")))
    )
    return _t(spark, sf, "part").select("p_partkey", G.math_score(F.concat(F.lit("so \\boxed{"), said, F.lit("}")), gold).alias("score"))


def turn_content(spark, sf):
    k = F.pmod("p_partkey", F.lit(4))
    n = F.col("p_name")
    text = F.concat(F.lit("<think>one</think>x<kg-query>get_relations('"), n, F.lit("')</kg-query><think>Two "), n, F.lit("</think><answer>no</answer>y<answer>"), n, F.lit("</answer>z"))
    content = G.turn_content(text, F.when(k == 0, n), F.when(k == 1, "any"), F.when(k == 2, F.concat(F.lit(" two "), n)))
    return _t(spark, sf, "part").select("p_partkey", content.alias("content"))


def gold_fallback(spark, sf):
    k = F.pmod("p_partkey", F.lit(5))
    label = F.when(k == 1, F.concat(F.lit('{"ground_truth": ["'), F.col("p_name"), F.lit('"]}'))).when(k == 2, F.concat(F.lit('{"answers": ["'), F.col("p_brand"), F.lit('"]}'))).when(k == 3, F.concat(F.lit('["a", "'), F.col("p_name"), F.lit('"]'))).when(k == 4, F.col("p_type"))
    gold = G.gold_answers(F.when(k == 0, F.array("p_name", "p_type")).otherwise(F.array().cast("array<string>")), label)
    return _t(spark, sf, "part").select("p_partkey", F.array_join(gold, "|").alias("gold"))


def random_grader(spark, sf):
    """The control grader gives 0 or 1, and the same again."""
    p = _t(spark, sf, "part").select(G.random_score(F.col("p_name"), F.col("p_type")).alias("a"), G.random_score(F.col("p_name"), F.col("p_type")).alias("b"))
    return p.agg(F.count("*").alias("n"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("same"), F.sum(F.col("a").isin(0.0, 1.0).cast("int")).alias("valid"))


def chat_templates(spark, sf):
    """Tokens and learned tokens of each chat by two further families of templates, and with an input of ten tokens more."""
    c = _chats(spark, sf)
    t = c.select("conv_id", X.masked_tokens(F.col("messages"), "system", "Be brief now.").alias("a"), X.masked_tokens(F.col("messages"), "distilled").alias("b"))
    ones = lambda x: F.size(F.filter(x, lambda y: y["mask"] == 1))
    longer = F.size(X.aligned_mask(F.transform("b", lambda x: x["mask"]), F.size("b") + 10))
    return t.select("conv_id", F.size("a").alias("n"), ones("a").alias("ones"), F.size("b").alias("n_distilled"), ones("b").alias("ones_distilled"), longer.alias("n_aligned"))


def sft_rows(spark, sf):
    r = _chats(spark, sf).select("conv_id", X.learned_sample(X.chat_tokens(F.col("messages"))).alias("r"))
    return r.select("conv_id", F.size("r.tokens").alias("n"), "r.response_length", F.size("r.loss_mask").alias("masked"), "r.reward")


def tool_conversation(spark, sf):
    c = _chats(spark, sf)
    tools = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit('{"name": "run"}'), F.lit('{"name": "stop"}')))
    said = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return c.select("conv_id", F.md5(X.conversation_with_tools(F.concat(F.lit("task "), F.col("conv_id").cast("string")), tools, said, "Help.")).alias("digest"))


def cls_pool(spark, sf):
    v = _t(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    return R.pooled(v, "label", "cls", "vec_id", vector="embedding").select("label", "i", F.round("x", 6).alias("x"))


def encoder_texts(spark, sf):
    n = F.col("p_name")
    return _t(spark, sf, "part").select("p_partkey", R.encoder_text(n, "E5-base").alias("query"), R.encoder_text(n, "e5", False).alias("passage"), R.encoder_text(n, "BGE-m3").alias("bge"), R.encoder_text(n, "dpr").alias("plain"))


def batch_retrieve(spark, sf):
    """The three best parts for the words of each brand's first part, with the whole rows."""
    p = _t(spark, sf, "part")
    corpus = p.select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    asked = p.groupBy(F.col("p_brand").alias("query")).agg(F.min_by("p_name", "p_partkey").alias("text"))
    hits = R.batch_retrieve(R.bm25_search(corpus, asked, 3), corpus.join(p.select(F.col("p_partkey").alias("doc"), "p_size"), "doc"))
    return hits.select("query", "rank", F.col("document.doc").alias("doc"), F.col("document.text").alias("text"), F.col("document.p_size").alias("p_size"), "score")


def corpus_docs(spark, sf):
    corpus = _t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    wanted = _t(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("doc"), "o_orderkey").filter("o_orderkey % 10 = 0")
    return L.docs_at(corpus, wanted).select("o_orderkey", "doc", F.md5("text").alias("digest"))


def cache_versions(spark, sf):
    """A cache of part names after three insertions and an eviction; the words that a stale name begins go with it."""
    p = _t(spark, sf, "part")
    first = p.filter("p_size < 10").select(F.split("p_name", " ")[0].alias("key"), F.lit(1).alias("v")).distinct().select("key", F.lit("old").alias("value"), F.lit(0).alias("version"))
    cache = R.cache_insert(first, p.filter("p_size >= 20").select(F.split("p_name", " ")[0].alias("key"), F.lit("new").alias("value")), 6)
    cache = R.cache_insert(cache, p.select(F.col("p_name").alias("key"), F.col("p_type").alias("value")), 7)
    return R.cache_evict(cache, 7, size=10)


def cache_statistics(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_name").alias("key"), F.col("p_type").alias("value"), F.col("p_size").alias("version"))
    return R.cache_statistics(R.cache_insert(p.filter("p_size < 5").dropDuplicates(["key"]), p.filter("p_size >= 5").select("key", "value"), 99))


def cache_answers(spark, sf):
    """Answers from a cache, else from a function that gives up on some texts at first."""
    p = _t(spark, sf, "part")
    cache = p.filter("p_size < 25").groupBy(F.col("p_name").alias("key")).agg(F.lit("held").alias("value"), F.lit(1).alias("version"))
    tried = []

    def make(rows):
        tried.append(1)
        return rows.select("text_id", F.when((F.col("text_id") % 3 < len(tried)) & (F.col("text_id") % 7 > 0), F.concat(F.lit("made "), "text")).alias("value"))

    return R.answer_from_cache(p.select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text")), cache, make, 2, tries=3)[0]


def relation_choice(spark, sf):
    """Of up to six names of each brand three: those that a reply names, else the first."""
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("query"), F.col("p_name").alias("relation")).distinct()
    ranked = K.ranked(p, ["query"], [F.col("relation")], 9)

    def ask(lists):
        return lists.filter(F.col("query").endswith("1") | F.col("query").endswith("2")).select("query", F.concat(F.lit('I take ["no such", "'), F.element_at("candidates", -1), F.lit('", "'), F.element_at("candidates", 2), F.lit('"].')).alias("reply"))

    return K.choose_relations(ranked, ask, 3, 6)


def entity_registry(spark, sf):
    """Names of a question's nation, given in either direction, of what triples showed, and of the store."""
    c = _t(spark, sf, "customer").select(F.col("c_mktsegment").alias("question"), F.concat(F.lit("m.c"), F.col("c_custkey").cast("string")).alias("head"), F.col("c_name").alias("head_name"), F.concat(F.lit("m.n"), F.col("c_nationkey").cast("string")).alias("tail"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("tail_name"))
    even = F.pmod(F.substring("tail", 4, 9).cast("int"), F.lit(2)) == 0
    topics = c.select("question", F.when(even, F.col("tail")).otherwise("x").alias("a"), F.when(even, "x").otherwise(F.col("tail")).alias("b"))
    registry = K.register(K.seed_registry(topics), c)
    asked = c.select("question", F.explode(F.array("head_name", "tail_name", "tail", F.lit("x"), F.lit("AFRICA"))).alias("text")).distinct()
    stored = K.names(spark, sf).select(F.col("name").alias("text"), "entity").filter("text = 'AFRICA'")
    return K.resolve_registered(asked, registry, stored)


def sample_without(spark, sf):
    """How many of each customer's orders are sampled, and that none is twice."""
    o = S.sample_without(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4, 7)
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("different"))


def group_order(spark, sf):
    return S.order_groups(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def dynamic_batch(spark, sf):
    return S.dynamic_batch(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


def fixed_slices(spark, sf):
    return S.fixed_slices(_t(spark, sf, "orders").select((F.col("o_custkey") % 8).alias("rank"), "o_orderkey"), "rank", "o_orderkey", 64)


def micro_batch(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    a = S.micro_batch(o, "o_orderkey", ["o_orderkey", "o_totalprice"], offset=128, size=32).withColumn("way", F.lit("slice"))
    return a.unionByName(S.micro_batch(o, "o_orderkey", ["o_orderkey", "o_totalprice"], indices=[5, 3, 3, 99]).withColumn("way", F.lit("indices")))


def rank_lengths(spark, sf):
    return S.reindexed(_t(spark, sf, "documents").select((F.col("doc_id") % 16).alias("rank"), "doc_id", "n_chars"), "rank", "doc_id", "n_chars")


def requeue(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "aborted").otherwise("completed").alias("status"))
    done, waiting = S.requeue(e.filter("event_id % 3 > 0"), "status", e.filter("event_id % 3 = 0").withColumn("status", F.lit("pending")))
    return done.withColumn("queue", F.lit(False)).unionByName(waiting.withColumn("queue", F.lit(True)))


def epoch_rows(spark, sf):
    return S.repeat_epochs(_t(spark, sf, "nation").select("n_nationkey"), 3)


def rank_means(spark, sf):
    # sums by decimals are the same in any order; where a value is none (NaN, infinite, huge), as doubles
    exact = F.col("value").try_cast("decimal(28,10)")
    x = F.when(F.count("value") == F.count(exact), F.sum(exact).cast("double")).otherwise(F.sum("value"))
    m = _t(spark, sf, "events").groupBy((F.col("user_id") % 8).alias("rank"), "event_type").agg(x.alias("x"))
    # the mean of a few ranks is off in its last bits only: seven places leave a half a half
    return S.mean_over_ranks(m, "event_type", "x", "train").select("metric", F.round(F.round("mean", 7), 2).alias("mean"))


def phase_times(spark, sf):
    t = _t(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"))
    whole = t.select(F.lit("step").alias("name"), "seconds")
    return S.phase_times(t.union(whole), "name", "seconds", "step").select("phase", F.round("seconds", 4).alias("seconds"), F.round("share", 6).alias("share"))


def interval_statistics(spark, sf):
    """What each trigger of a stream brought, added up again."""
    s = B.interval_statistics(B.read_stream(spark, sf, "events").select("user_id", "value"), "user_id", "value")
    return s.agg(F.sum("total").alias("total"), F.round(F.sum(F.col("mean") * F.col("total")) / F.sum("total"), 6).alias("mean"))


def buffer_reads(spark, sf):
    """Complete groups of two writes to a buffer: those of the first read, and those that the second read found besides."""
    import uuid

    b = B.GroupBuffer(spark, f"{shared_folder(spark)}/buffer-{uuid.uuid4().hex}", "user_id", 4, lambda df: df.groupBy("user_id").agg(F.count("*").alias("n")))
    e = _t(spark, sf, "events").select("user_id", "event_id")
    half = F.col("event_id") <= e.agg(F.median("event_id")).first()[0]
    b.write(e.filter(half))
    first = b.read().withColumn("reading", F.lit(1))
    b.write(e.filter(~half))
    return first.unionByName(b.read().withColumn("reading", F.lit(2)))


_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
_TOKENS = "list_filter(regexp_split_to_array(lower(translate({}, '.,!?;:()[]{{}}\"''/\\', '                 ')), '\\s+'), lambda x: x <> '')"
_CHAT = f"c AS (SELECT conv_id, turn, role, text, {_WORDS.format('text')} AS n, role = 'assistant' AND turn % 5 <> 3 AS on_, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)"
_HEAD, _TAIL = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in (X.TOOLS_HEAD, X.TOOLS_TAIL))

SQL = {
    "list_items": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name || '|http://rdf.freebase.com/ns/a/b.' || p_size END AS items, CASE WHEN p_partkey % 3 < 2 THEN 'a.b.' || p_size END AS dotted FROM part",
    "name_paths": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN n || '|r|' || m WHEN 1 THEN n || '|r|' || m WHEN 2 THEN n || '|r|' || m || ';a|' || m WHEN 3 THEN n || '|' || m WHEN 4 THEN n || '|' || m WHEN 5 THEN '' WHEN 6 THEN n || '|' || m ELSE '' END AS paths
 FROM (SELECT p_partkey, p_name AS n, replace(p_brand, '#', '') AS m FROM part)""",
    "path_drop_counts": """WITH r AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'missing_name_path' WHEN c_custkey % 13 = 0 THEN 'duplicate_entities' WHEN c_mktsegment = 'BUILDING' THEN 'predicate_blacklisted_in_steps' WHEN c_nationkey IN (3, 4) THEN 'entity_blacklisted_in_steps' WHEN c_custkey % 7 = 0 THEN 'mid_node_uri_in_steps' ELSE 'kept' END AS outcome FROM customer)
 SELECT outcome, count(*) AS n FROM (SELECT outcome FROM r UNION ALL SELECT 'total' FROM r) GROUP BY 1""",
    "graph_of_texts": "SELECT c_name AS s, 'p.q' AS p, CAST(c_nationkey AS VARCHAR) AS o FROM customer UNION ALL SELECT 'a', 'b', 'c' FROM customer WHERE c_custkey % 2 = 1",
    "token_prefixes": "SELECT p_partkey, false AS by_default, p_size % 4 IN (0, 2) AS with_nodes FROM part",
    "math_values": "SELECT p_partkey, CASE WHEN p_partkey % 10 IN (0, 1, 2, 3, 4, 6, 7) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part",
    "turn_content": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<think>one</think>x<kg-query>get_relations(''' || p_name || ''')</kg-query>'
 WHEN 1 THEN '<think>one</think>x<kg-query>get_relations(''' || p_name || ''')</kg-query><think>Two ' || p_name || '</think><answer>no</answer>y<answer>' || p_name || '</answer>' WHEN 2 THEN '<think>Two ' || p_name || '</think><answer>no</answer>' ELSE '' END AS content FROM part""",
    "gold_fallback": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN 'a|' || p_name ELSE p_type END AS gold FROM part",
    "random_grader": "SELECT count(*) AS n, count(*) AS same, count(*) AS valid FROM part",
    "chat_templates": f"""WITH {_CHAT} SELECT conv_id, CAST(sum(n + 2) + CASE WHEN max(CASE WHEN k = 1 THEN role END) = 'system' THEN 0 ELSE 5 END AS INT) AS n, CAST(sum(CASE WHEN on_ THEN n + 1 ELSE 0 END) AS INT) AS ones,
 CAST(sum(CASE WHEN k = 1 THEN n + 2 ELSE 0 END) + sum(CASE WHEN back = 1 THEN n ELSE 0 END) AS INT) AS n_distilled, CAST(sum(CASE WHEN back = 1 AND turn % 5 <> 3 THEN n ELSE 0 END) AS INT) AS ones_distilled,
 CAST(sum(CASE WHEN k = 1 THEN n + 2 ELSE 0 END) + sum(CASE WHEN back = 1 THEN n ELSE 0 END) + 10 AS INT) AS n_aligned FROM c GROUP BY 1""",
    "sft_rows": f"""WITH {_CHAT}, s AS (SELECT *, min(CASE WHEN on_ THEN k END) OVER (PARTITION BY conv_id) AS f FROM c)
 SELECT conv_id, CAST(sum(n + 2) AS INT) AS n, CAST(coalesce(sum(CASE WHEN k >= f THEN n + 2 END) - 1, 0) AS INT) AS response_length, CAST(coalesce(sum(CASE WHEN k >= f THEN n + 2 END) - 1, 0) AS INT) AS masked, 0.0::DOUBLE AS reward FROM s GROUP BY 1""",
    "tool_conversation": f"""SELECT conv_id, md5('<|im_start|>systemHelp.' || CASE WHEN conv_id % 2 = 0 THEN '{_HEAD}' || '{{"name": "run"}}{{"name": "stop"}}' || '{_TAIL}' ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>usertask ' || conv_id || '<|im_end|>'
 || coalesce(string_agg(chr(10) || '<|im_start|>' || role || text || '<|im_end|>', '' ORDER BY turn) FILTER (role IN ('user', 'assistant')), '') || chr(10) || '<|im_start|>assistant') AS digest FROM conversations GROUP BY 1""",
    "cls_pool": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1) SELECT label, CAST(i - 1 AS INT) AS i, round(CAST(e[i] AS DOUBLE), 6) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM f)",
    "encoder_texts": "SELECT p_partkey, 'query: ' || p_name AS query, 'passage: ' || p_name AS passage, 'Represent this sentence for searching relevant passages: ' || p_name AS bge, p_name AS plain FROM part",
    "batch_retrieve": f"""WITH d AS (SELECT p_partkey AS doc, p_name || ' ' || p_type AS text, p_size, {_TOKENS.format("p_name || ' ' || p_type")} AS w FROM part), z AS (SELECT count(*) AS nd, avg(len(w)) AS mean FROM d),
 q AS (SELECT p_brand AS query, arg_min(p_name, p_partkey) AS text FROM part GROUP BY 1), a AS (SELECT query, word, count(*) AS qf FROM (SELECT query, unnest({_TOKENS.format("text")}) AS word FROM q) GROUP BY ALL),
 c AS (SELECT doc, n, word, count(*) AS tf FROM (SELECT doc, len(w) AS n, unnest(w) AS word FROM d) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM c GROUP BY word),
 s AS (SELECT query, doc, round(sum(qf * ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * n / mean))), 6) AS score FROM c JOIN f USING (word) JOIN a USING (word), z GROUP BY ALL)
 SELECT query, rank, doc, text, p_size, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM s) JOIN d USING (doc) WHERE rank <= 3""",
    "corpus_docs": "SELECT o_orderkey, doc_id AS doc, md5(text) AS digest FROM orders JOIN documents ON doc_id = o_orderkey % 500 WHERE o_orderkey % 10 = 0",
    "cache_versions": """WITH f AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS key FROM part WHERE p_size < 10), g AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS key FROM part WHERE p_size >= 20),
 stale AS (SELECT key FROM f WHERE key NOT IN (SELECT key FROM g) AND key NOT IN (SELECT p_name FROM part)),
 c AS (SELECT key, 'new' AS value, 6 AS version FROM g WHERE key NOT IN (SELECT p_name FROM part) UNION ALL SELECT p_name, min(p_type), 7 FROM part GROUP BY 1)
 SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM stale WHERE starts_with(c.key, stale.key))""",
    "cache_statistics": "WITH c AS (SELECT p_name AS key, CASE WHEN max(p_size) >= 5 THEN 99 ELSE max(p_size) END AS version, bool_and(p_size >= 5) AS only_new FROM part GROUP BY 1) SELECT count(*) AS entries, CAST(sum(length(key)) AS BIGINT) AS characters, min(version) AS oldest, max(version) AS newest FROM c",
    "cache_answers": """WITH h AS (SELECT DISTINCT p_name FROM part WHERE p_size < 25) SELECT p_partkey AS text_id, p_name AS text, CASE WHEN p_name IN (SELECT p_name FROM h) THEN 'held' WHEN p_partkey % 7 > 0 THEN 'made ' || p_name END AS value FROM part""",
    "relation_choice": """WITH r AS (SELECT query, relation, row_number() OVER (PARTITION BY query ORDER BY relation) AS k FROM (SELECT DISTINCT p_brand AS query, p_name AS relation FROM part)),
 l AS (SELECT query, list(relation ORDER BY k) AS c FROM r WHERE k <= 6 GROUP BY 1),
 x AS (SELECT query, CASE WHEN len(c) > 3 AND (query LIKE '%1' OR query LIKE '%2') THEN [c[len(c)], c[2]] ELSE c[1:3] END AS c FROM l)
 SELECT query, c[i] AS relation, CAST(i AS INT) AS rank FROM (SELECT query, c, unnest(range(1, len(c) + 1)) AS i FROM x)""",
    "entity_registry": """WITH c AS (SELECT c_mktsegment AS question, 'm.c' || c_custkey AS head, c_name AS head_name, 'm.n' || c_nationkey AS tail, 'N' || c_nationkey AS tail_name FROM customer),
 x AS (SELECT question, min(tail) AS entity FROM c GROUP BY 1),
 a AS (SELECT DISTINCT question, text FROM (SELECT question, unnest([head_name, tail_name, tail, 'x', 'AFRICA']) AS text FROM c)),
 h AS (SELECT question, head_name AS text, min(head) AS entity FROM c GROUP BY ALL), t AS (SELECT question, tail_name AS text, min(tail) AS entity FROM c GROUP BY ALL),
 s AS (SELECT r_name AS text, 'm.r' || r_regionkey AS entity FROM region WHERE r_name = 'AFRICA')
 SELECT a.question, a.text, CASE WHEN starts_with(a.text, 'm.') THEN a.text WHEN a.text = 'x' THEN x.entity ELSE coalesce(h.entity, t.entity, s.entity) END AS entity
 FROM a JOIN x USING (question) LEFT JOIN h ON h.question = a.question AND h.text = a.text LEFT JOIN t ON t.question = a.question AND t.text = a.text LEFT JOIN s ON s.text = a.text""",
    "sample_without": "SELECT o_custkey, least(count(*), 4) AS n, least(count(*), 4) AS different FROM orders GROUP BY 1",
    "group_order": "WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey), o_custkey) - 1 AS place FROM orders GROUP BY 1) SELECT o_custkey, o_orderkey, place FROM orders JOIN g USING (o_custkey)",
    "dynamic_batch": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders) WHERE k <= n - n % 7",
    "fixed_slices": "WITH s AS (SELECT o_custkey % 8 AS rank, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1) // 64 AS INT) AS micro_batch FROM orders) SELECT *, CAST(max(micro_batch) OVER () + 1 AS INT) AS steps FROM s",
    "micro_batch": """WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)
 SELECT k - 128 AS place, o_orderkey, o_totalprice, 'slice' AS way FROM o WHERE k BETWEEN 128 AND 159 UNION ALL SELECT p, o_orderkey, o_totalprice, 'indices' FROM o JOIN (VALUES (0, 5), (1, 3), (2, 3), (3, 99)) t(p, i) ON k = i""",
    "rank_lengths": "SELECT doc_id % 16 AS rank, doc_id, n_chars, row_number() OVER w - 1 AS place, CAST(sum(n_chars) OVER w AS BIGINT) AS total FROM documents WINDOW w AS (PARTITION BY doc_id % 16 ORDER BY doc_id)",
    "requeue": "WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'aborted' ELSE 'completed' END AS status FROM events) SELECT event_id, CASE WHEN event_id % 3 = 0 OR status = 'aborted' THEN 'pending' ELSE status END AS status, event_id % 3 = 0 OR status = 'aborted' AS queue FROM e",
    "epoch_rows": "SELECT n_nationkey, CAST(e AS INT) AS epoch FROM nation, range(3) t(e)",
    "rank_means": "SELECT 'train/' || event_type AS metric, round(avg(x), 2) AS mean FROM (SELECT user_id % 8 AS r, event_type, sum(value) AS x FROM events GROUP BY ALL) GROUP BY 1",
    "phase_times": "WITH t AS (SELECT event_type AS phase, value FROM events UNION ALL SELECT 'step', value FROM events) SELECT phase, round(sum(value), 4) AS seconds, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM t GROUP BY 1",
    "interval_statistics": "SELECT CAST(count(*) AS BIGINT) AS total, round(avg(value), 6) AS mean FROM events",
    "buffer_reads": """WITH m AS (SELECT median(event_id) AS m FROM events), a AS (SELECT user_id, count(*) FILTER (event_id <= m) AS x, count(*) AS n FROM events, m GROUP BY 1)
 SELECT user_id, CASE WHEN x >= 4 THEN x ELSE n END AS n, CAST(CASE WHEN x >= 4 THEN 1 ELSE 2 END AS INT) AS reading FROM a WHERE n >= 4""",
}
QUERIES = {name: globals()[name] for name in SQL}
