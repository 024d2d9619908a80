"""Queries over dump cleaning, predicate counts, paths, graders and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.functions import graders as G
from lattika.operators import curation as C
from lattika.operators import kg as K
from lattika.plans.kg_queries import KG

NS = C.NS


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark, sf):
    kg = K.distinct_triples(spark, sf)
    key = F.pmod(F.length(F.concat("s", "p", "o")), F.lit(6))
    iri = lambda c: F.concat(F.lit(f"<{NS}"), F.col(c), F.lit(">"))
    good = F.concat_ws("\t", iri("s"), iri("p"), iri("o"), F.lit("."))
    literal = F.concat_ws("\t", iri("s"), iri("p"), F.concat(F.lit('"'), F.col("o"), F.lit('"@en')), F.lit("."))
    french = F.concat_ws("\t", iri("s"), iri("p"), F.concat(F.lit('"'), F.col("o"), F.lit('"@fr')), F.lit("."))
    typed = F.concat_ws("\t", iri("s"), iri("p"), F.concat(F.lit('"'), F.col("o"), F.lit(f'"^^<{C.XSD}#int>')), F.lit("."))
    short = F.concat_ws("\t", iri("s"), iri("p"), F.lit("."))
    return kg.select("s", "p", "o", F.when(key == 0, good).when(key == 1, literal).when(key == 2, french).when(key == 3, typed).when(key == 4, short).otherwise(F.concat(good, F.lit(" x"))).alias("value"))


def ntriples_filter(spark, sf):
    return _lines(spark, sf).select("s", "p", "o", C.keep_line(F.col("value")).alias("kept"))


def ntriples_parse(spark, sf):
    return C.parse_statements(_lines(spark, sf).select("value")).groupBy("p", "o_kind", "lang").agg(F.count("*").alias("n"), F.min("o").alias("least"))


def _sparql(spark, sf):
    p = _t(spark, sf, "part")
    text = F.concat(F.lit("PREFIX ns: <http://x/> # note\nSELECT ?x WHERE { ?x ns:"), F.translate("p_brand", "#", "."), F.lit(" ?y . ?y ns:a.b/ns:c.d+ ?z ;\n ns:e ?w . ?x a ns:"), F.translate("p_brand", "#", "."), F.lit(" }"))
    return p.select(F.col("p_size").alias("file"), text.alias("text"), "p_partkey")


def predicate_counts_rollup(spark, sf):
    return C.count_predicates(_sparql(spark, sf), "file", "text")


def predicate_iris(spark, sf):
    rows = _sparql(spark, sf).select(F.explode(C.predicate_tokens(F.col("text"))).alias("token")).distinct()
    return rows.select("token", C.full_iri(F.col("token")).alias("iri"), C.prefixed(C.full_iri(F.col("token"))).alias("short"))


def predicate_normalize(spark, sf):
    k = F.pmod("p_partkey", F.lit(4))
    raw = F.when(k == 0, F.concat(F.lit("http://a/"), F.col("p_name"))).when(k == 1, F.concat(F.lit("rdf-schema#"), F.col("p_brand"))).when(k == 2, F.translate("p_name", " ", ".")).otherwise(F.col("p_name"))
    return _t(spark, sf, "part").select("p_partkey", C.normalize_predicate(raw).alias("iri"), C.is_meaningful(C.normalize_predicate(raw)).alias("kept"))


def webqsp_graph_predicates(spark, sf):
    rows = K.distinct_triples(spark, sf).groupBy("s").agg(F.to_json(F.collect_list(F.array("s", "p", "o"))).alias("graph"))
    return C.graph_triples(rows, "graph").select(C.normalize_predicate(F.col("p")).alias("iri")).filter(C.is_meaningful(F.col("iri"))).distinct()


def path_enumerate(spark, sf):
    """Walks customer, order, line, part or supplier by name (mediators by id), counted by predicates."""
    kg = K.triples(spark, sf)
    start = _t(spark, sf, "customer").select(F.concat(F.lit("m.c"), F.col("c_custkey").cast("string")).alias("node"))
    paths = C.walks(kg, start, 3)
    return paths.groupBy(F.array_join(C.path_relations(F.col("path")), "/").alias("predicates")).agg(F.count("*").alias("n"), F.min(F.array_join("path", " ")).alias("least"))


def _paths(spark, sf):
    """Name paths supplier, nation, region with some disorder."""
    k = F.pmod("s_suppkey", F.lit(6))
    s, n, r = _t(spark, sf, "supplier"), _t(spark, sf, "nation"), _t(spark, sf, "region")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    end = F.when(k == 1, F.concat(F.lit(" "), F.upper("s_name"))).when(k == 2, F.lit("m.x")).otherwise(F.col("r_name"))
    last = F.when(k == 3, "business.supplier.nation").when(k == 4, "bad.relation").otherwise("location.nation.region")
    path = F.when(k == 5, F.array("s_name")).otherwise(F.array(F.col("s_name"), F.lit("business.supplier.nation"), F.col("n_name"), last, end))
    return rows.select("s_suppkey", "n_name", "r_name", path.alias("path"))


def path_filter_reasons(spark, sf):
    out = C.filter_paths(_paths(spark, sf), predicates=["bad.relation"], names=["nation_3"], least=1, most=3)
    return out.select("s_suppkey", "reason")


def path_hops(spark, sf):
    text = F.array_join("path", " --> ")
    return _paths(spark, sf).groupBy(C.hops(C.split_path(text)).alias("hops")).agg(F.count("*").alias("n"))


def path_conjunction(spark, sf):
    p = _paths(spark, sf)
    k = F.pmod("s_suppkey", F.lit(3))
    other = F.when(k == 0, F.array(F.lit("Z"), F.lit("r.one"), F.col("r_name"))).when(k == 1, F.array(F.lit("Z"), F.lit("r.one"), F.col("n_name"))).otherwise(F.array(F.lit("Z"), F.lit("location.nation.region"), F.lit("Y")))
    return C.filter_paths(p.withColumn("two", other), second="two").select("s_suppkey", "reason")


def path_steps_reason(spark, sf):
    k = F.pmod("p_partkey", F.lit(5))
    none = F.lit(None).cast("string")
    step = lambda r, rn, nn, u: F.struct(r.alias("relation_uri"), none.alias("relation"), rn.alias("relation_name"), nn.alias("node_name"), none.alias("node"), u.alias("node_uri"))
    steps = F.array(step(F.lit("ok"), F.lit("Fine"), F.lit("x"), none), step(F.when(k == 0, "bad").otherwise("ok"), F.when(k == 1, " BAD ").otherwise("y"), F.when(k == 2, " Evil").otherwise("z"), F.when(k == 3, "m.1")))
    return _t(spark, sf, "part").select("p_partkey", C.step_reason(steps, ["bad"], ["evil"]).alias("reason"))


def link_filter(spark, sf):
    return _t(spark, sf, "pages").select("page_id", C.keep_link(F.col("url"), F.lit(None).cast("string")).alias("kept"))


def code_safety(spark, sf):
    k = F.pmod("doc_id", F.lit(4))
    code = F.when(k == 0, "import math\nprint(math.pi)").when(k == 1, "import os\nos.system('x')").when(k == 2, "from numpy import array").otherwise(F.concat(F.lit("x = "), F.col("n_chars").cast("string")))
    return _t(spark, sf, "documents").select("doc_id", C.is_safe_code(code).alias("safe"))


def metadata_coerce(spark, sf):
    k = F.pmod("event_id", F.lit(3))
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.col("event_type"))
    m = C.metadata_map(raw)
    return _t(spark, sf, "events").select("event_id", F.size(m).alias("n"), m["k"].alias("k"), m["_raw"].alias("raw"))


def question_prep(spark, sf):
    rows = _t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("question"), F.array("p_brand").alias("answers"), F.create_map(F.lit("m"), F.col("p_type")).alias("topic_entity"))
    return C.prepare_questions(rows)


def long_prompt_filter(spark, sf):
    from lattika.operators.retrieval import tokens

    return _t(spark, sf, "documents").filter(F.size(tokens(F.col("text"))) <= 200).select("doc_id")


# -- graders ---------------------------------------------------------------------------------------------------------------


def _golds(spark, sf):
    """Predictions in four forms, golds of two."""
    k = F.pmod("p_partkey", F.lit(5))
    pred = F.when(k == 0, F.concat(F.lit('["An '), F.col("p_name"), F.lit('", "", "x y"]'))).when(k == 1, F.concat(F.col("p_name"), F.lit(" | a zzz | "))).when(k == 2, F.concat(F.lit("the  "), F.upper("p_name"))).when(k == 3, F.concat(F.lit('"'), F.substring_index("p_name", " ", 1), F.lit('"'))).otherwise(F.lit(""))
    golds = F.array(F.col("p_name"), F.concat(F.lit("A "), F.col("p_brand"), F.lit(" x")))
    return _t(spark, sf, "part").select("p_partkey", pred.alias("pred"), golds.alias("golds"))


def norm_answer(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.md5(G.normalize_answer(F.col("text"))).alias("normal"), F.md5(G.normalize_strict(F.col("text"))).alias("strict"))


def parse_predictions(spark, sf):
    return _golds(spark, sf).select("p_partkey", F.array_join(G.parse_prediction(F.col("pred")), "~").alias("parsed"))


def relaxed_em(spark, sf):
    return _golds(spark, sf).select("p_partkey", G.relaxed_match(F.col("pred"), F.col("golds")).alias("em"))


def token_f1(spark, sf):
    return _golds(spark, sf).select("p_partkey", F.round(G.merged_f1(F.col("pred"), F.col("golds")), 6).alias("f1"))


def max_f1(spark, sf):
    return _golds(spark, sf).select("p_partkey", F.round(G.max_f1(F.col("pred"), F.col("golds")), 6).alias("f1"))


def bag_f1(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", G.bag_f1(F.concat_ws(" ", "p_name", "p_name", F.lit("the")), F.concat_ws(" ", "p_name", "p_type")).alias("x"))
    return p.select("p_partkey", F.round("x.f1", 6).alias("f1"), F.round("x.precision", 6).alias("p"), F.round("x.recall", 6).alias("r"))


def _turns(spark, sf):
    """Turns as tagged text: other turns ask, the last one answers."""
    c = _t(spark, sf, "conversations")
    from pyspark.sql import Window as W

    last = F.col("turn") == F.max("turn").over(W.partitionBy("conv_id"))
    c = c.withColumn("final", last)
    k = F.pmod("turn", F.lit(3))
    text = F.when(F.col("final") & (F.col("conv_id") % 2 == 0), F.concat(F.lit("<think>t</think><answer>x</answer><answer> [\""), F.col("role"), F.lit("\"] </answer>"))).when(F.col("final"), "<think>t</think><answer>[]</answer>").when(k == 2, F.concat(F.lit("<kg-query>"), F.col("role"), F.lit("</kg-query>"))).otherwise(F.concat(F.lit("<think>a<think>b</think> <kg-query>get_relations(\""), F.col("role"), F.lit("\")</kg-query>")))
    info = F.when(k == 0, F.concat(F.lit("Invalid entity "), F.col("role"))).when(k == 1, F.col("role")).otherwise("  ")
    return c.select("conv_id", "turn", "role", "final", text.alias("text"), info.alias("info"))


def turn_tags(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(G.tagged(F.col("text"), "think"), "|").alias("think"), G.first_query(F.col("text")).alias("query"), G.last_answer(F.col("text")).alias("answer"))


def turn_rewards(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", G.format_reward(F.col("text"), F.col("final")).alias("v_fmt"), G.query_reward(F.lit(True), F.col("info")).alias("v_kg"))


def reward_total(spark, sf):
    """Weighted sum of the mean turn reward, the last turn's, the answer's and the retrieval score."""
    t = _turns(spark, sf).withColumns({"f": G.format_reward(F.col("text"), F.col("final")), "k": G.query_reward(F.lit(True), F.col("info"))})
    g = t.groupBy("conv_id").agg(F.avg(F.when(~F.col("final"), 0.5 * F.col("f") + 0.5 * F.col("k"))).alias("turns"), F.max(F.when(F.col("final"), F.col("f"))).alias("last"), F.max(F.when(F.col("final"), F.col("text"))).alias("text"), F.collect_list("info").alias("info"))
    golds = F.array(F.lit("user"))
    em = G.relaxed_match(G.last_answer(F.col("text")), golds)
    return g.select("conv_id", F.round(0.25 * F.coalesce("turns", F.lit(0.0)) + 0.25 * F.col("last") + em + 0.5 * G.retrieval_score(F.col("info"), golds), 6).alias("reward"))


def _rollouts(spark, sf):
    k = F.pmod("p_partkey", F.lit(6))
    head = F.lit("<|im_start|>user <answer>Beijing</answer><|im_end|>\n<|im_start|>assistant\n")
    good = F.concat(F.lit("<think>t</think>\n<search>q</search>\n<information>The "), F.upper("p_name"), F.lit("!</information>\n<think>u</think><answer>"))
    body = F.when(k == 0, F.concat(good, F.lit("the "), F.col("p_name"), F.lit("</answer>"))).when(k == 1, F.concat(good, F.lit("no</answer>"))).when(k == 2, F.concat(F.lit("<answer>"), F.col("p_name"), F.lit("</answer>"))).when(k == 3, F.lit("<think>t</think><answer>no</answer>")).when(k == 4, F.lit("<think>t</think> stray <answer>no</answer>")).otherwise("nothing")
    return _t(spark, sf, "part").select("p_partkey", F.concat(head, body).alias("text"), F.array("p_name").alias("golds"))


def search_em_score(spark, sf):
    return _rollouts(spark, sf).select("p_partkey", G.valid_sequence(F.col("text")).alias("valid"), G.extract_solution(F.col("text")).alias("answer"), F.round(G.search_score(F.col("text"), F.col("golds"), 0.2, 0.1, 0.1), 6).alias("score"))


def choice_reward(spark, sf):
    k = F.pmod("p_partkey", F.lit(5))
    letter = F.substring(F.lit("ABCDEFGH"), (F.pmod("p_partkey", F.lit(8)) + 1).cast("int"), F.lit(1))
    text = F.when(k == 0, F.concat(F.lit("<think>answer: A</think> The answer is "), letter)).when(k == 1, F.concat(letter, F.lit(" is correct"))).when(k == 2, F.concat(F.lit("so X or "), letter)).when(k == 3, F.col("p_name")).otherwise("none")
    return _t(spark, sf, "part").select("p_partkey", G.choice_letter(text).alias("letter"), G.choice_score(text, letter).alias("score"))


def dapo_score(spark, sf):
    k = F.pmod("p_partkey", F.lit(5))
    said = F.when(k == 0, F.concat(F.lit("Answer: "), F.col("p_size").cast("string"))).when(k == 1, F.concat(F.lit("Answer: 1\nanswer : $x = "), F.col("p_size").cast("string"), F.lit("$ dollars"))).when(k == 2, F.concat(F.lit("Answer: \\text{"), F.col("p_size").cast("string"), F.lit("}"))).when(k == 3, F.concat(F.lit("Answer: 1,"), F.lpad((100 + F.col("p_size")).cast("string"), 3, "0"))).otherwise("no")
    gold = F.when(k == 3, (1100 + F.col("p_size")).cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return _t(spark, sf, "part").select("p_partkey", G.integer_score(said, gold).alias("score"))


def boxed_answer(spark, sf):
    k = F.pmod("p_partkey", F.lit(3))
    text = F.when(k == 0, F.concat(F.lit("\\boxed{1} and \\boxed{"), F.col("p_size").cast("string"), F.lit("} end"))).when(k == 1, F.concat(F.lit("\\boxed{\\frac{"), F.col("p_size").cast("string"), F.lit("}{2}}"))).otherwise("\\boxed{open")
    return _t(spark, sf, "part").select("p_partkey", G.boxed(text).alias("answer"), G.boxed_score(text, F.col("p_size").cast("string")).alias("score"))


def math_equal(spark, sf):
    k = F.pmod("p_partkey", F.lit(4))
    n = F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("</think>\\boxed{\\dfrac "), F.lit("12}"))).when(k == 1, F.concat(F.lit("</think> \\boxed{x = "), n, F.lit(".0}"))).when(k == 2, F.concat(F.lit("</think>\\boxed{("), n, F.lit(", 2)}"))).otherwise("no")
    gold = F.when(k == 0, "\\frac{1}{2}").when(k == 1, n).otherwise(F.concat(F.lit("("), n, F.lit(",2)")))
    return _t(spark, sf, "part").select("p_partkey", G.think_math_score(text, gold).alias("score"))


def shaped_reward(spark, sf):
    t = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return t.select("conv_id", F.round(G.shaped_reward(F.when(F.col("conv_id") % 3 == 0, 1.0).otherwise(-1.0), F.col("n")), 6).alias("reward"))


def grader_dispatch(spark, sf):
    rows = _golds(spark, sf).withColumns({"kind": F.when(F.col("p_partkey") % 2 == 0, "f1"), "label": F.lit("1")})
    return G.grade(rows, "kind", "pred", "label", "golds").select("p_partkey", F.round("score", 6).alias("score"))




def _without(text: str, articles: str) -> str:
    """Whole words are taken out, with letters of any script; twice, for neighbours share their limit."""
    once = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{N}}_])(" + articles + ")([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g')"
    return "trim(regexp_replace(" + once.format(once.format(text)) + ", '\\s+', ' ', 'g'))"


class _Norm(str):
    """SQL of a normal form for a text expression."""

    def format(self, text: str) -> str:
        bare = f"lower({text})" if self == "plain" else f"regexp_replace(lower({text}), '[!-/:-@\\[-`{{-~]', '', 'g')"
        return _without(bare, "a|an" if self == "plain" else "a|an|the")


_NORM, _STRICT = _Norm("plain"), _Norm("strict")
_GOLDS = """g AS (SELECT p_partkey, p_name, [p_name, 'A ' || p_brand || ' x'] AS golds, CASE p_partkey % 5 WHEN 0 THEN ['An ' || p_name, 'x y'] WHEN 1 THEN [p_name, 'a zzz'] WHEN 2 THEN ['the  ' || upper(p_name)] WHEN 3 THEN [string_split(p_name, ' ')[1]] ELSE [] END AS preds FROM part)"""


class _Words(str):
    def format(self, text: str) -> str:
        return f"list_filter(string_split({_NORM.format(text)}, ' '), lambda t: t <> '')"


_W = _Words()
_F1 = "CASE WHEN len(list_intersect(a, b)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END"
_PAIRS = f"{_GOLDS}, x AS (SELECT p_partkey, unnest(preds) AS p, golds FROM g), y AS (SELECT p_partkey, p, unnest(golds) AS d FROM x), z AS (SELECT p_partkey, {_NORM.format('p')} AS n, {_NORM.format('d')} AS m, list_distinct({_W.format('p')}) AS a, list_distinct({_W.format('d')}) AS b FROM y)"
_TURN = """c AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS final FROM conversations),
t AS (SELECT conv_id, turn, role, final, CASE WHEN final AND conv_id % 2 = 0 THEN 1 WHEN final THEN 2 WHEN turn % 3 = 2 THEN 3 ELSE 4 END AS form, CASE turn % 3 WHEN 0 THEN 'Invalid entity ' || role WHEN 1 THEN role ELSE '  ' END AS info FROM c),
v AS (SELECT *, CASE WHEN form IN (1, 4) THEN 1.0 ELSE 0.0 END AS f, CASE WHEN turn % 3 = 1 THEN 1.0 ELSE 0.0 END AS k FROM t)"""
_PATH = """p AS (SELECT s_suppkey, s_name, n_name, r_name, s_suppkey % 6 AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""

SQL = {
    "ntriples_filter": f"WITH {KG} SELECT s, p, o, length(s || p || o) % 6 IN (0, 1, 3) AS kept FROM kg",
    "ntriples_parse": f"""WITH {KG}, x AS (SELECT p, length(s || p || o) % 6 AS k, o FROM kg) SELECT p, CASE WHEN k = 0 THEN 'iri' ELSE 'lit' END AS o_kind, CASE WHEN k = 1 THEN 'en' END AS lang, count(*) AS n, min(o) AS least FROM x WHERE k IN (0, 1, 3) GROUP BY ALL""",
    "predicate_counts_rollup": """WITH t AS (SELECT p_size AS g, unnest(['ns:' || replace(p_brand, '#', '.'), 'ns:' || replace(p_brand, '#', '.'), 'ns:a.b', 'ns:c.d', 'rdf:type', 'rdf:type']) AS predicate FROM part)
 SELECT g AS "group", predicate, count(*) AS n FROM t GROUP BY GROUPING SETS ((g, predicate), (predicate))""",
    "predicate_iris": f"""WITH t AS (SELECT DISTINCT unnest(['ns:' || replace(p_brand, '#', '.'), 'ns:a.b', 'ns:c.d', 'rdf:type']) AS token FROM part)
 SELECT token, CASE WHEN token = 'rdf:type' THEN '{C.RDF}type' ELSE '{NS}' || substr(token, 4) END AS iri, token AS short FROM t""",
    "predicate_normalize": f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http://a/' || p_name WHEN 1 THEN 'http://www.w3.org/2000/01/rdf-schema#' || p_brand WHEN 2 THEN '{NS}' || replace(p_name, ' ', '.') ELSE '{NS}' || p_name END AS iri,
 p_partkey % 4 = 2 OR p_partkey % 4 = 3 AND NOT contains(p_name, ' ') AS kept FROM part""",
    "webqsp_graph_predicates": f"WITH {KG} SELECT DISTINCT '{NS}' || p AS iri FROM kg",
    "path_enumerate": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), x AS (SELECT 'm.c' || o_custkey AS c, 'g.o' || o_orderkey AS o, 'g.l' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS i, l_partkey AS p, l_suppkey AS s FROM orders JOIN l ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
 y AS (SELECT 'people.customer.order/commerce.order.line/commerce.line.part' AS predicates, c || ' people.customer.order ' || o || ' commerce.order.line ' || i || ' commerce.line.part m.p' || p AS path FROM x UNION ALL SELECT 'people.customer.order/commerce.order.line/commerce.line.supplier', c || ' people.customer.order ' || o || ' commerce.order.line ' || i || ' commerce.line.supplier m.s' || s FROM x)
 SELECT predicates, count(*) AS n, min(path) AS least FROM y GROUP BY predicates""",
    "path_filter_reasons": f"WITH {_PATH} SELECT s_suppkey, CASE WHEN k = 5 THEN 'hops_too_short' WHEN k = 1 THEN 'duplicate_entities' WHEN k = 3 THEN 'duplicate_relations' WHEN k = 2 THEN 'entity_mid_prefix_in_name_path' WHEN k = 4 THEN 'predicate_blacklisted_in_name_path' WHEN lower(n_name) = 'nation_3' THEN 'entity_blacklisted_in_name_path' END AS reason FROM p",
    "path_hops": f"WITH {_PATH} SELECT CASE WHEN k = 5 THEN 0 ELSE 2 END AS hops, count(*) AS n FROM p GROUP BY 1",
    "path_conjunction": f"""WITH {_PATH} SELECT s_suppkey, CASE WHEN k = 1 THEN 'duplicate_entities' WHEN k = 3 THEN 'duplicate_relations' WHEN k = 2 THEN 'entity_mid_prefix_in_name_path'
 WHEN k = 4 THEN 'cross_path_duplicate_entity' END AS reason FROM p""",
    "path_steps_reason": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'predicate_blacklisted_in_steps' WHEN 1 THEN 'predicate_blacklisted_in_steps' WHEN 2 THEN 'entity_blacklisted_in_steps' WHEN 3 THEN 'mid_node_uri_in_steps' END AS reason FROM part",
    "link_filter": r"SELECT page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '(\.[^./]+)$', 1)) IN ('', '.html', '.htm', '.shtml') AS kept FROM pages",
    "code_safety": "SELECT doc_id, doc_id % 4 IN (0, 3) AS safe FROM documents",
    "metadata_coerce": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 1 THEN event_type END AS raw FROM events",
    "question_prep": """SELECT p_name AS question, '{"id":"' || p_partkey || '","topic_entity":{"m":"' || p_type || '"},"answers":["' || p_brand || '"]}' AS metadata FROM part WHERE p_partkey % 3 <> 0""",
    "long_prompt_filter": "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(lower(translate(text, '.,!?;:()[]{}\"''/\\', '                 ')), '\\s+'), lambda x: x <> '')) <= 200",
    "norm_answer": f"SELECT conv_id, turn, md5({_NORM.format('text')}) AS normal, md5({_STRICT.format('text')}) AS strict FROM conversations",
    "parse_predictions": f"WITH {_GOLDS} SELECT p_partkey, array_to_string(list_transform(preds, lambda t: trim(t)), '~') AS parsed FROM g",
    "relaxed_em": f"WITH {_PAIRS} SELECT p_partkey, coalesce(max(CASE WHEN contains(n, m) OR n <> '' AND contains(m, n) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0::DOUBLE) AS em FROM part LEFT JOIN z USING (p_partkey) GROUP BY p_partkey",
    "token_f1": f"WITH {_GOLDS}, q AS (SELECT p_partkey, list_distinct(flatten(list_transform(preds, lambda p: {_W.format('p')}))) AS a, list_distinct(flatten(list_transform(golds, lambda p: {_W.format('p')}))) AS b FROM g) SELECT p_partkey, round(CAST({_F1} AS DOUBLE), 6) AS f1 FROM q",
    "max_f1": f"WITH {_PAIRS} SELECT p_partkey, round(coalesce(max(CAST({_F1} AS DOUBLE)), 0), 6) AS f1 FROM part LEFT JOIN z USING (p_partkey) GROUP BY p_partkey",
    "bag_f1": f"""WITH w AS (SELECT p_partkey, string_split({_STRICT.format("p_name || ' ' || p_name || ' the'")}, ' ') AS a, string_split({_STRICT.format("p_name || ' ' || p_type")}, ' ') AS b FROM part),
 c AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda u: u = t)), len(list_filter(b, lambda u: u = t))))) AS s FROM w)
 SELECT p_partkey, round(CAST(CASE WHEN s = 0 THEN 0 ELSE 2.0 * s / (len(a) + len(b)) END AS DOUBLE), 6) AS f1, round(CAST(s AS DOUBLE) / len(a), 6) AS p, round(CAST(s AS DOUBLE) / len(b), 6) AS r FROM c""",
    "turn_tags": f"""WITH {_TURN} SELECT conv_id, turn, CASE form WHEN 1 THEN 't' WHEN 2 THEN 't' WHEN 3 THEN '' ELSE 'b' END AS think, CASE form WHEN 3 THEN role WHEN 4 THEN 'get_relations("' || role || '")' END AS query, CASE form WHEN 1 THEN '["' || role || '"]' WHEN 2 THEN '[]' END AS answer FROM t""",
    "turn_rewards": f"WITH {_TURN} SELECT conv_id, turn, CAST(f AS DOUBLE) AS v_fmt, CAST(k AS DOUBLE) AS v_kg FROM v",
    "reward_total": f"""WITH {_TURN} SELECT conv_id, round(CAST(0.25 * coalesce(avg(CASE WHEN NOT final THEN 0.5 * f + 0.5 * k END), 0) + 0.25 * max(CASE WHEN final THEN f END) + max(CASE WHEN final AND form = 1 AND (role = 'user') THEN 1 ELSE 0 END) + 0.5 * max(CASE WHEN contains(info, 'user') THEN 1 ELSE 0 END) AS DOUBLE), 6) AS reward FROM v GROUP BY conv_id""",
    "search_em_score": f"""SELECT p_partkey, p_partkey % 6 IN (0, 1, 3) AS valid, CASE p_partkey % 6 WHEN 0 THEN 'the ' || p_name WHEN 2 THEN p_name WHEN 5 THEN NULL ELSE 'no' END AS answer,
 CASE p_partkey % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.2::DOUBLE WHEN 4 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part""",
    "choice_reward": """WITH t AS (SELECT p_partkey, p_partkey % 5 AS k, substr('ABCDEFGH', CAST(p_partkey % 8 + 1 AS INT), 1) AS l, p_name FROM part)
 SELECT p_partkey, CASE WHEN k IN (0, 1, 2) THEN l END AS letter, CASE WHEN k IN (0, 1, 2) THEN 1.0::DOUBLE WHEN contains(lower(CASE WHEN k = 3 THEN p_name ELSE 'none' END), lower(l)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM t""",
    "dapo_score": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 2, 3) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM part",
    "boxed_answer": r"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '\frac{' || p_size || '}{2}' END AS answer, CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM part",
    "math_equal": "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 3) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM part",
    "shaped_reward": "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 1.0::DOUBLE ELSE round(CAST(least(-0.6, -1 + (count(*) - 2) / 2.0 * 0.1) AS DOUBLE), 6) END AS reward FROM conversations GROUP BY conv_id",
    "grader_dispatch": f"WITH {_PAIRS} SELECT p_partkey, round(coalesce(max(CASE WHEN p_partkey % 2 = 0 THEN CAST({_F1} AS DOUBLE) WHEN contains(n, m) OR n <> '' AND contains(m, n) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0), 6) AS score FROM part LEFT JOIN z USING (p_partkey) GROUP BY p_partkey",
}
QUERIES = {name: globals()[name] for name in SQL}
