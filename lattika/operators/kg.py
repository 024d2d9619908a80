"""A triple store over ordinary tables, and the set-based forms of its look-ups.

Every operator takes and returns DataFrames: a batch of probes is answered by
joins, never one request at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattika.operators.retrieval import bm25_okapi

#: Relations that describe the store itself (fixed values). The reading that takes each for itself.
META = [
    "type.object.type", "type.type.instance", "type.type.properties", "type.property.schema", "common.topic.article", "common.topic.image",
    "common.image_source", "common.document", "common.webpage", "common.license", "common.topic.description", "freebase.type_hints.included_types",
    "freebase.property_hints.best_value_properties", "freebase.property_hints.mediator", "freebase.property_hints.unit", "freebase.property_hints.expected_type",
    "freebase.type_hints.enumeration", "type.object.key", "type.object.permission", "type.object.profile", "type.object.service",
    "common.topic.topic_equivalent_webpage", "common.topic.topic_equivalent",
]
#: Neighbours that the strict reading fuses into one, so that neither is dropped (fixed values).
FUSED = ["freebase.type_hints.enumeration", "type.object.key", "type.object.service", "common.topic.topic_equivalent_webpage"]

#: Relations of an entity, triples of a relation, plain triples kept (without and with mediators), candidates ranked and kept (fixed values).
LIMIT, PER_RELATION, PLAIN, PLAIN_WITH_MEDIATOR, CANDIDATES, KEPT_CANDIDATES = 100, 20, 5, 15, 80, 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Of each predicate the table of its statements, and the kind and key columns of subject and object.
STATEMENTS = {
    "location.nation.region": ("nation", ("m.n", ["n_nationkey"]), ("m.r", ["n_regionkey"])),
    "people.customer.nation": ("customer", ("m.c", ["c_custkey"]), ("m.n", ["c_nationkey"])),
    "business.supplier.nation": ("supplier", ("m.s", ["s_suppkey"]), ("m.n", ["s_nationkey"])),
    "people.customer.order": ("orders", ("m.c", ["o_custkey"]), ("g.o", ["o_orderkey"])),
    "commerce.order.line": ("lineitem", ("g.o", ["l_orderkey"]), ("g.l", LINE)),
    "commerce.line.part": ("lineitem", ("g.l", LINE), ("m.p", ["l_partkey"])),
    "commerce.line.supplier": ("lineitem", ("g.l", LINE), ("m.s", ["l_suppkey"])),
}
#: Tables without a key: their statements can stand several times.
KEYLESS = {"lineitem": LINE}


def statements(spark: SparkSession, sf_dir: str, predicate: str) -> DataFrame:
    """s0, s1 ... and o0, o1 ...: the typed keys of subjects and objects of one predicate. Joins on them compare numbers, and filters reach the table's scan."""
    name, (_, s), (_, o) = STATEMENTS[predicate]
    return read(spark, sf_dir, name).select(*[F.col(c).alias(f"s{k}") for k, c in enumerate(s)], *[F.col(c).alias(f"o{k}") for k, c in enumerate(o)])


def triples(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """kg(s, p, o): one branch for each predicate, with the predicate as a literal, so that a filter on p reads only its tables.

    A bag; once: each triple once. Equal statements are found by their numbers, and
    only in tables without a key; the ids are put together afterwards.
    """

    def node(kind: str, columns: list[str]) -> Column:
        return F.concat(F.lit(kind), F.concat_ws("_", *columns))

    def branch(predicate: str) -> DataFrame:
        name, s, o = STATEMENTS[predicate]
        rows = read(spark, sf_dir, name)
        if once and name in KEYLESS:
            rows = rows.select(*KEYLESS[name]).distinct()
        return rows.select(node(*s).alias("s"), F.lit(predicate).alias("p"), node(*o).alias("o"))

    return reduce(DataFrame.unionByName, map(branch, STATEMENTS))


def distinct_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir, once=True)


NAMED = [("region", "m.r", "r_regionkey", "r_name", "location.region"), ("nation", "m.n", "n_nationkey", "n_name", "location.nation"), ("customer", "m.c", "c_custkey", "c_name", "people.customer"), ("supplier", "m.s", "s_suppkey", "s_name", "business.supplier"), ("part", "m.p", "p_partkey", "p_name", "commerce.part")]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, name, lang."""
    return reduce(DataFrame.unionByName, [read(spark, sf_dir, t).select(F.concat(F.lit(kind), F.col(k).cast("string")).alias("entity"), F.col(n).alias("name"), F.lit("en").alias("lang")) for t, kind, k, n, _ in NAMED])


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, type; parts have their p_type and p_brand as further types."""
    plain = [read(spark, sf_dir, t).select(F.concat(F.lit(kind), F.col(k).cast("string")).alias("entity"), F.lit(x).alias("type")) for t, kind, k, _, x in NAMED]
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("m.p"), F.col("p_partkey").cast("string")).alias("entity"), F.explode(F.array("p_type", "p_brand")).alias("type"))
    return reduce(DataFrame.unionByName, [*plain, part])


# -- relations -------------------------------------------------------------------------------------------------------------


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group; order has to be total."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)


def relations(kg: DataFrame, direction: str, limit: int = LIMIT) -> DataFrame:
    """entity, relation: the distinct predicates of each entity as subject ('out') or object ('in')."""
    side = "s" if direction == "out" else "o"
    found = kg.select(F.col(side).alias("entity"), F.col("p").alias("relation")).distinct()
    return ranked(found, ["entity"], [F.col("relation")], limit).drop("rank")


def all_relations(kg: DataFrame, limit: int = LIMIT) -> DataFrame:
    return relations(kg, "out", limit).union(relations(kg, "in", limit)).distinct()


def keep_listed(rows: DataFrame, by: list[str], listed: list[str], relation: str = "relation") -> DataFrame:
    """Listed relations of each group; a group that has none keeps all of its own."""
    flag = F.col(relation).isin(listed)
    some = F.max(flag.cast("int")).over(W.partitionBy(*by))
    return rows.withColumn("__flag", flag).withColumn("__some", some).filter(F.col("__flag") | (F.col("__some") == 0)).drop("__flag", "__some")


def is_meta(relation: Column, strict: bool = False) -> Column:
    """Whether a relation describes the store itself: equal to a pattern, or below it. strict: the patterns that a literal reading fuses drop nothing."""
    patterns = [m for m in META if not (strict and m in FUSED)]
    return reduce(lambda a, b: a | b, [(relation == m) | relation.startswith(m + ".") for m in patterns])


def get_relations(kg: DataFrame, listed: list[str], top_k: int = 10) -> DataFrame:
    """entity, relation, rank: both directions, whitelist with fallback, without relations about the store, the first top_k by name."""
    found = keep_listed(all_relations(kg), ["entity"], listed)
    return ranked(found.filter(~is_meta(F.col("relation"))), ["entity"], [F.col("relation")], top_k)


def asked_relations(kg: DataFrame, asked: DataFrame, listed: list[str], pending: DataFrame | None = None, limit: int = LIMIT, top_k: int = 10) -> DataFrame:
    """query, entity, relation, rank for each of asked(query, entity, question): what get_relations shows.

    The relations of an entity in both directions, then the flattened relations that
    pending(query, entity, name) has for it; whitelist with fallback, by which
    flattened names, never listed, go where any listed relation stays; without
    relations about the store; ranked by the question, or by name where there is
    none; the first top_k. A null entity, one that could not be resolved, has none.
    """
    rows = asked.filter("entity is not null").select("query", "entity", "question")
    of = kg.join(rows.select(F.col("entity").alias("e")).distinct(), F.col("s") == F.col("e"), "left_semi"), kg.join(rows.select(F.col("entity").alias("e")).distinct(), F.col("o") == F.col("e"), "left_semi")
    found = relations(of[0], "out", limit).union(relations(of[1], "in", limit)).distinct()
    shown = rows.join(found, "entity").select("query", "entity", "relation")
    if pending is not None:
        shown = shown.union(rows.join(pending, ["query", "entity"]).select("query", "entity", F.col("name").alias("relation"))).distinct()
    shown = keep_listed(shown, ["query"], listed).filter(~is_meta(F.col("relation")))
    scored = bm25_okapi(shown.select("query", F.col("relation").alias("item"), F.col("relation").alias("text")), rows.select("query", F.col("question").alias("text")))
    return shown.join(scored.select("query", F.col("item").alias("relation"), "rank"), ["query", "relation"]).filter(F.col("rank") <= top_k).select("query", "entity", "relation", "rank")


# -- entities --------------------------------------------------------------------------------------------------------------


def preferred_labels(labels: DataFrame) -> DataFrame:
    """entity, name: an English name if there is one, else any; the least of equals."""
    return labels.groupBy("entity").agg(F.min_by("name", F.struct((F.col("lang") != "en").alias("x"), F.col("name").alias("y"))).alias("name"))


def is_mediator(node: Column, name: Column) -> Column:
    """An id without a name of its own: none, an empty one, or the id again (in any spelling)."""
    mid = node.startswith("m.") | node.startswith("g.")
    return mid & (name.isNull() | (name == "") | (name == node) | (F.translate(name, "/:", "..") == node))


def fetch_triples(kg: DataFrame, labels: DataFrame, direction: str, per_relation: int = PER_RELATION) -> DataFrame:
    """entity, relation, other, other_name for every entity and relation; at most 2 (out) or 4 (in) times per_relation others, by id."""
    mine, other, factor = ("s", "o", 2) if direction == "out" else ("o", "s", 4)
    rows = kg.select(F.col(mine).alias("entity"), F.col("p").alias("relation"), F.col(other).alias("other")).distinct()
    rows = ranked(rows, ["entity", "relation"], [F.col("other")], factor * per_relation).drop("rank")
    return rows.join(preferred_labels(labels).select(F.col("entity").alias("other"), F.col("name").alias("other_name")), "other", "left").select("entity", "relation", "other", "other_name")


def get_triples(kg: DataFrame, labels: DataFrame, per_relation: int = PER_RELATION) -> DataFrame:
    """head, head_name, relation, tail, tail_name: named neighbours of every entity and relation.

    Mediators are set apart; of the others 5 stay, or 15 if the relation also led to
    a mediator. Heads that equal their tails are dropped.
    """
    both = fetch_triples(kg, labels, "out", per_relation).withColumn("out", F.lit(True)).unionByName(fetch_triples(kg, labels, "in", per_relation).withColumn("out", F.lit(False)))
    both = both.withColumn("mediator", is_mediator(F.col("other"), F.col("other_name")))
    hit = F.max(F.col("mediator").cast("int")).over(W.partitionBy("entity", "relation"))
    plain = both.withColumn("hit", hit).filter(~F.col("mediator") & (F.col("entity") != F.col("other")))
    rank = F.row_number().over(W.partitionBy("entity", "relation").orderBy("out", "other"))
    kept = plain.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("hit") == 1, PLAIN_WITH_MEDIATOR).otherwise(PLAIN))
    own = preferred_labels(labels).select("entity", F.col("name").alias("entity_name"))
    kept = kept.join(own, "entity", "left").withColumns({"a": F.coalesce("entity_name", "entity"), "b": F.coalesce("other_name", "other")})
    pick = lambda x, y: F.when(F.col("out"), F.col(x)).otherwise(F.col(y))
    return kept.select(pick("entity", "other").alias("head"), pick("a", "b").alias("head_name"), "relation", pick("other", "entity").alias("tail"), pick("b", "a").alias("tail_name"), F.col("entity").alias("asked"))


# -- mediators -------------------------------------------------------------------------------------------------------------


def flat_name(first: Column, second: Column) -> Column:
    """first without the dotted prefix that it shares with second, then second."""
    a, b = F.split(first, "\\."), F.split(second, "\\.")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.array_position(same, False) - 1, F.size(same).cast("long"))
    shared = F.when(F.array_position(same, False) == 0, F.size(same).cast("long")).otherwise(shared)
    rest = F.array_join(F.slice(a, (shared + 1).cast("int"), F.size(a)), ".")
    return F.concat(rest, F.lit("."), second)


def mediator_relations(kg: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """mediator, direction, second: the relations that leave ('out') or reach ('in') a node, at most 50 each, without those about the store, whitelist with fallback.

    One shuffle by the node serves the distinct, the windows and a join on it.
    """
    both = kg.select(F.col("s").alias("mediator"), F.col("p").alias("second"), F.lit("out").alias("direction")).union(kg.select("o", "p", F.lit("in")))
    other = ranked(both.repartition("mediator").distinct(), ["mediator", "direction"], [F.col("second")], 50).drop("rank").filter(~is_meta(F.col("second")))
    return keep_listed(other, ["mediator", "direction"], listed, "second") if listed else other


def flat_base(direction: Column, first: Column, second: Column) -> Column:
    return F.when(direction == "out", flat_name(first, second)).otherwise(flat_name(second, first))


def flatten_candidates(kg: DataFrame, labels: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """entity, name (with a suffix that counts equal names of the entity from 1), first, mediator, second, direction. kg has each triple once.

    A mediator that an entity leads to ('out') is expanded by its outgoing relations,
    named after the entity's; one that leads to the entity ('in') by its incoming
    relations, named before.
    """
    named = preferred_labels(labels).select(F.col("entity").alias("mediator"), "name")
    reach = kg.select(F.col("s").alias("entity"), F.col("p").alias("first"), F.col("o").alias("mediator"), F.lit("out").alias("direction")).union(kg.select("o", "p", "s", F.lit("in")))
    reach = reach.join(named, "mediator", "left").filter(is_mediator(F.col("mediator"), F.col("name"))).drop("name")
    rows = reach.join(mediator_relations(kg, listed), ["mediator", "direction"]).withColumn("base", flat_base(F.col("direction"), F.col("first"), F.col("second")))
    number = F.row_number().over(W.partitionBy("entity", "base").orderBy("first", "mediator", F.col("direction").desc(), "second"))
    return rows.select("entity", F.concat("base", F.lit("_"), number.cast("string")).alias("name"), "first", "mediator", "second", "direction")


def through_mediator(kg: DataFrame, labels: DataFrame, candidates: DataFrame, per_relation: int = PER_RELATION) -> DataFrame:
    """entity, name, other, other_name: what a flattened relation leads to, at most per_relation others (by id) and not the entity itself. kg has each triple once."""
    out = candidates.filter("direction = 'out'").join(kg, (F.col("mediator") == kg["s"]) & (F.col("second") == kg["p"])).select("entity", "name", F.col("o").alias("other"))
    into = candidates.filter("direction = 'in'").join(kg, (F.col("mediator") == kg["o"]) & (F.col("second") == kg["p"])).select("entity", "name", F.col("s").alias("other"))
    rows = ranked(out.unionByName(into).filter(F.col("entity") != F.col("other")), ["entity", "name"], [F.col("other")], per_relation).drop("rank")
    return rows.join(preferred_labels(labels).select(F.col("entity").alias("other"), F.col("name").alias("other_name")), "other", "left").select("entity", "name", "other", F.coalesce("other_name", "other").alias("other_name"))


def neighbours(kg: DataFrame, labels: DataFrame, pairs: DataFrame, per_relation: int = PER_RELATION) -> DataFrame:
    """entity, relation, other, other_name, out, mediator of pairs(entity, relation): at most 2 (out) or 4 (in) times per_relation others, by id."""
    pairs = pairs.select("entity", "relation").distinct()
    sides = []
    for mine, other, factor, out in (("s", "o", 2, True), ("o", "s", 4, False)):
        rows = kg.join(pairs, (F.col(mine) == F.col("entity")) & (F.col("p") == F.col("relation"))).select("entity", "relation", F.col(other).alias("other"), F.lit(out).alias("out"))
        sides.append(ranked(rows, ["entity", "relation"], [F.col("other")], factor * per_relation).drop("rank"))
    named = preferred_labels(labels).select(F.col("entity").alias("other"), F.col("name").alias("other_name"))
    return sides[0].unionByName(sides[1]).join(named, "other", "left").withColumn("mediator", is_mediator(F.col("other"), F.col("other_name")))


def asked_candidates(kg: DataFrame, labels: DataFrame, near: DataFrame, asked: DataFrame, listed: list[str] | None = None, most: int = CANDIDATES) -> DataFrame:
    """query, entity, name, first, mediator, second, direction, place: the flattened relations of asked(query, entity, pos, relation, question), the `most` nearest to the question.

    near: what neighbours() has found. Names are counted over all relations of a
    query. The question is joined by the entity's name; without one the first stay.
    """
    hit = near.filter("mediator").select("entity", "relation", F.col("other").alias("mediator"), F.when(F.col("out"), "out").otherwise("in").alias("direction"))
    rows = asked.join(hit, ["entity", "relation"]).join(mediator_relations(kg, listed), ["mediator", "direction"]).withColumn("base", flat_base(F.col("direction"), F.col("relation"), F.col("second")))
    counted = F.row_number().over(W.partitionBy("query", "base").orderBy("pos", F.col("direction").desc(), "mediator", "second"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("direction").desc(), "pos", "mediator", "second"))
    rows = rows.select("query", "entity", F.concat("base", F.lit("_"), counted.cast("string")).alias("name"), F.col("relation").alias("first"), "mediator", "second", "direction", place.alias("place")).persist(StorageLevel.MEMORY_AND_DISK)
    own = preferred_labels(labels).select("entity", F.col("name").alias("entity_name"))
    words = asked.select("query", "entity", "question").distinct().join(own, "entity", "left")
    scored = bm25_okapi(rows.select("query", F.col("name").alias("item"), F.col("name").alias("text")), words.select("query", F.when(F.col("question") != "", F.concat_ws(" ", "question", "entity_name")).alias("text")))
    told = words.select("query", (F.coalesce("question", F.lit("")) != "").alias("told"))
    kept = rows.join(scored.select("query", F.col("item").alias("name"), "rank"), ["query", "name"]).join(told, "query")
    return kept.filter(F.when(F.col("told"), F.col("rank")).otherwise(F.col("place")) <= most).drop("rank", "told")


def asked_triples(kg: DataFrame, labels: DataFrame, asked: DataFrame, mapping: DataFrame | None = None, listed: list[str] | None = None, per_relation: int = PER_RELATION, candidates: int = CANDIDATES, kept: int = KEPT_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """What get_triples returns for each of asked(query, entity, relations, question), and its pending flattened relations.

    Triples: query, relation, head, head_name, tail, tail_name. Of the neighbours that
    are no mediators 5 stay, or 15 if the relation led to a mediator; of the flattened
    relations near to the question those that lead to another entity, the first 8, and
    what they lead to. Relations that mapping(query, entity, name, first, mediator,
    second, direction) knows are flattened ones of before, and followed as they are.
    Pending: the rows of mapping for the 8; write them before they are a mapping
    themselves, or all is computed again. kg has each triple once.
    """
    each = asked.select("query", "entity", "question", F.posexplode(F.array_distinct("relations")).alias("pos", "relation"))
    follow = None
    if mapping is not None:
        follow = each.join(mapping.withColumnRenamed("name", "relation"), ["query", "entity", "relation"]).select("query", "entity", F.col("relation").alias("name"), "first", "mediator", "second", "direction")
        each = each.join(mapping.select("query", "entity", F.col("name").alias("relation")), ["query", "entity", "relation"], "left_anti")
    each = each.withColumn("relation", normalize_relation(F.col("relation")))
    # both are used several times: kept while there is room, so that plans stay small
    near = neighbours(kg, labels, each, per_relation).persist(StorageLevel.MEMORY_AND_DISK)
    hit = F.max(F.col("mediator").cast("int")).over(W.partitionBy("entity", "relation"))
    order = F.row_number().over(W.partitionBy("entity", "relation").orderBy("mediator", F.col("out").desc(), "other"))
    plain = near.withColumn("hit", hit).withColumn("k", order).filter(~F.col("mediator") & (F.col("k") <= F.when(F.col("hit") == 1, PLAIN_WITH_MEDIATOR).otherwise(PLAIN)))
    plain = each.select("query", "entity", "relation").join(plain, ["entity", "relation"]).select("query", "entity", "relation", "other", "other_name", "out")
    found = asked_candidates(kg, labels, near, each, listed, candidates).persist(StorageLevel.MEMORY_AND_DISK)

    def reached(rows: DataFrame) -> DataFrame:
        """Candidates of several queries lead to the same: each is followed once."""
        step = rows.select("entity", "first", "mediator", "second", "direction").distinct().withColumn("name", F.concat_ws("|", "first", "mediator", "second", "direction"))
        led = through_mediator(kg, labels, step, per_relation).join(step, ["entity", "name"]).drop("name")
        return rows.join(led, ["entity", "first", "mediator", "second", "direction"])

    led = reached(found).persist(StorageLevel.MEMORY_AND_DISK)
    chosen = ranked(led.select("query", "entity", "name", "first", "mediator", "second", "direction", "place").distinct(), ["query"], [F.col("place")], kept)
    pending = chosen.select("query", "entity", "name", "first", "mediator", "second", "direction", F.col("rank").alias("place"))
    flat = led.join(pending.select("query", "name"), ["query", "name"])
    parts = [flat] if follow is None else [flat, reached(follow)]
    for part in parts:
        plain = plain.unionByName(part.select("query", "entity", F.col("name").alias("relation"), "other", "other_name", (F.col("direction") == "out").alias("out")))
    own = preferred_labels(labels).select("entity", F.col("name").alias("entity_name"))
    rows = plain.join(own, "entity", "left").withColumns({"a": F.coalesce("entity_name", "entity"), "b": F.coalesce("other_name", "other")})
    pick = lambda x, y: F.when(F.col("out"), F.col(x)).otherwise(F.col(y))
    return rows.select("query", "relation", pick("entity", "other").alias("head"), pick("a", "b").alias("head_name"), pick("other", "entity").alias("tail"), pick("b", "a").alias("tail_name")), pending


def add_pending(state: DataFrame, pending: DataFrame) -> DataFrame:
    """The state of a question (rows of pending) with further flattened relations; those that it has stay as they are. An empty table is the state of a new question."""
    return state.unionByName(pending.join(state.select("query", "entity", "name"), ["query", "entity", "name"], "left_anti").select(*state.columns))


def pending_relations(state: DataFrame, entity: str | None = None) -> DataFrame:
    """query, entity, name, of one entity or of all."""
    rows = state.select("query", "entity", "name")
    return rows if entity is None else rows.filter(F.col("entity") == entity)


def apply_filtered(state: DataFrame, filtered: DataFrame, most: int = KEPT_CANDIDATES) -> DataFrame:
    """The state after an outer filter: for the entities in filtered (rows of state, place in their new order) its first rows instead of their own; others as they are."""
    first = ranked(filtered, ["query", "entity"], [F.col("place"), F.col("name")], most).drop("rank")
    return state.join(filtered.select("query", "entity").distinct(), ["query", "entity"], "left_anti").select(*state.columns).unionByName(first.select(*state.columns))


# -- resolution ------------------------------------------------------------------------------------------------------------


def passes_as_id(entity: Column) -> Column:
    """The id itself if it is one; null for an empty text or one of more than 100 characters; else the text to look up."""
    return F.when(entity.isNull() | (entity == "") | (F.length(entity) > 100) & ~is_id(entity), F.lit(None)).otherwise(entity)


def is_id(entity: Column) -> Column:
    return entity.startswith("m.") | entity.startswith("g.") | entity.startswith("en.")


def resolve(texts: DataFrame, labels: DataFrame, kinds: DataFrame, any_case: bool = False) -> DataFrame:
    """text, entity, n_types: of the entities of that name the one with most types, the least id of equals.

    any_case: names equal but for case, in any language; an entity counts its types
    once for each matching name.
    """
    fold = F.lower if any_case else (lambda c: c)
    pool = labels if any_case else labels.filter("lang = 'en'")
    match = texts.withColumn("__k", fold(F.col("text"))).join(pool.withColumn("__k", fold(F.col("name"))), "__k")
    counted = match.select("text", "entity", "name").distinct().join(kinds.distinct(), "entity").groupBy("text", "entity").agg(F.count("*").alias("n_types"))
    return ranked(counted, ["text"], [F.col("n_types").desc(), F.col("entity")], 1).drop("rank")


def normalize_relation(relation: Column) -> Column:
    """Dotted form of an IRI, a prefixed or slashed name; runs of white space become one underscore."""
    out = F.trim(relation)
    out = F.regexp_replace(out, r"^<?http://rdf\.freebase\.com/ns/", "")
    out = F.regexp_replace(F.regexp_replace(out, ">$", ""), "^ns:", "")
    out = F.regexp_replace(F.translate(out, "/", "."), r"^\.", "")
    return F.regexp_replace(out, r"\s+", "_")


# -- verbs -----------------------------------------------------------------------------------------------------------------

#: The two verbs of a query text (fixed values).
GET_RELATIONS = r"""(?s)^\s*get_relations\s*\(\s*(["'])(.*?)\1\s*\)"""
GET_TRIPLES = r"""(?s)^\s*get_triples\s*\(\s*(["'])(.*?)\1\s*,\s*\[(.*?)\]\s*\)"""


def parse_verb(query: Column, most: int = 4) -> Column:
    """struct(verb, entity, relations): quoted relations of a comma-parted list, each once, the first four."""
    asks, fetches = query.rlike(GET_RELATIONS), query.rlike(GET_TRIPLES)
    items = F.transform(F.split(F.regexp_extract(query, GET_TRIPLES, 3), ","), lambda x: F.trim(x))
    quoted = F.filter(items, lambda x: (F.length(x) > 1) & x.rlike("""(?s)^(".*"|'.*')$"""))
    inner = F.array_distinct(F.transform(quoted, lambda x: x.substr(F.lit(2), F.length(x) - 2)))
    return F.struct(
        F.when(asks, "get_relations").when(fetches, "get_triples").alias("verb"),
        F.when(asks, F.trim(F.regexp_extract(query, GET_RELATIONS, 2))).when(fetches, F.trim(F.regexp_extract(query, GET_TRIPLES, 2))).alias("entity"),
        F.when(fetches, F.slice(inner, 1, most)).alias("relations"),
    )


def admissible(asked: DataFrame, seen: DataFrame) -> DataFrame:
    """asked(question, relation) with ok: the relation was shown for the question; all are while nothing was shown."""
    shown = seen.select("question", F.col("relation").alias("__r")).distinct().withColumn("__hit", F.lit(True))
    any_shown = seen.select("question").distinct().withColumn("__any", F.lit(True))
    rows = asked.withColumn("__n", normalize_relation(F.col("relation")))
    rows = rows.join(shown, (rows["question"] == shown["question"]) & (rows["__n"] == shown["__r"]), "left").drop(shown["question"]).join(any_shown, "question", "left")
    return rows.select("question", "relation", (F.col("__any").isNull() | F.col("__hit").isNotNull()).alias("ok"))


def pick_from_reply(reply: Column, candidates: Column, most: int = 10) -> Column:
    """Candidates that a reply's first JSON list names, in its order; without such a list, or without a hit, the first ones."""
    named = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*?\])", 1), "array<string>")
    hits = F.filter(F.array_distinct(named), lambda x: F.array_contains(candidates, x))
    return F.slice(F.when(F.size(F.coalesce(hits, F.array())) > 0, hits).otherwise(candidates), 1, most)


def choose_relations(ranked_rows: DataFrame, ask=None, shown: int = 10, candidates: int = 30) -> DataFrame:
    """query, relation, rank: what is shown of ranked(query, relation, rank) for each query.

    The first `candidates` are on offer. Where they are more than `shown` and ask is
    given, ask(query, candidates) returns query, reply, and the reply's first JSON list
    names those that stay, in its order. Queries without a reply, or one that names
    none, keep the first.
    """
    lists = ranked_rows.filter(F.col("rank") <= candidates).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "relation"))), lambda x: x["relation"]).alias("candidates"))
    replies = lists.withColumn("reply", F.lit(None).cast("string")) if ask is None else lists.join(ask(lists.filter(F.size("candidates") > shown)).select("query", "reply"), "query", "left")
    picked = replies.select("query", F.posexplode(pick_from_reply(F.coalesce("reply", F.lit("")), F.col("candidates"), shown)).alias("at", "relation"))
    return picked.select("query", "relation", (F.col("at") + 1).alias("rank"))


def seed_registry(topics: DataFrame) -> DataFrame:
    """question, name, entity of topics(question, a, b), whichever of a and b is the id."""
    id_first = is_id(F.col("a"))
    rows = topics.filter(id_first | is_id(F.col("b"))).select("question", F.when(id_first, F.col("b")).otherwise(F.col("a")).alias("name"), F.when(id_first, F.col("a")).otherwise(F.col("b")).alias("entity"))
    return rows.groupBy("question", "name").agg(F.min("entity").alias("entity"))


def register(registry: DataFrame, triples_shown: DataFrame) -> DataFrame:
    """The registry with the heads and tails of triples(question, head, head_name, tail, tail_name); names that it has stay as they are."""
    ends = triples_shown.select("question", F.explode(F.array(F.struct(F.col("head_name").alias("name"), F.col("head").alias("entity")), F.struct(F.col("tail_name").alias("name"), F.col("tail").alias("entity")))).alias("e")).select("question", "e.name", "e.entity")
    new = ends.filter(is_id(F.col("entity")) & (F.col("name") != F.col("entity"))).groupBy("question", "name").agg(F.min("entity").alias("entity"))
    return registry.unionByName(new.join(registry.select("question", "name"), ["question", "name"], "left_anti").select(*registry.columns))


def resolve_registered(asked: DataFrame, registry: DataFrame, stored: DataFrame) -> DataFrame:
    """asked(question, text) with entity: an id as it is, else the registry's, else that of stored(text, entity)."""
    known = registry.select("question", F.col("name").alias("text"), F.col("entity").alias("__own"))
    rows = asked.join(known, ["question", "text"], "left").join(stored.select("text", F.col("entity").alias("__stored")), "text", "left")
    return rows.select("question", "text", F.when(is_id(F.col("text")), F.col("text")).otherwise(F.coalesce("__own", "__stored")).alias("entity"))


def augment_question(question: Column, topics: Column) -> Column:
    """The question and its topics' names, each once."""
    return F.concat_ws(" ", question, F.array_join(F.array_distinct(F.filter(topics, lambda x: x.isNotNull() & (x != ""))), " "))


def format_relations(rows: DataFrame, by: str = "entity") -> DataFrame:
    """by, prompt: relations one on a line, or a sentence that there are none."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "relation"))), lambda x: x["relation"]), "\n")
    return rows.groupBy(by).agg(lines.alias("prompt")).withColumn("prompt", F.when(F.col("prompt") == "", "No relations found.").otherwise(F.col("prompt")))
