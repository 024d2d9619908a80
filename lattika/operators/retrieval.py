"""Ranking by words and by vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Signs that part words besides white space (fixed values).
SIGNS = ".,!?;:()[]{}\"'/\\"
#: The usual constants of BM25 (fixed values).
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words of queries (each once for a query) that a word search may broadcast.
ASKED_WORDS = 1_000_000
#: Rows of queries that a vector search may broadcast; more go in blocks.
QUERY_BLOCK = 10_000


def tokens(text: Column) -> Column:
    """Lower-case words; underscores and hyphens stay inside."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SIGNS, " " * len(SIGNS))
    return F.filter(F.split(F.lower(spaced), r"(?U)\s+"), lambda x: x != "")


def bm25_okapi(items: DataFrame, questions: DataFrame) -> DataFrame:
    """query, item, score, rank: items(query, item, text) ranked by questions(query, text), every query within its own items.

    Inverse document frequency ln(N - n + 0.5) - ln(n + 0.5), below zero replaced by
    a quarter of the mean over the words of the query's items; question words count
    as often as they stand. Items without a common word score 0; ties by item.
    """
    docs = items.select("query", "item", tokens(F.col("text")).alias("w"))
    size = docs.groupBy("query").agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("mean"))
    counts = docs.select("query", "item", F.size("w").alias("len"), F.explode("w").alias("word")).groupBy("query", "item", "len", "word").agg(F.count("*").alias("tf"))
    df = counts.groupBy("query", "word").agg(F.count("*").alias("df")).join(size, "query")
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = df.withColumn("raw", raw).withColumn("floor", EPSILON * F.avg("raw").over(W.partitionBy("query")))
    df = df.withColumn("idf", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")))
    asked = questions.select("query", F.explode(tokens(F.col("text"))).alias("word")).groupBy("query", "word").agg(F.count("*").alias("qf"))
    part = counts.join(asked, ["query", "word"]).join(df.select("query", "word", "idf", "mean"), ["query", "word"])
    gain = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = part.groupBy("query", "item").agg(F.sum(gain).alias("score"))
    rows = docs.select("query", "item").join(scored, ["query", "item"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "item")))


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """query, doc, score, rank: the k best documents of one corpus(doc, text) for each of queries(query, text).

    Inverse document frequency ln(1 + (N - n + 0.5) / (n + 0.5)), always positive.
    Documents without a common word are not returned. Up to ASKED_WORDS words of
    queries are broadcast: documents are shuffled once, by their asked words, and
    each partition keeps its best k. More are joined on words.
    """
    docs = corpus.select("doc", tokens(F.col("text")).alias("w"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("mean"))
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("word")).groupBy("query", "word").agg(F.count("*").alias("qf"))
    small = asked.limit(ASKED_WORDS + 1).count() <= ASKED_WORDS
    sent = F.broadcast if small else lambda df: df
    # only words that are asked for enter the index; all of a document in one task, where its scores are added up
    words = docs.select("doc", F.size("w").alias("len"), F.explode("w").alias("word")).join(sent(asked.select("word").distinct()), "word", "left_semi")
    index = (words.repartition("doc") if small else words).groupBy("word", "doc", "len").agg(F.count("*").alias("tf"))
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(sent(df), "word").crossJoin(F.broadcast(stats)).select("query", "word", "mean", (F.col("qf") * idf).alias("weight"))  # one row
    gain = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = index.join(sent(weighed), "word").groupBy("query", "doc").agg(F.round(F.sum(gain), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "doc"))).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, item, score, rank: the k largest inner products of corpus(item, vector) for each of queries(query, vector).

    The queries are a stated set; they are broadcast a block at a time, and every
    partition keeps its own best k before anything is shuffled.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        scored = corpus.crossJoin(F.broadcast(part.select("query", F.col("vector").alias("q")))).select("query", "item", F.round(dot(F.col("vector"), F.col("q")), 6).alias("score"))
        best = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "item"))).filter(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def batch_retrieve(ranked: DataFrame, corpus: DataFrame, with_scores: bool = True) -> DataFrame:
    """query, rank, document and score (if asked for): ranked(query, doc, score, rank) with the whole rows of corpus(doc, ...)."""
    document = F.struct(*[F.col(c) for c in corpus.columns]).alias("document")
    rows = ranked.join(corpus.select(F.col("doc").alias("__doc"), document), F.col("doc") == F.col("__doc"))
    return rows.select("query", "rank", "document", *(["score"] if with_scores else []))


def pooled(tokens: DataFrame, by: str, method: str = "mean", order: str | None = None, mask: str | None = None, vector: str = "vector") -> DataFrame:
    """by, i, x: one vector for each value of `by` from rows with a vector each, by component: the mean of the unmasked ones, or that of the first row ('cls').

    Sums are combined before the shuffle, so that no vectors are gathered in one
    place. A pooled vector that a model returns itself needs no operator.
    """
    if method == "mean":
        rows = tokens.filter(F.col(mask) != 0) if mask else tokens
        return rows.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("x"))
    if method != "cls":
        raise ValueError(f"unknown pooling: {method}")
    first = tokens.groupBy(by).agg(F.min_by(vector, order).alias("v"))
    return first.select(by, F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


#: What stands before a query or a passage, by a part of the model's name (fixed values).
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}


def encoder_text(text: Column, model: str, is_query: bool = True) -> Column:
    """A text as a model's encoder wants it."""
    for part, prefixes in PREFIXES.items():
        if part in model.lower():
            text = F.concat(F.lit(prefixes[0 if is_query else 1]), text)
    return text


# -- prefix cache ----------------------------------------------------------------------------------------------------------

#: Entries beyond which stale ones go, and the versions after which an entry is stale (fixed values).
CACHE_SIZE, CACHE_VERSIONS = 10_000, 5


def cache_insert(cache: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """cache(key, value, version) with the rows of new(key, value): a key has its latest value. An empty key is none."""
    both = cache.unionByName(new.filter("key <> ''").groupBy("key").agg(F.min("value").alias("value")).withColumn("version", F.lit(version).cast(cache.schema["version"].dataType)))
    return both.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def cache_evict(cache: DataFrame, version: int, size: int = CACHE_SIZE, versions: int = CACHE_VERSIONS) -> DataFrame:
    """The cache without entries of `versions` ago or older, nor entries that continue one of those, once it has more than `size` entries."""
    if cache.count() <= size:
        return cache
    stale = F.col("version") <= version - versions
    gone = longest_prefix(cache.select(F.col("key").alias("text_id"), F.col("key").alias("text")), cache.filter(stale).select("key"))
    return cache.join(gone.filter(F.col("key").isNull()).select(F.col("text_id").alias("key")), "key", "left_semi")


def cache_statistics(cache: DataFrame) -> DataFrame:
    """entries, characters, oldest and newest version."""
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("characters"), F.min("version").alias("oldest"), F.max("version").alias("newest"))


def answer_from_cache(texts: DataFrame, cache: DataFrame, make, version: int, tries: int = 5) -> tuple[DataFrame, DataFrame]:
    """texts(text_id, text) with the value of the whole text in the cache, else what make(texts) answers, asked again while it is null; and the cache with new answers.

    make takes rows (text_id, text) and returns text_id, value; null is an aborted
    answer, of which `tries` are made.
    """
    known = texts.join(cache.select(F.col("key").alias("text"), "value"), "text", "left")
    out, todo = known.filter("value is not null").select("text_id", "text", "value"), known.filter("value is null").select("text_id", "text")
    for k in range(tries):
        made = todo.join(make(todo), "text_id", "left").select("text_id", "text", "value")
        done = made if k == tries - 1 else made.filter("value is not null")
        out, todo = out.unionByName(done), made.filter("value is null").select("text_id", "text")
    return out, cache_insert(cache, out.filter("value is not null").select(F.col("text").alias("key"), "value"), version)


def longest_prefix(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """text_id, key, length: the longest key(key) that a text(text_id, text) starts with; null without one.

    Keys are matched by equality at each of their lengths, so the join is by hash
    and not by comparing all pairs.
    """
    lengths = [r[0] for r in keys.select(F.length("key").alias("n")).filter("n > 0").distinct().orderBy("n").collect()]  # distinct lengths only
    heads = texts.select("text_id", "text", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")).alias("n")).filter(F.length("text") >= F.col("n"))
    match = heads.select("text_id", "n", F.expr("left(text, n)").alias("key")).join(keys.select("key").distinct(), "key")
    best = match.groupBy("text_id").agg(F.max_by("key", "n").alias("key"), F.max("n").alias("length"))
    return texts.select("text_id").join(best, "text_id", "left")


def passages_to_string(hits: DataFrame) -> DataFrame:
    """query, context: hits(query, rank, contents) as numbered passages; the first line of contents is the title, without quotes."""
    title = F.regexp_replace(F.element_at(F.split("contents", "\n"), 1), '"', "")
    body = F.array_join(F.slice(F.split("contents", "\n"), 2, 1 << 30), "\n")
    line = F.format_string("Doc %d(Title: %s) %s\n", F.col("rank"), title, body)
    return hits.withColumn("line", line).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "").alias("context"))
