"""Cleaning of graph dumps, predicate counts from query texts, and path filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NS = "http://rdf.freebase.com/ns/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema"

# -- dumps -----------------------------------------------------------------------------------------------------------------


def keep_line(line: Column) -> Column:
    """Whether a line of a dump stays: blank lines, @ lines, and four-field statements about named nodes.

    The object has to be a plain or English literal that does not begin with a
    slash, a node of the name space, or a typed literal.
    """
    text = F.regexp_replace(line, r"\s+$", "")
    parts = F.split(text, "\t")
    sound = text.endswith(".") & (F.size(parts) == 4) & F.forall(F.slice(parts, 1, 3), lambda x: F.trim(x) != "")
    subject = rf"^<{NS}[mg]\.[^>]+>\t<{NS}[^>]+>\t"
    literal = text.rlike(subject + r"""['"](?!/).+['"](?:@en)?\t\.$""")
    node = text.rlike(subject + rf"<{NS}[^>]+>\t.$")
    typed = text.rlike(subject + rf".+<{XSD}#\w+>\t.$")
    return (text == "") | text.startswith("@") | (sound & (literal | node | typed))


def filter_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.filter(keep_line(F.col(column))).select(F.regexp_replace(column, r"\s+$", "").alias(column))


def parse_statements(lines: DataFrame, column: str = "value") -> DataFrame:
    """s, p, o, o_kind ('iri' or 'lit'), lang of the statements among kept lines."""
    parts = F.split(F.col(column), "\t")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, rf"^<(?:{NS})?", ""), ">$", "")
    rows = lines.filter(keep_line(F.col(column)) & (F.size(parts) == 4)).select(bare(parts[0]).alias("s"), bare(parts[1]).alias("p"), parts[2].alias("raw"))
    iri = F.col("raw").startswith("<")
    return rows.select("s", "p", F.when(iri, bare(F.col("raw"))).otherwise(F.regexp_extract("raw", r"""^['"](.*)['"]""", 1)).alias("o"), F.when(iri, "iri").otherwise("lit").alias("o_kind"), F.nullif(F.regexp_extract("raw", r"@(\w+)$", 1), F.lit("")).alias("lang"))


# -- predicates of query texts ---------------------------------------------------------------------------------------------

#: Names, nodes and objects of a statement, and the two patterns that find predicates (fixed values).
_NAME = r"(?:<[^>]+>|[A-Za-z][\w-]*:[A-Za-z0-9_.-]+|:[A-Za-z0-9_.-]+)"
_NODE = r"(?:<[^>]+>|\?[A-Za-z_]\w*|[A-Za-z][\w-]*:[A-Za-z0-9_.-]+|:[A-Za-z0-9_.-]+)"
_OBJECT = r'(?:<[^>]+>|\?[A-Za-z_]\w*|".*?"(?:\^\^<[^>]+>|@[-\w]+)?|[A-Za-z][\w-]*:[A-Za-z0-9_.-]+|:[A-Za-z0-9_.-]+)'
STATEMENT = rf"(?is)(?:^|[\{{\s.;]){_NODE}\s+({_NAME}|a)\s+{_OBJECT}"
PATH = rf"(?is)(?:^|[\{{\s.;]){_NODE}\s+({_NAME}(?:[/|]{_NAME})*[+*?]?)\s+{_OBJECT}"


def clean_query(text: Column) -> Column:
    """A query text without comments and declarations; a bare `a` becomes rdf:type."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)#.*?$", "")
    out = F.regexp_replace(out, r"(?is)\bPREFIX\s+[A-Za-z][\w-]*:\s*<[^>]+>\s*", " ")
    out = F.regexp_replace(out, r"(?is)\bBASE\s*<[^>]+>\s*", " ")
    return F.regexp_replace(out, r"(?<![\w:])a(?![\w:])", " rdf:type ")


def predicate_tokens(text: Column) -> Column:
    """Predicates of statements, then those of property paths; plain statements match both, so their predicates stand twice."""
    clean = clean_query(text)
    plain = F.transform(F.regexp_extract_all(clean, F.lit(STATEMENT), F.lit(1)), lambda x: F.when(F.trim(x) == "a", F.lit("rdf:type")).otherwise(F.trim(x)))
    paths = F.flatten(F.transform(F.regexp_extract_all(clean, F.lit(PATH), F.lit(1)), lambda x: F.split(F.regexp_replace(F.trim(x), "[+*?]$", ""), "[/|]")))
    paths = F.filter(F.transform(paths, lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(plain, F.transform(paths, lambda x: F.when(x == "a", F.lit("rdf:type")).otherwise(x)))


def full_iri(token: Column) -> Column:
    """The IRI of <...>, ns:..., rdf:... and :...; null for other prefixes."""
    prefix, local = F.substring_index(token, ":", 1), F.regexp_replace(token, "^[^:]*:", "")
    return F.when(token.startswith("<") & token.endswith(">"), F.regexp_extract(token, "(?s)^<(.*)>$", 1)).when(token.contains(":") & prefix.isin("ns", ""), F.concat(F.lit(NS), local)).when(prefix == "rdf", F.concat(F.lit(RDF), local))


def prefixed(iri: Column) -> Column:
    return F.when(iri.startswith(NS), F.concat(F.lit("ns:"), F.regexp_replace(iri, f"^{NS}", ""))).when(iri.startswith(RDF), F.concat(F.lit("rdf:"), F.regexp_replace(iri, f"^{RDF}", ""))).otherwise(iri)


def count_predicates(queries: DataFrame, group: str, text: str) -> DataFrame:
    """group, predicate, n: for each group, and over all groups (group null)."""
    tokens = queries.select(F.col(group).alias("group"), F.explode(predicate_tokens(F.col(text))).alias("predicate"))
    return tokens.groupingSets([["group", "predicate"], ["predicate"]], "group", "predicate").agg(F.count("*").alias("n"))


def normalize_predicate(p: Column) -> Column:
    p = F.trim(p)
    return F.when(p.startswith("http://") | p.startswith("https://"), p).when(p.startswith("rdf-schema#"), F.concat(F.lit("http://www.w3.org/2000/01/rdf-schema#"), F.regexp_replace(p, "^rdf-schema#", ""))).otherwise(F.concat(F.lit(NS), p))


def is_meaningful(iri: Column) -> Column:
    return F.coalesce(iri.startswith(NS) & ~iri.rlike(r"(?U)\s"), F.lit(False))


#: Three strings in single quotes between square brackets (fixed value).
TRIPLE = r"\[\s*'([^']*)'\s*,\s*'([^']*)'\s*,\s*'([^']*)'\s*\]"
#: Prefixes of nodes that are no predicates: none are excluded as it stands (fixed value).
EXCLUDED_PREFIXES: tuple[str, ...] = ()


def has_excluded_prefix(token: Column, prefixes: Sequence[str] = EXCLUDED_PREFIXES) -> Column:
    return token.contains(":") & F.substring_index(token, ":", 1).isin(list(prefixes))


def graph_triples(records: DataFrame, graph: str) -> DataFrame:
    """s, p, o of a list of triples, as JSON or as the text of a list with quoted strings; items that are no three strings are dropped."""
    listed = F.from_json(graph, "array<array<string>>")
    quoted = [F.regexp_extract_all(graph, F.lit(TRIPLE), F.lit(k)) for k in (1, 2, 3)]
    written = F.transform(F.arrays_zip(*[q.alias(f"x{k}") for k, q in enumerate(quoted)]), lambda z: F.array(z["x0"], z["x1"], z["x2"]))
    rows = records.select(F.explode(F.coalesce(listed, written)).alias("t"))
    return rows.filter((F.size("t") == 3) & F.forall("t", lambda x: x.isNotNull())).select(F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.col("t")[2].alias("o"))


# -- paths -----------------------------------------------------------------------------------------------------------------


def split_path(text: Column) -> Column:
    """Components of a path text parted by any of the three arrows."""
    one = F.regexp_replace(text, "-->|→", "->")
    return F.filter(F.transform(F.split(one, "->"), lambda x: F.trim(x)), lambda x: x != "")


#: Keys under which an item can hold its path, first ones first (fixed values).
PATH_KEYS = ["name_path", "namePath", "path", "name_path_str", "names", "namepath"]


def name_paths(item: Column) -> Column:
    """The paths of a JSON item: name_path1 and name_path2 together; else the list or text under the first key that holds one; else the first text with an arrow. Other texts are paths themselves."""
    held = F.from_json(item, "map<string,string>")
    some = lambda c: F.filter(c, lambda p: F.size(p) > 0)

    def components(value: Column) -> Column:
        listed = F.filter(F.transform(F.from_json(value, "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.trim(value).startswith("[") & listed.isNotNull(), listed).otherwise(split_path(value))

    both = F.map_contains_key(held, "name_path1") & F.map_contains_key(held, "name_path2")
    keyed = F.coalesce(*[F.when(~F.coalesce(held[k], F.lit("1")).rlike(r"^(-?[0-9.eE+]+|true|false|\{.*)$"), held[k]) for k in PATH_KEYS])
    arrow = F.get(F.filter(F.map_values(held), lambda x: x.contains("->") | x.contains("→")), 0)
    single = F.when(keyed.isNotNull(), components(keyed)).otherwise(split_path(arrow))
    pair = F.array(split_path(F.coalesce(held["name_path1"], F.lit("None"))), split_path(F.coalesce(held["name_path2"], F.lit("None"))))
    none = F.array().cast("array<array<string>>")
    of_object = F.when(both, pair).otherwise(F.coalesce(some(F.array(single)), none))
    return F.when(item.isNull(), none).when(F.trim(item).startswith("{"), of_object).otherwise(some(F.array(split_path(item))))


def entities(path: Column) -> Column:
    return F.filter(path, lambda x, i: i % 2 == 0)


def path_relations(path: Column) -> Column:
    return F.filter(path, lambda x, i: i % 2 == 1)


def fold(values: Column) -> Column:
    return F.transform(values, lambda x: F.lower(F.trim(x)))


def hops(path: Column) -> Column:
    return F.greatest(F.floor((F.size(path) - 1) / 2), F.lit(0)).cast("int")


def path_reason(path: Column, require: int | None = None, least: int | None = None, most: int | None = None) -> Column:
    """The first reason against a path, or null."""
    n, e, r = hops(path), entities(path), path_relations(path)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if require is not None:
        out = out.when(n != require, "hops_not_equal")
    if least is not None:
        out = out.when(n < least, "hops_too_short")
    if most is not None:
        out = out.when(n > most, "hops_too_long")
    return (
        out.when(F.size(F.array_distinct(fold(e))) != F.size(e), "duplicate_entities")
        .when(F.size(F.array_distinct(fold(r))) != F.size(r), "duplicate_relations")
        .when(F.exists(e, lambda x: x.startswith("m.") | x.startswith("g.")), "entity_mid_prefix_in_name_path")
    )


def blacklist_reason(path: Column, predicates: Sequence[str], names: Sequence[str]) -> Column:
    return F.when(F.exists(path_relations(path), lambda x: x.isin(list(predicates))), "predicate_blacklisted_in_name_path").when(F.exists(fold(entities(path)), lambda x: (x != "") & x.isin(list(names))), "entity_blacklisted_in_name_path")


def step_reason(steps: Column, predicates: Sequence[str], names: Sequence[str]) -> Column:
    """Reasons in steps (relation_uri, relation, relation_name, node_name, node, node_uri), of the first step that has one."""
    filled = lambda x, *fs: F.coalesce(*[F.nullif(x[f], F.lit("")) for f in fs])

    def of(x: Column) -> Column:
        low = lambda c: F.lower(F.trim(c))
        return (
            F.when(filled(x, "relation_uri", "relation").isin(list(predicates)) | low(x["relation_name"]).isin(list(predicates)), "predicate_blacklisted_in_steps")
            .when(low(filled(x, "node_name", "node")).isin(list(names)), "entity_blacklisted_in_steps")
            .when(x["node_uri"].startswith("m.") | x["node_uri"].startswith("g."), "mid_node_uri_in_steps")
        )

    return F.get(F.filter(F.transform(steps, of), lambda x: x.isNotNull()), 0)


def conjunction_reason(one: Column, two: Column) -> Column:
    """Against two paths of one answer: a shared entity besides a common last one, or a shared relation."""
    a, b = fold(entities(one)), fold(entities(two))
    last = lambda x: F.element_at(x, -1)
    shared = F.array_intersect(a, b)
    shared = F.when(last(a) == last(b), F.array_except(shared, F.array(last(a)))).otherwise(shared)
    return F.when(F.size(shared) > 0, "cross_path_duplicate_entity").when(F.arrays_overlap(fold(path_relations(one)), fold(path_relations(two))), "cross_path_duplicate_relation")


def filter_paths(paths: DataFrame, path: str = "path", second: str | None = None, predicates: Sequence[str] = (), names: Sequence[str] = (), require: int | None = None, least: int | None = None, most: int | None = None, steps: str | None = None) -> DataFrame:
    """Adds reason: null for paths that stay. Structure of each path, then the pair, then the blacklists on the steps and on each path."""
    columns = [F.col(path), *([F.col(second)] if second else [])]
    reasons = [F.when(F.size(F.coalesce(c, F.array())) == 0, "missing_name_path") for c in columns]
    reasons += [path_reason(c, require, least, most) for c in columns]
    if second:
        reasons.append(conjunction_reason(*columns))
    if steps:
        reasons.append(step_reason(F.col(steps), predicates, names))
    reasons += [blacklist_reason(c, predicates, names) for c in columns]
    return paths.withColumn("reason", F.coalesce(*reasons))


def drop_counts(filtered: DataFrame) -> DataFrame:
    """outcome, n: how many items were read ('total'), kept, and dropped for each reason."""
    outcome = F.explode(F.array(F.lit("total"), F.coalesce("reason", F.lit("kept"))))
    return filtered.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def walks(kg: DataFrame, start: DataFrame, length: int, degree: int | None = None) -> DataFrame:
    """path: alternating nodes and predicates of all walks of a length from start(node), without a node twice.

    degree bounds the steps from a node (by predicate and id): a guard against explosion.
    """
    step = kg.select("s", "p", "o").distinct()
    if degree:
        step = step.withColumn("k", F.row_number().over(W.partitionBy("s").orderBy("p", "o"))).filter(F.col("k") <= degree).drop("k")
    out = start.select(F.array("node").alias("path"), F.col("node").alias("at"))
    for _ in range(length):
        out = out.join(step, F.col("at") == F.col("s")).filter(~F.array_contains("path", F.col("o"))).select(F.concat("path", F.array("p", "o")).alias("path"), F.col("o").alias("at"))
    return out.select("path")


# -- small predicates ------------------------------------------------------------------------------------------------------

LINK_ENDINGS = ["", ".html", ".htm", ".shtml"]


def keep_link(url: Column, mime: Column) -> Column:
    """Pages without a declared kind whose path ends like a page's."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return mime.isNull() & F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(LINK_ENDINGS)


#: What may not stand in tool code, and modules that may be imported (fixed values).
DENIED = [
    r"import\s+os", r"import\s+sys", r"import\s+subprocess", r"import\s+shutil", r"import\s+glob", r"import\s+pathlib", r"__import__", r"eval\s*\(", r"exec\s*\(", r"open\s*\(", r"file\s*\(",
    r"input\s*\(", r"raw_input\s*\(", r"compile\s*\(", r"execfile\s*\(", r"getattr\s*\(", r"setattr\s*\(", r"delattr\s*\(", r"hasattr\s*\(", r"globals\s*\(", r"locals\s*\(", r"vars\s*\(",
    r"dir\s*\(", r"type\s*\(", r"isinstance\s*\(", r"issubclass\s*\(", r"super\s*\(", r"property\s*\(", r"staticmethod\s*\(", r"classmethod\s*\(", r"__\w+__",
]
ALLOWED_IMPORTS = ["math", "random", "datetime", "collections", "itertools", "functools", "operator", "statistics", "decimal", "fractions"]


def is_safe_code(code: Column) -> Column:
    imports = F.concat(F.regexp_extract_all(code, F.lit(r"import\s+(\w+)"), F.lit(1)), F.regexp_extract_all(code, F.lit(r"from\s+(\w+)"), F.lit(1)))
    denied = code.rlike("(?i)" + "|".join(f"(?:{d})" for d in DENIED))
    return ~denied & (F.size(F.array_except(imports, F.array(*map(F.lit, ALLOWED_IMPORTS)))) == 0)


def metadata_map(raw: Column) -> Column:
    """A JSON object as a map; null gives an empty map, anything else {_raw: text}."""
    parsed = F.when(F.trim(raw).startswith("{"), F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"}))
    empty = F.create_map().cast("map<string,string>")
    return F.when(raw.isNull(), empty).otherwise(F.coalesce(parsed, F.create_map(F.lit("_raw"), raw)))


def prepare_questions(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """question, metadata (JSON of id, topic_entity, answers) of rows(id, question, answers, topic_entity, ord).

    The first `limit` rows count before empty questions are dropped.
    """
    if limit is not None:
        rows = rows.orderBy("ord" if "ord" in rows.columns else "id").limit(limit)
    kept = rows.filter(F.coalesce(F.trim("question"), F.lit("")) != "")
    return kept.select("question", F.to_json(F.struct(F.coalesce("id", F.lit("")).alias("id"), "topic_entity", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))).alias("metadata"))
