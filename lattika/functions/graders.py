"""Answer graders as column expressions; those that no expression can state are vectorised functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattika.functions.algebra import same_answer

SPACES = r"(?U)\s+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACES, " "), "^ | $", "")


def normalize_answer(text: Column) -> Column:
    """Lower case, without the words a and an (`the` stays), single spaces; punctuation stays."""
    return squeeze(F.regexp_replace(F.lower(text), r"(?U)\b(a|an)\b", " "))


def normalize_strict(text: Column) -> Column:
    """Lower case, without punctuation and the words a, an, the, single spaces."""
    bare = F.regexp_replace(F.lower(text), "[" + re.escape(PUNCTUATION).replace("\\'", "'").replace('\\"', '"') + "]", "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def parse_prediction(text: Column) -> Column:
    """Answers in a prediction: the non-empty items of a JSON list, a JSON scalar, parts between bars, or the whole.

    Items that count as false (null, false, 0, an empty text) are left out of lists.
    """
    clean = F.trim(text)
    value = F.try_parse_json(clean)
    kind = F.schema_of_variant(value)
    items = F.filter(F.from_json(clean, "array<string>"), lambda x: x.isNotNull() & (x != "") & ~x.isin("false", "0", "0.0", "{}", "[]"))
    bars = F.filter(F.transform(F.split(clean, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    parsed = F.when(kind.startswith("ARRAY"), F.transform(items, lambda x: F.trim(x))).when(value.isNotNull(), F.array(F.trim(F.try_variant_get(value, "$", "string"))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.when(clean.contains("|"), bars).otherwise(F.array(clean))))


def relaxed_match(text: Column, golds: Column) -> Column:
    """1 if a parsed answer equals, contains or lies in a gold answer after normalisation. An empty gold lies in everything."""

    def hit(p: Column) -> Column:
        n = normalize_answer(p)
        return (p != "") & F.exists(golds, lambda g: n.contains(normalize_answer(g)) | ((n != "") & normalize_answer(g).contains(n)))

    return F.coalesce(F.exists(parse_prediction(text), hit), F.lit(False)).cast("double")


def set_f1(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(a, b))
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def merged_f1(text: Column, golds: Column) -> Column:
    """F1 of the distinct words of all answers and of all golds."""
    tokens = lambda values: F.flatten(F.transform(values, lambda x: words(normalize_answer(x))))
    return F.coalesce(set_f1(tokens(parse_prediction(text)), tokens(golds)), F.lit(0.0))


def max_f1(text: Column, golds: Column) -> Column:
    """The largest F1 of distinct words between an answer and a gold."""
    pairs = F.flatten(F.transform(parse_prediction(text), lambda p: F.transform(golds, lambda g: set_f1(words(normalize_answer(p)), words(normalize_answer(g))))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def bag_f1(prediction: Column, gold: Column) -> Column:
    """struct(f1, precision, recall) of words counted as often as they stand; yes, no and noanswer only match themselves."""
    p, g = normalize_strict(prediction), normalize_strict(gold)
    pw, gw = words(p), words(g)
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    same = F.aggregate(F.array_distinct(pw), F.lit(0), lambda s, w: s + F.least(count(pw, w), count(gw, w)))
    guard = (p.isin("yes", "no", "noanswer") | g.isin("yes", "no", "noanswer")) & (p != g)
    none = prediction.isNull() | guard | (same == 0)
    precision, recall = same / F.size(pw), same / F.size(gw)
    zero = F.lit(0.0)
    return F.struct(F.when(none, zero).otherwise(2.0 * same / (F.size(pw) + F.size(gw))).alias("f1"), F.when(none, zero).otherwise(precision).alias("precision"), F.when(none, zero).otherwise(recall).alias("recall"))


# -- tags ------------------------------------------------------------------------------------------------------------------


def tagged(text: Column, tag: str) -> Column:
    """All contents of a tag that hold no further opening of it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>((?:(?!<{tag}>).)*?)</{tag}>"), F.lit(1))


def last_answer(text: Column) -> Column:
    found = tagged(text, "answer")
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def first_query(text: Column) -> Column:
    return F.trim(F.get(tagged(text, "kg-query"), 0))


def format_reward(content: Column, final: Column) -> Column:
    """1 for a final turn whose last answer is a non-empty JSON list, and for other turns with a thought and a query."""
    answer = last_answer(content)
    value = F.try_parse_json(answer)
    listed = F.schema_of_variant(value).startswith("ARRAY") & (F.size(F.from_json(answer, "array<string>")) > 0)
    other = (F.size(tagged(content, "think")) > 0) & (F.size(tagged(content, "kg-query")) > 0)
    return F.coalesce(F.when(final, listed).otherwise(other), F.lit(False)).cast("double")


#: Texts that mark an answer of the store as an error (fixed values).
ERRORS = ["Invalid entity", "not in the latest predicate list", "Could not parse query", "KG query service not available", "No triples found"]


def query_reward(success: Column, information: Column) -> Column:
    bad = F.lit(False)
    for e in ERRORS:
        bad = bad | information.contains(e)
    return F.coalesce(success & (F.trim(information) != "") & ~bad, F.lit(False)).cast("double")


def retrieval_score(information: Column, golds: Column) -> Column:
    """1 if a gold answer stands in the joined texts of an array, whatever the case."""
    every = F.lower(F.array_join(information, " "))
    return F.coalesce(F.exists(golds, lambda g: (g != "") & every.contains(F.lower(g))), F.lit(False)).cast("double")


def extract_solution(text: Column) -> Column:
    """The last answer, if there are at least two (the first is the prompt's example)."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) > 1, F.trim(F.element_at(found, -1)))


TAGS = ("think", "search", "information", "answer")


def valid_sequence(text: Column) -> Column:
    """Whether what follows the assistant marker is think, search, information, think ... answer, with nothing between."""
    start = r"(?s)^.*?<\|im_start\|>assistant\s*"
    body = F.regexp_replace(text, start, "")
    balanced = F.lit(True)
    for t in TAGS:
        balanced = balanced & (F.regexp_count(body, F.lit(f"<{t}>")) == F.regexp_count(body, F.lit(f"</{t}>")))
    inner = lambda t: rf"<{t}>(?:(?!</?(?:think|search|information|answer)>).)*</{t}>\s*"
    shape = rf"(?s)^\s*(?:{inner('think')}{inner('search')}{inner('information')})*{inner('think')}{inner('answer')}$"
    return text.rlike(r"<\|im_start\|>assistant") & balanced & body.rlike(shape)


def exact_among(answer: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normalize_strict(g) == normalize_strict(answer))


def search_score(text: Column, golds: Column, structure: float = 0.0, final: float = 0.0, retrieval: float = 0.0, score: float = 1.0) -> Column:
    """The ladder of answer, format and retrieval."""
    valid, answer = valid_sequence(text), extract_solution(text)
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<information>(.*?)</information>"), F.lit(1))
    found = F.exists(blocks, lambda b: F.exists(golds, lambda g: normalize_strict(b).contains(normalize_strict(g))))
    formed = F.when(valid & found, structure + retrieval).when(valid, structure)
    right = answer.isNotNull() & exact_among(answer, golds)
    return F.when(right & valid, score).when(right, score - structure).otherwise(F.coalesce(formed, F.when(answer.isNull(), 0.0).otherwise(final))).cast("double")


# -- multiple choice and mathematics ---------------------------------------------------------------------------------------


def choice_letter(response: Column, letters: str = "ABCDEFGH") -> Column:
    """The option a response names: after answer/option/choice, before 'is correct', after final answer, or the last capital alone."""
    text = F.element_at(F.split(response, "</think>"), -1)
    patterns = [r"(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])", r"(?i)([A-Z])\s*(?:is\s*(?:the)?\s*correct)", r"(?i)final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])"]
    tries = [F.upper(F.regexp_extract(text, p, 1)) for p in patterns]
    alone = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z])\b"), F.lit(1)), lambda x: x.isin(list(letters)))
    return F.coalesce(*[F.when(t.isin(list(letters)), t) for t in tries], F.when(F.size(alone) > 0, F.element_at(alone, -1)))


def plain_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def choice_score(response: Column, label: Column, choices: Column | None = None) -> Column:
    """1 if the named option is the label's; without an option, if the label's text stands in the response."""
    letter = choice_letter(response)
    right = F.when((F.length(F.trim(label)) == 1) & F.upper(F.trim(label)).rlike("^[A-H]$"), F.upper(F.trim(label)))
    if choices is not None:
        at = F.array_position(F.transform(choices, plain_text), plain_text(label))
        right = F.coalesce(right, F.when(at > 0, F.substring(F.lit("ABCDEFGH"), at.cast("int"), F.lit(1))))
    body = plain_text(F.element_at(F.split(response, "</think>"), -1))
    said = (plain_text(label) != "") & body.contains(plain_text(label))
    return F.coalesce(F.when(letter.isNotNull() & right.isNotNull(), letter == right).otherwise(said), F.lit(False)).cast("double")


#: Replacements and removals that make a final answer comparable, in order (fixed values).
REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots", "<|im_end|>", "<|endoftext|>",
]


def final_answer(text: Column) -> Column:
    """Normal form of a quantitative answer."""
    out = F.element_at(F.split(text, "="), -1)
    for a, b in REPLACED:
        out = F.replace(out, F.lit(a), F.lit(b))
    for a in REMOVED:
        out = F.replace(out, F.lit(a), F.lit(""))
    out = F.regexp_replace(out, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for tag in (r"\\text", r"\\textbf", r"\\overline"):
        out = F.regexp_replace(out, tag + r"\{(.*?)\}", "$1")
    out = F.regexp_replace(out, r"\\boxed\{(.*)\}", "$1")
    out = F.regexp_replace(out, r"(frac)([^{])(.)", "frac{$2}{$3}")
    out = F.replace(F.regexp_replace(out, r"(sqrt)([^{])", "sqrt{$2}"), F.lit("$"), F.lit(""))
    digits = F.replace(out, F.lit(","), F.lit(""))
    return F.trim(F.when(digits.rlike(r"^\d+$"), digits).otherwise(out))


def last_boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...} with balanced braces."""
    at = (text or "").rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for i in range(at + 6, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at + 7 : i]
    return None


@F.pandas_udf(T.StringType())
def boxed(texts: pd.Series) -> pd.Series:
    return texts.map(last_boxed)


def integer_score(response: Column, label: Column) -> Column:
    """1 or -1: the last `Answer:` line of the last 300 characters against an integer label."""
    tail = F.substring(response, -300, 300)
    found = F.regexp_extract_all(tail, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    said = final_answer(F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("[INVALID]"))
    gold = final_answer(label).cast("double").cast("long").cast("string")
    return F.when(said == gold, 1.0).otherwise(-1.0)


def boxed_score(response: Column, label: Column) -> Column:
    """1 or -1: the last boxed answer of the last 100 characters equals the label."""
    return F.when(boxed(F.substring(response, -100, 100)) == label, 1.0).otherwise(-1.0)


@F.pandas_udf(T.DoubleType())
def math_score(responses: pd.Series, labels: pd.Series) -> pd.Series:
    """1 if the boxed answer equals the label (its boxed part, if it has one), by text or by value."""

    def one(r: str | None, g: str | None) -> float:
        said, gold = last_boxed(r), g if g is None or "\\boxed" not in g else last_boxed(g)
        return 0.0 if said is None or not gold else float(same_answer(said, gold))

    return pd.Series([one(r, g) for r, g in zip(responses, labels, strict=True)])


def think_math_score(response: Column, label: Column) -> Column:
    """math_score of what follows the last </think>, else of what follows ###Response; 0 without either."""
    body = F.when(response.contains("</think>"), F.element_at(F.split(response, "</think>"), -1)).when(response.contains("###Response"), F.get(F.split(response, "###Response"), 1))
    return F.coalesce(math_score(body, label), F.lit(0.0))


def shaped_reward(score: Column, turns: Column) -> Column:
    """A failed sample gets a tenth back for each two turns after the second, up to -0.6."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (turns - 2) / 2 * 0.1)).otherwise(score)


def selected_index(text: Column) -> Column:
    """The number after the last `Judgment:`; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"Judgment:\s*(\d+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))


def random_score(response: Column, label: Column, seed: int = 0) -> Column:
    """0 or 1 by a hash of response and label: a control without knowledge that gives the same again."""
    return F.pmod(F.xxhash64(F.coalesce(response, F.lit("")), F.coalesce(label, F.lit("")), F.lit(seed)), F.lit(2)).cast("double")


def gold_answers(answers: Column, label: Column) -> Column:
    """Answers of the metadata; where there are none, those of a label: the list under ground_truth or answers of an object, a list, or the text itself."""
    listed = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    held = F.from_json(label, "ground_truth array<string>, answers array<string>")
    of_object = F.when(F.size(listed(held["ground_truth"])) > 0, held["ground_truth"]).otherwise(listed(held["answers"]))
    start = F.trim(label)
    other = F.when(start.startswith("{"), of_object).when(start.startswith("["), listed(F.from_json(label, "array<string>"))).when(F.coalesce(label, F.lit("")) != "", F.array(label)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(listed(answers)) > 0, answers).otherwise(other)


def turn_text(response: str | None, query: str | None, answer: str | None, think: str | None) -> str:
    """The part of a response that is a turn's own: the block of its query, or the last answer, from the first thought before it on; else from its thought to the end of the next action."""
    response = response or ""
    blocks = [(m[1], m.start(), m.end()) for m in re.finditer(r"(?s)<(think|kg-query|answer)>((?:(?!<\1>).)*?)</\1>", response)]

    def from_thought(start: int, end: int) -> str:
        return response[next((a for kind, a, b in blocks if kind == "think" and b <= start), start) : end]

    if query:
        own = [(a, b) for kind, a, b in blocks if kind == "kg-query" and query in response[a + 10 : b - 11]]
        if own:
            return from_thought(*own[0])
    if answer:
        said = [(a, b) for kind, a, b in blocks if kind == "answer"]
        if said:
            return from_thought(*said[-1])
    if think:
        mark = think.strip().lower()[:50]
        for kind, a, b in blocks:
            if kind == "think" and mark in response[a:b].lower():
                return response[a : next((d for other, c, d in blocks if other != "think" and c >= a), b)]
    return ""


@F.pandas_udf(T.StringType())
def turn_content(response: pd.Series, query: pd.Series, answer: pd.Series, think: pd.Series) -> pd.Series:
    return pd.Series([turn_text(*x) for x in zip(response, query, answer, think, strict=True)])


GRADERS = {"em": relaxed_match, "f1": max_f1, "merged_f1": merged_f1, "choice": choice_score, "dapo": integer_score, "strict_box": boxed_score, "math": math_score, "deepscaler": think_math_score, "search_em": search_score, "random": random_score}


def grade(rows: DataFrame, kind: str, response: str, label: str, golds: str, default: str = "em") -> DataFrame:
    """Adds score: graded by the kind in a column (default if null); a `boxed_` prefix takes the boxed answer first; unknown kinds raise."""
    kinds = F.coalesce(F.col(kind), F.lit(default))
    name, said = F.regexp_replace(kinds, "^boxed_", ""), F.col("__said")
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for k, f in GRADERS.items():
        out = out.when(name == k, f(said, F.col(golds) if k in ("em", "f1", "merged_f1", "search_em") else F.col(label)))
    unwrapped = rows.withColumn("__said", F.when(kinds.startswith("boxed_"), boxed(F.col(response))).otherwise(F.col(response)))
    return unwrapped.withColumn("score", out.otherwise(F.raise_error(F.concat(F.lit("unknown grader: "), kinds)))).drop("__said")
