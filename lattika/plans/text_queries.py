"""Queries over texts of searches, tools and chats, and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.functions import text as X
from lattika.streaming import buffer as B


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def snippet_parts(spark, sf):
    text = F.concat(F.col("p_name"), F.lit(" one two three ... short ... "), F.col("p_type"), F.lit(" a b c d e f"))
    return _t(spark, sf, "part").select("p_partkey", F.array_join(X.snippet_parts(text), "|").alias("parts"))


def query_sanitize(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", X.sanitize_query(F.concat(F.lit(" ("), F.col("p_name"), F.lit(")\t "), F.col("p_brand"), F.lit("!?"))).alias("query"))


def context_lines(spark, sf):
    page = F.concat(F.lit("first line\nab "), F.col("p_name"), F.lit(" one two three four five six end\nlast"))
    snippet = F.concat(F.col("p_name"), F.lit(" one two three four five ... not in the page at all here"))
    return _t(spark, sf, "part").select("p_partkey", X.enclosing_lines(snippet, page).alias("context"))


def search_actions(spark, sf):
    k = F.pmod("p_partkey", F.lit(3))
    text = F.when(k == 0, F.concat(F.lit("x <search> "), F.col("p_name"), F.lit(" </search> <answer>no</answer>"))).when(k == 1, F.concat(F.lit("<answer>"), F.col("p_name"), F.lit("</answer> more"))).otherwise("none")
    a = _t(spark, sf, "part").select("p_partkey", X.search_action(text).alias("a"), X.cut_after_tag(text).alias("cut"))
    return a.select("p_partkey", "a.action", "a.content", "cut")


def tool_actions(spark, sf):
    k = F.pmod("p_partkey", F.lit(5))
    text = F.when(k == 0, F.concat(F.lit("<code>x</code> Answer: \\boxed{\\frac{"), F.col("p_size").cast("string"), F.lit("}{2}} tail"))).when(k == 1, F.concat(F.lit('<tool_call>{"name": "code_interpreter", "arguments": {"code": "'), F.col("p_name"), F.lit('"}}</tool_call> tail'))).when(k == 2, F.concat(F.lit("<code> "), F.col("p_name"), F.lit(" </code> tail"))).when(k == 3, F.concat(F.lit("```python\n"), F.col("p_name"), F.lit("\n``` tail"))).otherwise("none")
    a = _t(spark, sf, "part").select("p_partkey", X.tool_action(text).alias("a"), X.cut_after_call(text).alias("cut"))
    return a.select("p_partkey", "a.action", "a.content", F.length("cut").alias("n"))


def prompts(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", X.fill("Answer {question} from {names}.", question=F.col("p_type"), names=X.entities_line(F.array("p_name", F.lit(None).cast("string"), "p_brand"))).alias("prompt"))


def _chats(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.when(x["turn"] % 5 == 3, 0).alias("step_loss_mask"))).alias("messages"))


def chat_render(spark, sf):
    return _chats(spark, sf).select("conv_id", F.md5(X.render_chat(F.col("messages"), "Be brief.")).alias("digest"))


def chat_loss_mask(spark, sf):
    t = _chats(spark, sf).select("conv_id", X.chat_tokens(F.col("messages")).alias("t"))
    return t.select("conv_id", F.size("t").alias("n"), F.size(F.filter("t", lambda x: x["mask"] == 1)).alias("ones"))


def placeholders(spark, sf):
    text = F.concat(F.lit("<image>"), F.col("p_name"), F.lit("<video><image> end"))
    x = _t(spark, sf, "part").select("p_partkey", X.split_placeholders(text).alias("x"))
    return x.select("p_partkey", F.array_join(F.transform("x", lambda p: F.concat(p["type"], F.lit("="), p["text"])), ";").alias("parts"))


def buffer_stream(spark, sf):
    """Groups that a stream of events completes."""
    return B.drain(B.emit_groups(B.read_stream(spark, sf, "events"), "user_id", "event_id", 16)).select("user_id", "n", F.array_min("items").alias("first"), F.array_max("items").alias("last"))


def stream_window_counts(spark, sf):
    w = B.windowed(B.read_stream(spark, sf, "events"), "ts", "1 hour", "2 hours", "event_type")
    return B.drain(w, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_CASE = "CASE p_partkey % 5 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END"
SQL = {
    "snippet_parts": "SELECT p_partkey, CASE WHEN length(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) - length(replace(p_name, ' ', '')) + 4 > 5 THEN p_name || ' one two three|' ELSE '' END || p_type || ' a b c d e f' AS parts FROM part",
    "query_sanitize": "SELECT p_partkey, p_name || ' ' || replace(p_brand, '#', ' ') AS query FROM part",
    "context_lines": "SELECT p_partkey, 'ab ' || p_name || ' one two three four five six end' AS context FROM part",
    "search_actions": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'answer' END AS action, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE '' END AS content, CASE p_partkey % 3 WHEN 0 THEN 'x <search> ' || p_name || ' </search>' WHEN 1 THEN '<answer>' || p_name || '</answer>' ELSE 'none' END AS cut FROM part",
    "tool_actions": "SELECT p_partkey, " + _CASE.format("'answer'", "'code'", "'code'", "'code'", "NULL") + " AS action, " + _CASE.format("'\\frac{' || p_size || '}{2}'", "p_name", "p_name", "p_name", "''") + " AS content, CAST(" + _CASE.format("14", "length(p_name) + 78", "length(p_name) + 15", "length(p_name) + 14", "4") + " AS INT) AS n FROM part",
    "prompts": "SELECT p_partkey, 'Answer ' || p_type || ' from ''' || p_name || ''', ''' || p_brand || '''.' AS prompt FROM part",
    "chat_render": "SELECT conv_id, md5('<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "chat_loss_mask": "WITH c AS (SELECT conv_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, role = 'assistant' AND turn % 5 <> 3 AS on_ FROM conversations) SELECT conv_id, CAST(sum(n + 2) AS INT) AS n, CAST(sum(CASE WHEN on_ THEN n + 1 ELSE 0 END) AS INT) AS ones FROM c GROUP BY 1",
    "placeholders": "SELECT p_partkey, 'image=<image>;text=' || p_name || ';video=<video>;image=<image>;text= end' AS parts FROM part",
    "buffer_stream": "SELECT user_id, CAST(count(*) AS INT) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1 HAVING count(*) >= 16",
    "stream_window_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in SQL}
