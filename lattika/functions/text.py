"""Texts of searches, tool calls, prompts and chats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattika.functions.graders import squeeze


def snippet_parts(snippet: Column) -> Column:
    """Parts between dots that have more than five words."""
    parts = F.transform(F.split(snippet, r"\.\.\."), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) > 5)


def sanitize_query(query: Column) -> Column:
    return squeeze(F.regexp_replace(query, r"(?U)[^\w\s]", " "))


def enclosing_lines(snippet: Column, page: Column) -> Column:
    """Lines of the page around each part of the snippet that it holds, each once."""
    flat = F.translate(page, "\n", " ")

    def line(part: Column) -> Column:
        at = F.instr(flat, part)
        before, after = F.substring(page, F.lit(1), at - 1), F.substring(page, at + F.length(part), F.length(page))
        head, tail = F.substring_index(before, "\n", -1), F.substring_index(after, "\n", 1)
        return F.when(at > 0, F.trim(F.concat(head, F.substring(page, at, F.length(part)), tail)))

    return F.array_join(F.array_distinct(F.filter(F.transform(snippet_parts(snippet), line), lambda x: x.isNotNull())), "\n")


def search_action(text: Column) -> Column:
    """struct(action, content) of the first search or answer tag; an empty content without one."""
    p = r"(?s)<(search|answer)>(.*?)</\1>"
    return F.struct(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("action"), F.trim(F.regexp_extract(text, p, 2)).alias("content"))


#: A boxed answer with one level of braces inside, and a tool call (fixed values).
BOXED = r"(?s)Answer:\s*\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"


def tool_action(text: Column) -> Column:
    """struct(action, content): a boxed answer before a call of the interpreter, before a code tag, before a fenced block."""
    call = F.from_json(F.replace(F.regexp_extract(text, CALL, 1), F.lit("\n"), F.lit("\\n")), "name string, arguments struct<code: string>")
    code = F.when((call["name"] == "code_interpreter") & (F.trim(call["arguments"]["code"]) != ""), call["arguments"]["code"])
    tag, fence = r"(?s)<code>(.*?)</code>", r"(?s)```python\s*(.*?)\s*```"
    pick = lambda a, c: F.struct(F.lit(a).alias("action"), c.alias("content"))
    none = F.struct(F.lit(None).cast("string").alias("action"), F.lit("").alias("content"))
    return F.when(text.rlike(BOXED), pick("answer", F.trim(F.regexp_extract(text, BOXED, 1)))).when(code.isNotNull(), pick("code", code)).when(text.rlike(tag), pick("code", F.trim(F.regexp_extract(text, tag, 1)))).when(text.rlike(fence), pick("code", F.trim(F.regexp_extract(text, fence, 1)))).otherwise(none)


def cut_after_tag(text: Column, tags: tuple[str, ...] = ("search", "answer")) -> Column:
    """The text up to the first closing tag of the first kind that it holds."""
    out = F.when(F.lit(False), text)
    for t in tags:
        end = f"</{t}>"
        out = out.when(text.contains(end), F.concat(F.substring_index(text, end, 1), F.lit(end)))
    return out.otherwise(text)


def cut_after_call(text: Column) -> Column:
    """The text up to the last whole call, else the first code tag, else the last fenced block, else the last boxed answer."""
    upto = lambda p: F.regexp_extract(text, p, 1)
    call, fence = r"(?s)^(.*<tool_call>\s*\{.*?\}\s*</tool_call>)", r"(?s)^(.*```python\s*.*?```)"
    boxed = r"(?s)^(.*Answer:\s*\\boxed\{(?:[^{}]|\{[^{}]*\})*\})"
    return F.when(text.rlike(call), upto(call)).when(text.contains("</code>"), F.concat(F.substring_index(text, "</code>", 1), F.lit("</code>"))).when(text.rlike(fence), upto(fence)).when(text.rlike(boxed), upto(boxed)).otherwise(text)


def entities_line(names: Column) -> Column:
    return F.array_join(F.transform(F.filter(names, lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")


def fill(template: str, **values: Column) -> Column:
    """A prompt template with {name} places."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def render_chat(messages: Column, system: str | None = None) -> Column:
    """Messages of array<struct<role, content>> between start and end marks; a system message in front if given."""
    line = lambda r, c: F.concat(F.lit("<|im_start|>"), r, F.lit("\n"), c, F.lit("<|im_end|>\n"))
    body = F.array_join(F.transform(messages, lambda m: line(m["role"], m["content"])), "")
    return F.concat(line(F.lit("system"), F.lit(system)), body) if system else body


def chat_tokens(messages: Column) -> Column:
    """array<struct<token, mask>> by white space: the marks and other roles count 0, words of the assistant 1 unless its message says otherwise (step_loss_mask)."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def one(m: Column) -> Column:
        on = F.when(m["role"] == "assistant", F.coalesce(m["step_loss_mask"], F.lit(1))).otherwise(0)
        head = F.array(F.struct(F.concat(F.lit("<|im_start|>"), m["role"]).alias("token"), F.lit(0).alias("mask")))
        body = F.transform(words(m["content"]), lambda w: F.struct(w.alias("token"), on.alias("mask")))
        return F.concat(head, body, F.array(F.struct(F.lit("<|im_end|>").alias("token"), on.alias("mask"))))

    return F.flatten(F.transform(messages, one))


def distilled_tokens(messages: Column) -> Column:
    """array<struct<token, mask>> of a chat of which only the last message is learned: the first message and the mark that opens an answer count 0, words of the last 1 unless it says otherwise."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    first, last = F.element_at(messages, 1), F.element_at(messages, -1)
    on = F.when(F.coalesce(last["step_loss_mask"], F.lit(1)) == 1, 1).otherwise(0)
    token = lambda t, m: F.struct(t.alias("token"), m.cast("int").alias("mask"))
    head = F.concat(F.array(F.concat(F.lit("<|"), first["role"], F.lit("|>"))), words(first["content"]), F.array(F.lit("<|assistant|>")))
    return F.concat(F.transform(head, lambda w: token(w, F.lit(0))), F.transform(words(last["content"]), lambda w: token(w, on)))


def masked_tokens(messages: Column, kind: str = "plain", system: str = "You are a helpful assistant.") -> Column:
    """Tokens and masks by the family of a template: plain as it is; `system`, a system message in front where the chat has none; `distilled`."""
    if kind == "plain":
        return chat_tokens(messages)
    if kind == "distilled":
        return distilled_tokens(messages)
    if kind != "system":
        raise ValueError(f"unknown template: {kind}")
    front = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"), F.lit(None).cast("int").alias("step_loss_mask")))
    return chat_tokens(F.when(F.element_at(messages, 1)["role"] == "system", messages).otherwise(F.concat(front, messages)))


def aligned_mask(mask: Column, total: Column) -> Column:
    """A mask of text tokens, padded in front to the length of an input with other tokens; a shorter input raises."""
    missing = total - F.size(mask)
    return F.when(missing < 0, F.raise_error(F.lit("the input is shorter than its mask"))).otherwise(F.concat(F.array_repeat(F.lit(0), F.greatest(missing, F.lit(0)).cast("int")), mask))


def learned_sample(tokens: Column) -> Column:
    """struct(tokens, loss_mask, response_length, reward) of a chat for supervised training: the mask from its first 1 on, reward 0."""
    mask = F.transform(tokens, lambda t: t["mask"])
    at = F.array_position(mask, 1).cast("int")
    n = F.when(at > 0, F.size(mask) - at + 1).otherwise(0)
    own = F.when(at > 0, F.slice(mask, F.greatest(at, F.lit(1)), F.size(mask))).otherwise(F.array().cast("array<int>"))
    return F.struct(F.transform(tokens, lambda t: t["token"]).alias("tokens"), own.alias("loss_mask"), n.alias("response_length"), F.lit(0.0).alias("reward"))


#: What stands around the tools of a conversation, and the system message without an own one (fixed values).
TOOLS_HEAD = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
TOOL_SYSTEM = "You are a helpful assistant that can use Python tools to solve mathematical problems. When you need to perform calculations, use the code_interpreter tool to execute code and get results."


def conversation_with_tools(prompt: Column, tools: Column, messages: Column | None = None, system: str = TOOL_SYSTEM) -> Column:
    """A conversation that ends where the assistant speaks next. tools: array of JSON texts; messages: later turns, array<struct<role, content>>; other roles than user and assistant are left out."""
    told = F.when(F.size(F.coalesce(tools, F.array().cast("array<string>"))) > 0, F.concat(F.lit(TOOLS_HEAD), F.array_join(tools, ""), F.lit(TOOLS_TAIL))).otherwise("")
    line = lambda role, content: F.concat(F.lit("\n<|im_start|>"), role, content, F.lit("<|im_end|>"))
    said = F.when(F.coalesce(prompt, F.lit("")) != "", line(F.lit("user"), prompt)).otherwise("")
    parts = [F.lit(f"<|im_start|>system{system}"), told, F.lit("<|im_end|>"), said]
    if messages is not None:
        spoken = F.filter(F.coalesce(messages, F.array()), lambda m: m["role"].isin("user", "assistant"))
        parts.append(F.array_join(F.transform(spoken, lambda m: line(m["role"], m["content"])), ""))
    return F.concat(*parts, F.lit("\n<|im_start|>assistant"))


def split_placeholders(text: Column, marks: tuple[str, ...] = ("<image>", "<video>", "<audio>")) -> Column:
    """array<struct<type, text>>: stretches of text and the placeholders between them, in order."""
    either = "|".join(marks)
    parts = F.filter(F.split(F.regexp_replace(text, f"({either})", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")
    kind = lambda x: F.when(x.isin(list(marks)), F.regexp_replace(x, "[<>]", "")).otherwise("text")
    return F.transform(parts, lambda x: F.struct(kind(x).alias("type"), x.alias("text")))
