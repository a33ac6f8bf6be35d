"""Threads of chat requests: keys, roles, blocks, segments, prefix chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import chat_json as J

CHAT_PATH = "/v1/chat/completions"
# How system prompts of the main agent and of its workers begin.
MAIN_PREFIX = "You are Qwen Code"
WORKER_PREFIX = "You are a general-purpose subagent"


def answered(requests: DataFrame) -> DataFrame:
    """Chat requests of status 200 with at least one choice in the response, each once."""
    rows = requests.where((F.col("path") == CHAT_PATH) & (F.col("status") == 200)).select("request_id", "episode", "seq", "request", "response")
    v = rows.withColumn("q", J.chat_variant("request")).withColumn("p", J.chat_variant("response"))
    kept = v.where(F.size(F.try_variant_get("p", "$.choices", "array<variant>")) > 0)
    return kept.select("request_id", "episode", "seq", J.messages(F.col("q")).alias("messages")).where(F.size("messages") > 0)


def message_roles(requests: DataFrame) -> DataFrame:
    """(request_id, pos, role): one row per message of every answered request, each request once.

    Requests are shuffled as their lists of roles, without any text, and what
    is windowed by request afterwards needs no further shuffle.
    """
    rows = answered(requests).select("request_id", F.transform("messages", J.role).alias("roles")).dropDuplicates(["request_id"])
    return rows.select("request_id", F.posexplode("roles").alias("pos", "role")).select("request_id", F.col("pos").cast("long").alias("pos"), "role")


def _quoted(text: Column) -> Column:
    """The text as a JSON string, other than ASCII characters as they are."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return F.concat(F.lit('"'), text, F.lit('"'))


def thread_key(messages: Column) -> Column:
    """Ten hexadecimal digits that name the thread: md5 of the system text, NUL and the content of the next message as JSON (a string, or a list of text parts)."""
    head = F.coalesce(J.text(F.get(messages, F.lit(0))), F.lit(""))
    ask = F.get(messages, F.lit(1))
    parts = F.try_variant_get(ask, "$.content", "array<variant>")
    part = lambda p: F.concat(F.lit('{"type": "text", "text": '), _quoted(F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), F.lit("}"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(parts, part), ", "), F.lit("]"))
    content = F.when(parts.isNotNull(), listed).otherwise(_quoted(F.coalesce(F.try_variant_get(ask, "$.content", "string"), F.lit(""))))
    return F.substring(F.md5(F.concat(head, F.lit("\u0000"), content)), 1, 10)


def role_of_thread(system: Column, is_main: Column | None = None) -> Column:
    """orchestrator, worker or auxiliary, by the start of the system prompt."""
    main = F.startswith(system, F.lit(MAIN_PREFIX)) if is_main is None else is_main | F.startswith(system, F.lit(MAIN_PREFIX))
    return F.when(main, "orchestrator").when(F.startswith(system, F.lit(WORKER_PREFIX)), "worker").otherwise("auxiliary")


def task_of_condition(condition: Column) -> Column:
    """The number in a condition like t307_v7; null where there is none."""
    return F.regexp_extract(condition, r"^t(\d+)_", 1).try_cast("long")


def thread_keys(requests: DataFrame) -> DataFrame:
    """(request_id, thread_key, role, n_messages)."""
    m = F.col("messages")
    return answered(requests).select(
        "request_id", thread_key(m).alias("thread_key"), role_of_thread(F.coalesce(J.text(F.get(m, F.lit(0))), F.lit(""))).alias("role"), F.size(m).cast("long").alias("n_messages")
    ).dropDuplicates(["request_id"])


def run_length_blocks(messages: DataFrame, key: str = "request_id", merged: str = "tool") -> DataFrame:
    """(key, block_no, kind, msg_start, msg_end): runs of ``merged`` messages form one block, any other message its own."""
    w = Window.partitionBy(key).orderBy("pos")
    starts = messages.select(key, "pos", "role").withColumn(
        "new", F.when((F.col("role") == merged) & F.coalesce(F.lag("role").over(w) == merged, F.lit(False)), 0).otherwise(1)
    )
    numbered = starts.withColumn("block_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(key, "block_no").agg(F.min_by("role", "pos").alias("kind"), F.min("pos").alias("msg_start"), (F.max("pos") + 1).alias("msg_end"))


def query_segments(messages: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, segment, msg_start, msg_end, n_assistant): a segment runs from a user message to the next; what precedes the first belongs to it."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)
    numbered = messages.select(key, "pos", "role").withColumn("segment", F.greatest(n - 1, F.lit(0)).cast("long"))
    return numbered.groupBy(key, "segment").agg(
        F.min("pos").alias("msg_start"), (F.max("pos") + 1).alias("msg_end"), F.count_if(F.col("role") == "assistant").alias("n_assistant")
    )


def canonical(message: Column) -> Column:
    """The message as JSON with sorted keys: equal for messages that differ in the order of keys or in spacing only."""
    return message.cast("string")


def prefix_segments(requests: DataFrame) -> DataFrame:
    """(request_id, thread_key, segment): within a thread ordered by seq, a segment breaks where the messages before are no prefix.

    Messages are equal when their canonical JSON is: role, content, reasoning,
    calls with ids and arguments, and all else. A request is shuffled as the
    hashes of its messages, 8 bytes each.
    """
    m = F.col("messages")
    rows = answered(requests).select("request_id", "episode", "seq", thread_key(m).alias("thread_key"), F.transform(m, lambda x: F.xxhash64(canonical(x))).alias("now")).dropDuplicates(["request_id"])
    w = Window.partitionBy("episode", "thread_key").orderBy("seq", "request_id")
    lagged = rows.withColumn("before", F.lag("now").over(w))
    broken = F.col("before").isNotNull() & ((F.size("before") > F.size("now")) | (F.slice("now", F.lit(1), F.greatest(F.size("before"), F.lit(0))) != F.col("before")))
    marked = lagged.select("request_id", "episode", "seq", "thread_key", F.when(broken, 1).otherwise(0).alias("b"))
    return marked.select("request_id", "thread_key", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))
