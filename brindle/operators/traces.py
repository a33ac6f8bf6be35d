"""Traces of runs: status, failures, stream reassembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completed(exit_code: Column, success: Column) -> Column:
    """Exit code 0 and success known to be true; never null."""
    return F.coalesce((exit_code == 0) & success.eqNullSafe(F.lit(True)), F.lit(False))


def failed(exit_code: Column, success: Column) -> Column:
    """A known exit code other than 0, or success known to be false; never null."""
    return F.coalesce(exit_code != 0, F.lit(False)) | F.coalesce(~success, F.lit(False))


# How an infrastructure error begins, and its markers.
INFRA_START = "[API Error"
INFRA_MARKERS = ("Connection error", "fetch failed", "timeout", "ECONNRESET", "ECONNREFUSED", "terminated", "No stream activity", "502", "503", "504", "socket hang up")


def outcome(exit_code: Column, success: Column, message: Column) -> Column:
    """success, infra_error, timeout, failure or unknown."""
    infra = F.startswith(message, F.lit(INFRA_START)) & F.exists(F.array(*map(F.lit, INFRA_MARKERS)), lambda m: F.contains(message, m))
    return F.when(completed(exit_code, success), "success").when(F.coalesce(infra, F.lit(False)), "infra_error").when(exit_code == 124, "timeout").when(failed(exit_code, success), "failure").otherwise("unknown")


def classify_runs(status: DataFrame) -> DataFrame:
    """(status_id, completed, failed, outcome, last_tools): the last five tool calls, newest first, arguments cut at 200 characters."""
    code, ok = F.col("exit_code"), F.col("trace_has_success_result")
    calls = F.coalesce(F.col("failure.last_tool_calls"), F.expr("array()"))
    newest = F.slice(F.reverse(calls), 1, 5)
    named = F.transform(newest, lambda c: F.concat(F.coalesce(c["tool"], F.lit("")), F.lit(" "), F.coalesce(F.substring(c["args"], 1, 200), F.lit(""))))
    return status.where("status_id is not null").dropDuplicates(["status_id"]).select(
        "status_id", completed(code, ok).alias("completed"), failed(code, ok).alias("failed"), outcome(code, ok, F.col("failure.message")).alias("outcome"), F.array_join(named, "|").alias("last_tools")
    )


def last_any_success(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, any_success, last_success): whether any result event succeeded, and whether the last one did."""
    ok = F.col("kind") == "success"
    result = F.col("kind").isin("success", "error")
    return events.groupBy(key).agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("any_success"), F.coalesce(F.max_by(ok, F.when(result, F.col(order))), F.lit(False)).alias("last_success"))


_CHUNK = (
    "id string, model string, created bigint, usage string, "
    "choices array<struct<index:int,finish_reason:string,stop_reason:string,delta:struct<role:string,content:string,reasoning_content:string,reasoning:string,"
    "tool_calls:array<struct<index:int,id:string,type:string,function:struct<name:string,arguments:string>>>>>>, _bad string"
)
_USAGE = "prompt_tokens bigint, completion_tokens bigint"


def _joined(items: Column, of: Callable[[Column], Column]) -> Column:
    """The texts that are not empty, in order and joined; null where there are none."""
    texts = F.filter(F.transform(items, of), lambda t: F.length(t) > 0)
    return F.when(F.size(texts) > 0, F.array_join(texts, ""))


def _last(items: Column, of: Callable[[Column], Column], empty: bool = False) -> Column:
    """The last value that is known, and not empty unless ``empty``; null where there is none."""
    values = F.filter(F.transform(items, of), lambda v: v.isNotNull() if empty else F.length(v) > 0)
    return F.try_element_at(values, F.lit(-1))


def _indexes(items: Column) -> Column:
    """The distinct indexes of choices or calls, in order; a missing index is 0."""
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: F.coalesce(x["index"], F.lit(0)))))


def _of_index(items: Column, index: Column) -> Column:
    return F.filter(items, lambda x: F.coalesce(x["index"], F.lit(0)) == index)


def _tool_call(pieces: Column, index: Column) -> Column:
    own = _of_index(pieces, index)
    return F.struct(
        index.alias("index"), _last(own, lambda c: c["id"]).alias("id"), F.coalesce(_last(own, lambda c: c["type"]), F.lit("function")).alias("type"),
        _joined(own, lambda c: c["function"]["name"]).alias("name"), F.coalesce(_joined(own, lambda c: c["function"]["arguments"]), F.lit("")).alias("arguments"),
    )


def assemble_streams(lines: DataFrame) -> DataFrame:
    """Reassembles logged event streams: one row per stream and choice.

    ``lines``: stream_id, ord, line. Lines without "data:" and the end mark are
    ignored; a payload that is no JSON object counts as bad and is otherwise ignored.
    id, model and created are the first that are not null; usage, role, finish
    and stop reason the last; contents, reasoning (under either name) and tool
    arguments are joined in order, and null where there are none. A call
    without type is a function, a message without role the assistant's.
    Every line is parsed once and every stream shuffled once, as the chunks of
    one response; what follows are array expressions.
    """
    payload = F.btrim(F.substr(F.rtrim("line"), F.lit(6)))
    data = lines.where(F.startswith("line", F.lit("data:"))).select("stream_id", "ord", payload.alias("payload")).where("payload not in ('', '[DONE]')")
    parsed = data.select("stream_id", "ord", F.from_json("payload", _CHUNK, {"columnNameOfCorruptRecord": "_bad"}).alias("c"))
    good = F.col("c._bad").isNull()
    chunk = F.when(good, F.struct("ord", "c.choices", F.struct("c.id", "c.model", "c.created", "c.usage").alias("meta")))
    streams = parsed.groupBy("stream_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), F.count_if(good).alias("n_chunks"), F.count_if(~good).alias("n_bad"))
    metas = F.transform("chunks", lambda c: c["meta"])
    first = lambda name: F.get(F.filter(F.transform(metas, lambda m: m[name]), lambda v: v.isNotNull()), F.lit(0)).alias(name)
    usage = F.from_json(F.try_element_at(F.filter(F.transform(metas, lambda m: m["usage"]), lambda u: F.length(u) > 2), F.lit(-1)), _USAGE)
    known = F.filter(F.transform("chunks", lambda c: c["choices"]), lambda x: x.isNotNull())
    whole = streams.select("stream_id", "n_chunks", "n_bad", first("id"), first("model"), first("created"), usage.alias("usage"), F.flatten(known).alias("pieces"))
    choices = whole.select("*", F.explode(_indexes(F.col("pieces"))).alias("index")).withColumn("own", _of_index(F.col("pieces"), F.col("index")))
    calls = F.flatten(F.filter(F.transform("own", lambda x: x["delta"]["tool_calls"]), lambda t: t.isNotNull()))
    listed = choices.withColumn("calls", calls)
    own = F.col("own")
    return listed.select(
        "stream_id", "index", F.coalesce(_last(own, lambda x: x["delta"]["role"]), F.lit("assistant")).alias("role"), _joined(own, lambda x: x["delta"]["content"]).alias("content"),
        _joined(own, lambda x: F.coalesce(x["delta"]["reasoning_content"], x["delta"]["reasoning"])).alias("reasoning"), _last(own, lambda x: x["finish_reason"]).alias("finish_reason"),
        _last(own, lambda x: x["stop_reason"], empty=True).alias("stop_reason"), F.when(F.size("calls") > 0, F.transform(_indexes(F.col("calls")), lambda i: _tool_call(F.col("calls"), i))).alias("tool_calls"),
        "n_chunks", "n_bad", "id", "model", "created", "usage",
    )
