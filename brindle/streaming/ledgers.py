"""Streaming forms of ledgers and stream reassembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from brindle.operators.traces import assemble_streams


def ledger_stream(source: DataFrame, path: str, keys: list[str], checkpoint: str, event_time: str | None = None, lateness: str = "1 day") -> StreamingQuery:
    """Append every key of a stream once, to ``path``/batch=N.

    The keys seen are state of the stream, spread by key, so no batch reads the
    ledger; with ``event_time`` they are forgotten after ``lateness``. A batch
    that is run again after a failure replaces what it wrote.
    """
    once = source.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys) if event_time else source.dropDuplicates(keys)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: StructType, glob: str, files_per_batch: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def usage_stream(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(model, n, tokens) running totals of a request stream; rows loaded twice within ``lateness`` count once."""
    once = requests.withWatermark("logged_at", lateness).dropDuplicatesWithinWatermark(["request_id"])
    v = F.try_parse_json("response")
    return once.groupBy(F.try_variant_get(v, "$.model", "string").alias("model")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.try_variant_get(v, "$.usage.prompt_tokens", "long")), F.lit(0)).alias("tokens"))


_HELD = "ords array<bigint>, texts array<string>"
_COMPLETE = "stream_id bigint, ord bigint, line string, complete boolean"


def _until_done(idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Hold a stream's lines in state until its end mark is there or nothing comes any more, then hand them over and forget them."""
        ords, texts = map(list, state.get) if state.exists else ([], [])
        for rows in batches if not state.hasTimedOut else ():
            ords += rows["ord"].tolist()
            texts += rows["line"].tolist()
        done = any(t is not None and t.strip() == "data: [DONE]" for t in texts)
        if done or state.hasTimedOut:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"stream_id": key[0], "ord": ords, "line": texts, "complete": done})
        else:
            state.update((ords, texts))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)

    return step


def complete_streams(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(stream_id, ord, line, complete) of streams as soon as their end mark has arrived, or, with ``idle_ms``, as incomplete after so long without news.

    With ``idle_ms`` a query has to run on (a trigger that ends when nothing is left never ends, as time goes by).

    Open streams stay in the state store, keyed and spread by stream; a stream
    is one response, so its lines are few and soon gone.
    """
    rows = lines.select(F.col("stream_id").cast("long"), F.col("ord").cast("long"), "line")
    return rows.groupBy("stream_id").applyInPandasWithState(_until_done(idle_ms), _COMPLETE, _HELD, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def reassembly_stream(lines: DataFrame, path: str, checkpoint: str, idle_ms: int | None = None) -> StreamingQuery:
    """Reassemble streams when they are complete, or, with ``idle_ms``, idle for too long (complete is false then); a batch that is run again after a failure replaces what it wrote. Without ``idle_ms`` the query ends when all input is read; with it, it runs until stopped."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        ends = rows.groupBy("stream_id").agg(F.bool_or("complete").alias("complete"))
        assemble_streams(rows).join(ends.hint("merge"), "stream_id").write.mode("overwrite").json(f"{path}/batch={number}")
        rows.unpersist()

    writer = complete_streams(lines, idle_ms).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if idle_ms is None else writer.trigger(processingTime=f"{max(1, idle_ms // 4)} milliseconds")).start()
