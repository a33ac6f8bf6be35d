"""Rebuilding conversations: key, secondary sort by seq, finite-state validation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from brindle.llm.chat import chat_rows, is_blank, map_rows, messages_of, reply_of, text_of
from brindle.plans.materialize import materialize

#: A conversation is validated in stretches of so many seq numbers, so that no task holds a long one whole.
STRETCH = 4096
#: The automaton reads one letter a message: s(ystem), u(ser), a(ssistant), o(ther, tools included). A first request ends in OPENED, a later one in TURNED.
_LETTER = {"system": "s", "user": "u", "assistant": "a"}
START, SYSTEM, OPENED, ANSWERED, TURNED, REJECTED = range(6)
_NEXT = {
    START: {"s": SYSTEM},
    SYSTEM: {"u": OPENED},
    OPENED: {"s": OPENED, "u": OPENED, "o": OPENED, "a": ANSWERED},
    ANSWERED: {"s": TURNED, "u": TURNED, "o": TURNED},
    TURNED: {"s": TURNED, "u": TURNED, "o": TURNED, "a": ANSWERED},
    REJECTED: {},
}

_STEP = StructType(
    [
        StructField("request_id", LongType()),
        StructField("episode", StringType()),
        StructField("seq", LongType()),
        StructField("key", LongType()),
        StructField("state", IntegerType()),
        StructField("n", LongType()),
        StructField("answered", LongType()),
        StructField("before", LongType()),
        StructField("said", LongType()),
        StructField("held", LongType()),
        StructField("reply", LongType()),
        StructField("whole", BooleanType()),
    ]
)


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _step(request_id: int, episode: str | None, seq: int | None, request: str | None, response: str | None) -> Iterator[tuple]:
    messages = messages_of(request)
    if messages is not None and len(messages) >= 2 and seq is not None:
        yield _step_of(request_id, episode, seq, messages, reply_of(response)[0])


def _step_of(request_id: int, episode: str | None, seq: int, messages: list[dict], reply: dict | None) -> tuple:
    whole, state, chain, key, answered, before, said = True, START, 0, 0, -1, 0, 0
    for i, m in enumerate(messages):
        role = m.get("role")
        letter = _LETTER.get(role, "o") if isinstance(role, str) else "o"
        state = _NEXT[state].get(letter, REJECTED)
        text = text_of(m.get("content"))
        if letter == "a":
            answered, before, said = i, chain, _signed(text)
        chain = _signed(f"{chain}\n" + json.dumps(m, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
        if i == 1:
            key = chain
        whole &= bool(m.get("tool_calls")) or not is_blank(text)
    answer = text_of(reply.get("content")) if reply else ""
    whole &= reply is not None and (bool(reply.get("tool_calls")) or not is_blank(answer))
    return request_id, episode, seq, key, state, len(messages), answered, before, said, chain, _signed(answer), whole


def conversation_steps(requests: DataFrame) -> DataFrame:
    """One row of fixed size per answered chat request with at least two messages, however long its history is.

    ``held`` hashes all messages in canonical JSON and ``key`` the first two;
    ``answered`` is the position of the last assistant message, ``before`` the
    hash of what precedes it and ``said`` that of its content. So "holds all
    messages of the one before, unchanged, then its reply" compares numbers.
    """
    rows = chat_rows(requests, ["request_id", "episode", "seq", "request", "response"], only_ok=True)
    return map_rows(rows, _step, _STEP).dropDuplicates(["request_id"])


def _follows(earlier: str, now: str) -> F.Column:
    """Whether the transition from the step ``earlier`` to the step ``now`` is allowed: the same history, its reply, and at least one message more."""
    return (
        (F.col(f"{now}.state") == TURNED)
        & (F.col(f"{now}.answered") == F.col(f"{earlier}.n"))
        & (F.col(f"{now}.before") == F.col(f"{earlier}.held"))
        & (F.col(f"{now}.said") == F.col(f"{earlier}.reply"))
    )


def sound_conversations(requests: DataFrame) -> DataFrame:
    """(first_id, last_id, n_messages) of the conversations the automaton accepts.

    Rows of one episode whose requests share their first two messages, ordered
    by seq. Null or invalid requests, other paths and failed attempts take no
    part; rows loaded twice count once; equal seq numbers are ordered by request_id; a blank message without tool calls, a
    missing reply or any forbidden transition rejects the whole conversation.
    The rows of a conversation are sorted in stretches of seq numbers: a
    stretch is checked by itself and the few stretches of one conversation are
    then checked at their seams, so a conversation of any length is split.
    """
    return _accepted(conversation_steps(requests)).select("first_id", "last_id", "n_messages")


def _accepted(rows: DataFrame) -> DataFrame:
    """(episode, key, first_id, last_id, n_messages) of the conversations of these steps that are sound."""
    steps = rows.withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    keys = ["episode", "key"]
    now = F.struct("state", "n", "answered", "before", "said", "held", "reply").alias("now")
    inside = Window.partitionBy(*keys, "stretch").orderBy("seq", "request_id")
    lagged = steps.select(*keys, "stretch", "seq", "request_id", "whole", now).withColumn("earlier", F.lag("now").over(inside))
    accepted = F.coalesce(F.col("whole") & F.when(F.col("earlier").isNull(), F.lit(True)).otherwise(_follows("earlier", "now")), F.lit(False))
    stretches = lagged.withColumn("ok", accepted).groupBy(*keys, "stretch").agg(
        F.bool_and("ok").alias("ok"),
        F.min_by(F.struct("request_id", "now"), F.struct("seq", "request_id")).alias("head"),
        F.max_by(F.struct("request_id", "now"), F.struct("seq", "request_id")).alias("tail"),
    )
    along = Window.partitionBy(*keys).orderBy("stretch")
    joined = stretches.withColumn("earlier", F.lag("tail").over(along)).select(
        *keys, "stretch", "ok", F.col("head.request_id").alias("first_id"), F.col("tail.request_id").alias("last_id"),
        F.col("head.now").alias("now"), F.col("earlier.now").alias("earlier"), F.col("tail.now.n").alias("n"),
    )
    seam = F.when(F.col("earlier").isNull(), F.col("now.state") == OPENED).otherwise(_follows("earlier", "now"))
    return (
        joined.withColumn("ok", F.coalesce(F.col("ok") & seam, F.lit(False)))
        .groupBy(*keys)
        .agg(
            F.bool_and("ok").alias("ok"),
            F.min_by("first_id", "stretch").alias("first_id"),
            F.max_by("last_id", "stretch").alias("last_id"),
            (F.max_by("n", "stretch") + 1).cast("long").alias("n_messages"),
        )
        .where("ok")
        .select(*keys, "first_id", "last_id", "n_messages")
    )


_TURN = StructType(
    [
        StructField("position", LongType()),
        StructField("role", StringType()),
        StructField("text", StringType()),
        StructField("n_tool_calls", LongType()),
    ]
)
_STEP_AND_TURNS = StructType([*_STEP.fields, StructField("turns", ArrayType(_TURN))])


def _step_and_turns(request_id: int, episode: str | None, seq: int | None, request: str | None, response: str | None) -> Iterator[tuple]:
    """The step, and what it adds if its conversation is sound: the messages after the last assistant message, and the reply."""
    messages = messages_of(request)
    if messages is None or len(messages) < 2 or seq is None:
        return
    reply = reply_of(response)[0]
    start = max((i + 1 for i, m in enumerate(messages) if m.get("role") == "assistant"), default=0)
    turns = []
    for i, m in [*enumerate(messages[start:], start), *([(len(messages), {"role": "assistant", **reply})] if reply else [])]:
        calls = m.get("tool_calls")
        turns.append({"position": i, "role": str(m.get("role")), "text": text_of(m.get("content")), "n_tool_calls": len(calls) if isinstance(calls, list) else 0})
    yield *_step_of(request_id, episode, seq, messages, reply), turns


def conversation_messages(requests: DataFrame) -> DataFrame:
    """(first_id, position, role, text, n_tool_calls): every message of the sound conversations, in order.

    A request repeats the history, so each step only contributes what is new in
    it; in a sound conversation these pieces make up the whole. Bodies are
    parsed once, and every text is shuffled once.
    """
    rows = chat_rows(requests, ["request_id", "episode", "seq", "request", "response"], only_ok=True)
    parsed = materialize(map_rows(rows, _step_and_turns, _STEP_AND_TURNS), "steps")
    steps = parsed.drop("turns").dropDuplicates(["request_id"])  # numbers only
    sound = _accepted(steps).select("episode", "key", "first_id")
    joined = steps.select("episode", "key", "request_id").join(sound.hint("merge"), steps["episode"].eqNullSafe(sound["episode"]) & (steps["key"] == sound["key"]))
    members = joined.select("request_id", "first_id")
    own = parsed.select("request_id", "turns").join(members.hint("merge"), "request_id").dropDuplicates(["request_id"])
    return own.select("first_id", F.explode("turns").alias("t")).select("first_id", "t.*")
