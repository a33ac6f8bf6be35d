import json

from brindle.llm import conversations as C

SCHEMA = "request_id long, episode string, seq long, path string, status int, request string, response string, prefix string, reply string"
S, U = {"role": "system", "content": "be good"}, {"role": "user", "content": "task"}


def a(text, calls=None):
    return {"role": "assistant", "content": text, **({"tool_calls": calls} if calls else {})}


def t(text):
    return {"role": "tool", "content": text, "tool_call_id": "1"}


def row(i, seq, messages, reply, episode="e", status=200, raw=None):
    response = raw if raw is not None else json.dumps({"choices": [{"message": reply, "finish_reason": "stop"}]})
    return (i, episode, seq, "/v1/chat/completions", status, json.dumps({"messages": messages}), response, "x", "y")


def found(spark, rows):
    return sorted(map(tuple, C.sound_conversations(spark.createDataFrame(rows, SCHEMA)).collect()))


CALL = [{"id": "1", "function": {"name": "f", "arguments": "{}"}}]


def test_sound(spark):
    m1 = [S, U]
    m2 = [*m1, a("", CALL), t("out")]
    m3 = [*m2, a("done"), {"role": "user", "content": [{"type": "text", "text": "more"}]}]
    rows = [row(3, 30, m3, a("bye")), row(1, 10, m1, a(None, CALL)), row(2, 20, m2, a("done")), row(2, 20, m2, a("done"))]
    assert found(spark, rows) == [(1, 3, 7)]
    turns = C.conversation_messages(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert [r.role for r in turns] == ["system", "user", "assistant", "tool", "assistant", "user", "assistant"] and turns[5].text == "more"


def test_rejected(spark):
    later = [S, U, a("x"), t("o")]
    cases = {
        "a": [row(1, 1, [U, S], a("x"), "e1")],
        "starts late": [row(2, 1, later, a("x"), "e2")],
        "gap": [row(3, 1, [S, U], a("x"), "e3"), row(4, 2, [*later, a("y"), t("o")], a("z"), "e3")],
        "changed reply": [row(5, 1, [S, U], a("other"), "e4"), row(6, 2, later, a("z"), "e4")],
        "nothing new": [row(7, 1, [S, U], a("x"), "e5"), row(8, 2, [S, U, a("x")], a("z"), "e5")],
        "blank message": [row(9, 1, [S, {"role": "user", "content": " ​"}], a("x"), "e6")],
        "blank reply": [row(10, 1, [S, U], a(" ﻿"), "e7")],
        "no reply": [row(11, 1, [S, U], None, "e8", raw="<html>")],
        "null reply": [row(12, 1, [S, U], None, "e9")],
        "one message": [row(13, 1, [S], a("x"), "e10")],
        "two new assistants": [row(14, 1, [S, U], a("x"), "e11"), row(15, 2, [*later, a("y"), t("o")], a("z"), "e11")],
    }
    assert found(spark, [r for c in cases.values() for r in c]) == []


def test_interleaved_and_dirt(spark):
    other = {"role": "user", "content": "other task"}
    rows = [row(1, 1, [S, U], a("x")), row(2, 2, [S, other], a("y")), row(3, 3, [S, U, a("x"), t("o")], a("z")), row(4, 4, [S, U], a("x"), status=500)]
    rows += [(5, "e", 5, "/v1/chat/completions", 200, None, None, "", ""), (6, None, None, None, None, None, None, None, None), (7, "e", 6, "/v1/chat/completions", 200, "{", "{}", "", "")]
    assert found(spark, rows) == [(1, 3, 5), (2, 2, 3)]
    assert found(spark, rows[:0] + [(None, None, None, None, None, None, None, None, None)]) == []


def test_long_conversation_crosses_stretches(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 4)
    messages, rows = [S, U], []
    for k in range(15):
        rows.append(row(100 + k, k, messages, a(f"r{k}")))
        messages = [*messages, a(f"r{k}"), t(f"o{k}")]
    assert found(spark, rows) == [(100, 114, 31)]
    broken = [r for r in rows if r[0] != 108]
    assert found(spark, broken) == []
