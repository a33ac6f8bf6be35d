"""Replies, validation, selection, catalogues, counters and table functions."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions.token_count import register_counters
from brindle.functions.windows_udtf import register_windows
from brindle.operators import replies, report, selection, validation
from brindle.sources import json_lines


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_replay_form(spark):
    call = {"id": "1", "function": {"name": "f", "arguments": '{"a": 1}'}}
    rows = [
        (1, "/v1/chat/completions", 200, json.dumps({"choices": [{"message": {"content": None, "reasoning_content": "r", "tool_calls": [call, {"function": {"arguments": "oops"}}]}, "finish_reason": "stop"}]})),
        (2, "/v1/chat/completions", 200, json.dumps({"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]})),
        (3, "/v1/chat/completions", 200, "<html>"), (4, "/v1/chat/completions", 200, None), (5, "/v1/chat/completions", 500, "{}"), (6, "/v1/chat/completions", 200, '{"choices": []}'),
    ]
    df = spark.createDataFrame(rows, "request_id long, path string, status int, response string")
    got = {r.request_id: tuple(r)[1:] for r in replies.replay_form(df).collect()}
    assert got == {1: ("", True, 2, 1, True), 2: ("x", False, 0, 0, False)}
    assert replies.replay_form(df, drop_cut=False).where("kept").count() == 2


def test_usage_and_text_shapes(spark):
    shapes = [{"usage": {"input_tokens": 3, "output_tokens": 4}}, {"usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 9}}, {"usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 4}}, {}]
    got = []
    for s in shapes:
        i, o, t = replies.usage_of(F.lit(json.dumps(s)))
        got.append(tuple(spark.range(1).select(i, o, t).first()))
    assert got == [(3, 4, 7), (3, 4, 9), (3, 4, 7), (None, None, None)]
    texts = [{"output_text": "a"}, {"output": [{"content": [{"text": "b"}]}]}, {"content": [{"type": "text", "text": "c"}, {"type": "x"}, {"text": "d"}]}, {"choices": [{"message": {"content": "e"}}]}, {}]
    assert [one(spark, replies.response_text(F.lit(json.dumps(t)))) for t in texts] == ["a", "b", "c\nd", "e", None]


def test_config():
    good = {"tasks": {"train": [1, 2], "test": [3], "excluded": [4], "train_candidates": [1, 2, 4]}, "ranking": {"opponents": 6, "train_top": 15, "validation_rank": 16}, "endpoint": "http://127.0.0.1:8000/v1"}
    assert validation.config_errors(good) == []
    bad = {"tasks": {"train": [1, 1, 3], "test": [3], "excluded": [], "train_candidates": [1]}, "ranking": {"opponents": 3, "train_top": 16, "validation_rank": 16}, "endpoint": "http://example.org"}
    assert len(validation.config_errors(bad)) == 6


def test_scalar_validation(spark):
    assert one(spark, validation.number_of(F.lit('{"score": 0.5}'))) == 0.5 and one(spark, validation.number_of(F.lit("2"))) == 2 and one(spark, validation.number_of(F.lit("x"))) is None
    assert one(spark, validation.zero_if_short(F.lit(None).cast("string"), F.lit(1.0))) == 0 and one(spark, validation.zero_if_short(F.lit("ä" * 100), F.lit(1.0))) == 1
    assert one(spark, validation.media_kind(F.unhex(F.lit("89504E470D0A1A0A00")))) == "png" and one(spark, validation.media_kind(F.unhex(F.lit("00")))) is None
    assert one(spark, validation.sibling(F.lit("run_v3"), 0)) == "run" and one(spark, validation.sibling(F.lit("run_v3"), 12)) == "run_v12" and one(spark, validation.sibling(F.lit("run"), 1)) is None
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, s double")
    assert {r.id for r in validation.out_of_range(df, "s", 0, 1).collect()} == {2, 3} and validation.out_of_range(df, "s", 0, 1, F.col("id") > 1).count() == 0
    assert [r.errors for r in validation.mismatches(df, "id", {"id": 1, "s": 0.5}).where("id = 3").collect()] == [["id=3, expected 1", "s=null, expected 0.5"]]


def test_keys(spark):
    assert one(spark, report.comparison_key(F.lit(1), F.lit(2), "champion")) == "champion_v1_vs_v2"
    assert tuple(one(spark, report.parse_key(F.lit("v3_vs_no_harness")))) == ("baseline", None, 3) and tuple(one(spark, report.parse_key(F.lit("champion_v1_vs_v10")))) == ("champion", 1, 10)
    assert one(spark, report.parse_key(F.lit("xv1_vs_v2"))) is None


def test_blocks_of_text(spark):
    assert one(spark, X.trim_block(F.lit("## plan a b c END"), "##", "END")) == "## plan a b c"
    assert one(spark, X.trim_block(F.lit("## END " + "x" * 100), "##", "END")).endswith("x") and one(spark, X.trim_block(F.lit("plan"), "##", "END")) is None
    assert one(spark, X.trim_block(F.lit("## body\nTAIL follows"), "##", "END", F.lit("TAIL follows and more"), probe=12)) == "## body\n".rstrip(" ")
    assert one(spark, X.first_fenced_json(F.lit('```json\n{bad\n```\n```json\n{"a": 1}\n```'))).strip() == '{"a": 1}'
    assert tuple(one(spark, X.first_contained(F.lit("b a b"), [F.lit("c"), F.lit(None).cast("string"), F.lit(""), F.lit("b")]))) == ("b", 2)


def test_selection(spark):
    episodes = spark.createDataFrame([(1, f"e{i}") for i in range(18)] + [(None, "x")], "task int, episode string")
    status = spark.createDataFrame([(f"e{i}", 0 if i else 1, True) for i in range(18)] + [("e3", 0, None)], "episode string, exit_code int, trace_has_success_result boolean")
    pool = selection.completed_pool(episodes, status)
    assert pool.count() == 17
    better = F.when(F.substring("a", 2, 2).cast("int") < F.substring("b", 2, 2).cast("int"), "A").otherwise("B")
    got = selection.rank_and_select(pool, lambda p: p.withColumn("winner", better), 6, 42, 15, 16)
    bands = {r.episode: (r["rank"], r.band) for r in got.collect()}
    assert [b for _, b in sorted(bands.values())] == ["train"] * 15 + ["validation", "none"] and bands["e1"][0] < bands["e17"][0]
    assert selection.split_errors(got).count() == 0
    twice = got.unionByName(got.withColumn("band", F.lit("validation")))
    assert selection.split_errors(twice).count() == 15


def test_catalogues(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("x" * 30)
    (tmp_path / "a" / "b.txt").write_bytes(b"caf\xe9")
    files = json_lines.read_texts(spark, f"file://{tmp_path}")
    assert {r.content for r in files.collect()} == {"x" * 30, "caf�"}
    assert [r.text for r in json_lines.combine_files(files, (".py", ".txt"), 10).collect()] == ["caf�\n" + "x" * 10]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert json_lines.lookup(df, "id", "a").collect()[0].v == 1 and json_lines.expect_count(df, 2, "tasks").count() == 2
    for bad in (lambda: json_lines.lookup(df, "id", "zz"), lambda: json_lines.expect_count(df, 3, "tasks"), lambda: json_lines.expect_count(df.limit(0), 1, "tasks")):
        with pytest.raises(Exception, match="unknown id|expected"):
            bad().collect()


def test_registered_functions(spark):
    register_counters(spark, {"n_tokens": "/opt/tokenizers/byte_bpe_50k.tiktoken"})
    assert [r.n for r in spark.sql("SELECT n_tokens(t) AS n FROM VALUES ('one two three'), (''), (NULL) AS x(t)").collect()] == [3, 0, None]
    register_windows(spark)
    got = spark.sql("SELECT * FROM pack_windows(array(3, 2, 3), array(3, 0, 3), CAST(NULL AS INT), 6, 3)").collect()
    assert [(r["first"], r.end, r.n_tokens, r.n_loss) for r in got] == [(0, 1, 3, 3), (2, 3, 5, 3)]


def test_streams(spark, tmp_path):
    from brindle.streaming import ledgers

    rows = [(1, "m", '{"model": "m", "usage": {"prompt_tokens": 5}}'), (1, "m", '{"model": "m", "usage": {"prompt_tokens": 5}}'), (2, "m", "<html>")]
    df = spark.createDataFrame(rows, "request_id long, x string, response string").withColumn("logged_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    df.write.parquet(f"file://{tmp_path}/in")
    source = ledgers.file_stream(spark, f"file://{tmp_path}/in", df.schema, "*.parquet")
    q = ledgers.usage_stream(source).writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("usage").collect()} == {("m", 1, 5), (None, 1, 0)}


def test_streams_are_held_until_complete(spark, tmp_path):
    from brindle.streaming import ledgers

    schema = "stream_id long, ord long, line string"
    piece = lambda t: 'data: {"choices": [{"index": 0, "delta": {"content": "' + t + '"}}]}'
    first = [(1, 0, piece("a")), (2, 0, piece("x")), (1, 1, piece("b"))]
    second = [(1, 2, "data: [DONE]"), (2, 1, piece("y")), (3, 0, None)]
    source = f"file://{tmp_path}/in"
    out = f"file://{tmp_path}/out"

    def run():
        lines = ledgers.file_stream(spark, source, spark.createDataFrame([], schema).schema, "*.parquet", 1)
        ledgers.reassembly_stream(lines, out, f"file://{tmp_path}/cp").awaitTermination()
        return {(r.stream_id, r.content) for r in spark.read.schema("stream_id long, content string").json(f"{out}/batch=*").collect()}

    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == set()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == {(1, "ab")}
    assert run() == {(1, "ab")}


def test_idle_streams_are_handed_over_as_incomplete(spark, tmp_path):
    import time

    from brindle.streaming import ledgers

    schema = "stream_id long, ord long, line string"
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([(5, 0, 'data: {"choices": [{"delta": {"content": "a"}}]}')], schema).coalesce(1).write.parquet(source)
    lines = ledgers.file_stream(spark, source, spark.createDataFrame([], schema).schema, "*.parquet", 1)
    query = ledgers.reassembly_stream(lines, out, f"file://{tmp_path}/cp", idle_ms=400)
    try:
        for _ in range(60):
            time.sleep(0.5)
            if any(p.stat().st_size for p in tmp_path.glob("out/batch=*/part-*.json")):
                break
    finally:
        query.stop()
    got = {(r.stream_id, r.content, r.complete) for r in spark.read.schema("stream_id long, content string, complete boolean").json(f"{out}/batch=*").collect()}
    assert got == {(5, "a", False)}


def test_ledger_takes_every_key_once(spark, tmp_path):
    from brindle.streaming import ledgers

    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in ([(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(source)
        lines = ledgers.file_stream(spark, source, spark.createDataFrame([], "k long, v string").schema, "*.parquet")
        ledgers.ledger_stream(lines, out, ["k"], f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, spark.read.schema("k long, v string").json(f"{out}/batch=*").collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_means_need_all_rows(spark):
    df = spark.createDataFrame([(True, 1.0), (False, None)], "ok boolean, s double").withColumn("ok", F.col("ok").cast("int"))
    assert tuple(report.complete_means(df, {"ok": "SR", "s": "CBS"}, 2).first()) == (2, 0.5, 0.5)
    with pytest.raises(Exception, match="expected 3 rows, found 2"):
        report.complete_means(df, {"ok": "SR"}, 3).collect()


def test_prompt_variants_and_matches(spark):
    from brindle.operators import prompts as P

    def forms(prompt, sent=None):
        return [(v["mode"], v["text"]) for v in one(spark, P.variants(F.lit(prompt).cast("string"), F.lit(sent).cast("string")))]

    assert forms("do it") == [("exact", "do it")] and forms(None) == [] and forms("") == []
    assert forms(" do it\n", "doit") == [("exact", " do it\n"), ("sent", "doit"), ("strip", "do it")]
    assert forms("use precision@k ") == [("exact", "use precision@k "), ("strip", "use precision@k"), ("metric", "use precision @k")]

    def found(texts, prompt, sent=None):
        return one(spark, P.match(F.array(*map(F.lit, texts)), P.variants(F.lit(prompt), F.lit(sent).cast("string"))))

    assert tuple(found(["a task here"], "task")) == ("task", "exact", 1) and found(["nothing"], "task") is None
    assert tuple(found(["use recall @k now", "x"], "use recall@k "))[1:] == ("metric", 1)
    twice = found(["task", "a task"], "task")
    assert twice.hits == 2
    texts, m = F.array(F.lit("task"), F.lit("a task")), P.match(F.array(F.lit("task"), F.lit("a task")), P.variants(F.lit("task"), F.lit(None).cast("string")))
    with pytest.raises(Exception, match="ambiguous prompt match: 2"):
        spark.range(1).select(P.unambiguous(m)["text"]).collect()
    assert one(spark, P.substitute(texts, m, F.lit("bare"), F.lit(None).cast("string"))) == ["task", "a task"]
    once = P.match(F.array(F.lit("x"), F.lit("my TASK.")), P.variants(F.lit("task"), F.lit("TASK")))
    assert one(spark, P.substitute(F.array(F.lit("x"), F.lit("my TASK.")), once, F.lit("bare"), F.lit("BARE"))) == ["x", "my BARE."]
    docs = spark.createDataFrame([("a", "A"), ("a", "B"), (None, "C")], "original string, sent string")
    got = P.with_sent(spark.createDataFrame([("a",), ("b",), (None,)], "p string"), "p", P.sent_index(docs, "original", "sent"))
    assert {(r.p, r.sent) for r in got.collect()} == {("a", "A"), ("b", None), (None, None)}


def test_replay_message(spark):
    call = {"id": "c1", "type": "", "function": {"name": "f", "arguments": '{"b": 1, "a": [2]}'}}
    bad = {"id": None, "function": {"name": "g", "arguments": "{cut"}}
    body = json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": None, "reasoning_content": "", "tool_calls": [call, bad]}}]})
    rows = [(1, "/v1/chat/completions", 200, body), (1, "/v1/chat/completions", 200, body), (2, "/v1/chat/completions", 200, "{"), (3, "/v1/chat/completions", 200, None), (4, "/v1/chat/completions", 200, '{"choices": [{"message": {}}]}')]
    got = {r.request_id: r for r in replies.replayed(spark.createDataFrame(rows, "request_id long, path string, status int, response string")).collect()}
    assert set(got) == {1, 4} and got[4].message.tool_calls is None and got[4].message.content == ""
    m = got[1].message
    assert (m.role, m.content, m.reasoning_content) == ("assistant", "", None)
    assert [(c.id, c.type, c["name"], c.arguments.toPython()) for c in m.tool_calls] == [("c1", "function", "f", {"b": 1, "a": [2]}), (None, "function", "g", "{cut")]


def test_messages_equal_up_to_the_order_of_keys_only(spark):
    from brindle.operators import threads

    def row(i, *messages):
        return (i, "e", i, "/v1/chat/completions", 200, messages if isinstance(messages, str) else '{"messages": [' + ", ".join(messages) + "]}", '{"choices": [{}]}')

    a, b = '{"role": "system", "content": "s"}', '{"content": "u", "role": "user"}'
    rows = [row(1, a, b), row(2, a, '{"role": "user",  "content": "u"}', '{"role": "assistant", "content": "x", "reasoning_content": "r"}'), row(3, a, b, '{"role": "assistant", "content": "x", "reasoning_content": "other"}', b)]
    df = spark.createDataFrame(rows, "request_id long, episode string, seq long, path string, status int, request string, response string")
    assert {r.request_id: r.segment for r in threads.prefix_segments(df).collect()} == {1: 0, 2: 0, 3: 1}
    import hashlib

    asked = [["plain \"quoted\"\nü", json.dumps("plain \"quoted\"\nü", ensure_ascii=False)], [[{"type": "text", "text": "é"}], json.dumps([{"type": "text", "text": "é"}], ensure_ascii=False)]]
    for content, written in asked:
        df2 = spark.createDataFrame([row(1, a, json.dumps({"role": "user", "content": content}))], df.schema)
        assert threads.thread_keys(df2).first().thread_key == hashlib.md5(("s\x00" + written).encode()).hexdigest()[:10]


def test_command_line(spark, tmp_path, capsys):
    from brindle.__main__ import main

    main(["list"])
    assert "window_tokens" in capsys.readouterr().out.split()
    args = ["render", "/root/testdata/sf0.001", f"file://{tmp_path}/out", "--window", "2400", "--overlap", "400"]
    main(args)
    assert spark.read.parquet(f"file://{tmp_path}/out/windows").count() > 0 and "loss_tokens" in capsys.readouterr().out
    with pytest.raises(Exception, match="already exists"):
        main(args)
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "a", "b"])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from brindle.plans.materialize import shared_dir

    def session(master, named=None):
        conf = SimpleNamespace(get=lambda key, default=None: named or default)
        sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda key, default=None: default), getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None, master=master)
        return SimpleNamespace(conf=conf, sparkContext=sc)

    assert shared_dir(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert all(shared_dir(session(m)).startswith("file:///") for m in ("local", "local[4]", "local-cluster[3,2,1000]"))
    for master in ("spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_finished_rounds_are_deleted(spark):
    from brindle.plans.materialize import discard, materialize

    df = materialize(spark.range(5), "round")
    path = df._brindle_path.removeprefix("file://")
    import os

    assert os.path.exists(path) and df.count() == 5
    discard(df)
    discard(df)
    discard(None)
    assert not os.path.exists(path)
