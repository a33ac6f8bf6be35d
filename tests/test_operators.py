"""Properties and edge cases of the core operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from brindle.functions import text as X
from brindle.operators import checks, evidence, history, matches, packing, report, threads, traces, training
from brindle.sources import json_lines, sinks


def test_tournament_is_regular_and_connected(spark):
    df = spark.createDataFrame([(1, f"e{i}") for i in range(18)] + [(2, "x"), (2, "y"), (3, "alone")], "task int, episode string")
    pairs = [(r.a, r.b) for r in matches.tournament(df, "task", "episode", 6, 42).where("task = 1").collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs}) == 54
    degree = {n: sum(n in p for p in pairs) for n in {x for p in pairs for x in p}}
    assert set(degree.values()) == {6} and len(degree) == 18
    reached, todo = set(), ["e0"]
    while todo:
        n = todo.pop()
        if n not in reached:
            reached.add(n)
            todo += [b if a == n else a for a, b in pairs if n in (a, b)]
    assert len(reached) == 18
    assert matches.tournament(df, "task", "episode", 6, 42).where("task = 2").count() == 1
    with pytest.raises(ValueError):
        matches.tournament(df, "task", "episode", 3, 42)


def test_ratings_order_and_ties():
    a, b, c = matches.strengths(np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([3.0, 3.0, 3.0]), 3)
    assert a > b > c
    x, y = matches.strengths(np.array([0, 1]), np.array([1, 0]), np.array([0.5, 0.5]), 2)
    assert x == pytest.approx(y)
    rng = np.random.default_rng(0)
    wins = rng.integers(0, 5, (6, 6)).astype(float)
    np.fill_diagonal(wins, 0)
    p, games = np.ones(6), wins + wins.T
    for _ in range(500):  # the same rule on the whole matrix
        p = (wins.sum(axis=1) + 0.5) / (0.5 / (p + 1) + (games / (p[:, None] + p[None])).sum(axis=1))
        p /= p.mean()
    i, j = np.nonzero(wins)
    assert np.allclose(matches.strengths(i, j, wins[i, j], 6), np.log(p))


def test_rating_table(spark):
    rows = [(1, "t", "a", "b", "A"), (1, "t", "a", "b", "A"), (2, "t", "b", "a", " b "), (3, "t", "a", "a", "A"), (4, "t", None, "b", "A"), (5, None, "a", "b", "A"), (6, "u", "a", "b", None)]
    df = spark.createDataFrame(rows, "match_id long, task string, a string, b string, winner string")
    got = {(r.task, r.item): r.rating for r in matches.ratings(df, "task").collect()}
    assert got["t", "a"] > got["t", "b"] and got["u", "a"] == got["u", "b"] and len(got) == 4
    assert matches.ratings(df.limit(0), "task").count() == 0


def brute_windows(body, header, window, overlap):
    """The packing rule read block by block, as an independent check."""
    out = []
    query = next((k for k, b in enumerate(body) if b["query"]), None)
    i = 0
    while i < len(body):
        if not body[i]["loss"]:
            i += 1
            continue
        context, total = [], 0
        for k in reversed(range(i)):
            if total + body[k]["n"] > overlap:
                break
            context.append(k)
            total += body[k]["n"]
        if query is not None and query < i and query not in context:
            context.append(query)
        free = window - header - sum(body[k]["n"] for k in context)
        if body[i]["n"] > free:
            if body[i]["n"] > window - header:
                i += 1
                continue
            alone = query is not None and query < i and body[query]["n"] + body[i]["n"] <= window - header
            context = [query] if alone else []
            free = window - header - sum(body[k]["n"] for k in context)
        end, size = i, 0
        for k in range(i, len(body)):
            size += body[k]["n"]
            if size > free:
                break
            if body[k]["loss"]:
                end = k
        out.append((i, end + 1, len(context), header + sum(body[k]["n"] for k in context) + sum(b["n"] for b in body[i : end + 1]), sum(b["loss"] for b in body[i : end + 1])))
        i = end + 1
    return out


def test_windows_equal_brute_force_and_train_every_block_once(spark):
    rng = random.Random(4)
    rows, expected, block_id = [], {}, 0
    for t in range(40):
        sizes = [rng.randint(1, 9) for _ in range(2)]
        blocks = [("system", 0, sizes[0], False), ("user", 0, sizes[1], True)]
        for seg in range(rng.randint(1, 3)):
            if seg:
                blocks.append(("user", seg, rng.randint(1, 30), True))
            for _ in range(rng.randint(0, 12)):
                blocks.append((rng.choice(["assistant", "tool"]), seg, rng.choice([1, 3, 8, 20, 60]), False))
        body = [{"n": n, "loss": n - 1 if kind == "assistant" else 0, "query": q, "seg": seg} for kind, seg, n, q in blocks[2:]]
        for seg in {b["seg"] for b in body}:
            part = [{**b, "loss": b["loss"] if b["seg"] == seg else 0, "query": b["query"] and b["seg"] == seg} for b in body if b["seg"] <= seg]
            expected["e", f"t{t}", seg] = [(i + 2, e + 2, *rest) for i, e, *rest in brute_windows(part, sum(sizes), 60, 12)]
        for no, (kind, seg, n, q) in enumerate(blocks):
            block_id += 1
            mask = [0] + [1] * (n - 1) if kind == "assistant" else [0] * n
            rows += [(block_id, "e", f"t{t}", seg, no, kind, q, [7] * n, mask, 5)] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "block_id long, episode string, thread string, segment int, block_no int, kind string, is_query boolean, ids array<int>, mask array<int>, n int")
    got = {}
    for r in packing.pack_windows(df, 60, 12).orderBy("thread", "segment", "window_no").collect():
        got.setdefault((r.episode, r.thread, r.segment), []).append((r.first_block, r.end_block, r.n_context, r.n_tokens, r.n_loss_tokens))
        assert r.n_tokens <= 60
    assert got == {k: v for k, v in expected.items() if v}


def test_windows_dirt(spark):
    schema = "block_id long, episode string, thread string, segment int, block_no int, kind string, is_query boolean, ids array<int>, mask array<int>"
    good = [(1, "e", "t", 0, 0, "system", False, [1], [0]), (2, "e", "t", 0, 1, "user", True, [1], None), (3, "e", "t", 0, 2, "assistant", None, [1, 2], [1, 1]), (4, "e", "t", 0, 3, None, None, None, None), (5, "e", "t", 0, 4, "assistant", False, [1, 2], [1])]
    headless = [(6, "e", "u", 0, 2, "assistant", False, [1], [1]), (None, "e", "t", 0, 5, "assistant", False, [1], [1]), (7, None, "t", 0, 5, "assistant", False, [1], [1])]
    df = spark.createDataFrame(good + headless, schema)
    assert [(r.first_block, r.end_block, r.n_loss_tokens) for r in packing.pack_windows(df, 10, 3).collect()] == [(2, 3, 2)]
    assert packing.pack_windows(df.limit(0), 10, 3).count() == 0
    plan = packing.plan_windows(df, 10, 3)
    assert [(r.thread, r.n_tokens) for r in plan.where("kind = 'error'").collect()] == [("u", 0)]
    assert packing.plan_windows(df, 2, 1).where("kind = 'error'").count() == 2  # the header alone is too long
    assert [(r.first_block, r.n_tokens) for r in packing.plan_windows(df, 3, 1).where("kind = 'skipped'").collect()] == [(2, 2)]
    got = packing.render_windows(df, plan).collect()
    assert [(r.input_ids, r.labels, r.ctx_blocks, r.loss_blocks) for r in got] == [([1, 1, 1, 2], [-100, -100, 1, 2], [], [2])]
    totals = {r.episode: r for r in packing.render_statistics(plan).collect()}
    assert (totals["e"].windows, totals["e"].errors, totals[None].loss_tokens, totals[None].threads) == (1, 1, 2, 2)


def test_every_loss_token_is_learned_once(spark):
    kinds = [([1, 2], 0), ([3, 4], 0), ([10, 11, 12], 1), ([20, 21], 0), ([30, 31, 32], 1)]
    rows = [(k, "e", "t", 0, k, False, ids, [m] * len(ids)) for k, (ids, m) in enumerate(kinds)]
    df = spark.createDataFrame(rows, "block_id long, episode string, thread string, segment int, block_no int, is_query boolean, ids array<int>, mask array<int>")
    windows, _ = packing.rendered(df, 10, 3)
    got = windows.orderBy("window_no").collect()
    assert len(got) == 2 and [x for r in got for x in r.labels if x != packing.IGNORE] == [10, 11, 12, 30, 31, 32]
    assert all(len(r.input_ids) == r.n_tokens <= 10 and len(r.labels) == r.n_tokens for r in got) and got[1].ctx_blocks == [3]


@pytest.mark.parametrize("baseline,rounds,want", [
    (False, [(0, "tie", None), (1, "A", None), (2, "tie", None)], (0, False, False)),
    (False, [(0, None, None), (1, "B", None), (2, "B", None)], (2, True, False)),
    (False, [(0, None, None), (1, "B", None), (2, "A", None), (3, "B", None)], (1, True, True)),
    (False, [(0, None, None), (1, "B", None), (2, "A", None), (3, "B", {1: "B"})], (3, True, False)),
    (False, [(0, None, None), (1, "B", None), (2, "A", None), (3, "B", None), (4, "A", None)], (1, True, False)),
    (True, [(0, "A", None), (1, "A", None)], (0, False, False)),
    (True, [(0, "B", None), (1, "A", None)], (0, True, False)),
    (True, [(0, "A", None), (1, "B", None), (2, "B", None)], (1, True, True)),
    (True, [(0, "A", None), (1, "B", None), (2, "B", {1: "A"})], (1, True, False)),
    (True, [(0, "A", None), (1, "B", None), (2, "B", {1: "B"})], (2, True, False)),
])
def test_champions(spark, baseline, rounds, want):
    df = spark.createDataFrame([("k", *r) for r in rounds], "key string, version long, winner string, arbitration map<long,string>")
    r = history.champions(df, "key", baseline).collect()[0]
    assert (r.champion, r.has_win, r.needs) == want


def test_scoreboard(spark):
    df = spark.createDataFrame([("k", 0, "B"), ("k", 1, "A"), ("k", 3, "tie")], "key string, version int, winner string")
    assert history.scoreboards(df, "key").collect()[0].board == "v0 W · v1 L · v2 ? · v3 T"


def test_skip_greedy(spark):
    df = spark.createDataFrame([("a", 1, 6), ("a", 2, 9), ("a", 3, 4), ("a", 4, None), ("b", 1, 11)], "key string, at long, n long")
    assert {(r.at, r.used) for r in evidence.skip_greedy(df, "key", "at", "n", 10).collect()} == {(1, 6), (3, 10)}


def brute_tree(paths, entries, depth, children):
    """All lines of the whole tree first, as (text, takes an entry, is a folder), cut to the budget afterwards."""
    root = {}
    for p in paths:
        node = root
        for x in filter(None, p.split("/")):
            node = node.setdefault(x, {})

    def below(node, level):
        names = [x for x in node if not (node[x] and x in evidence.SKIPPED_FOLDERS)] if level <= depth else []
        if len(names) > children:
            return [("  " * level + f"... [contents omitted: {len(names)} entries exceed per-directory limit {children}]", False, False)]
        out = []
        for x in sorted(names, key=lambda x: (not node[x], x.lower(), x)):
            ext = "." + x.rpartition(".")[2].lower()
            mark = "/" if node[x] else f"  [{ext} binary/large]" if x.rpartition(".")[0] and ext in evidence.BINARY_SUFFIXES else ""
            out += [("  " * level + x + mark, True, bool(node[x])), *below(node[x], level + 1)]
        return out

    lines = below(root, 1)
    at = [k for k, (_, counts, _) in enumerate(lines) if counts]
    if len(at) < entries:
        return [t for t, *_ in lines]
    last = at[entries - 1]
    cut = len(at) > entries or lines[last][2]
    return [t for t, *_ in lines[: last + 1]] + ["... (tree truncated)"] * cut


def test_tree_equals_a_walk(spark):
    rng = random.Random(11)
    trees = {}
    for t in range(30):
        names = ["a", "B", "c.py", "D.PNG", "e.md", ".git", "venv", "f", "Z.txt"][: rng.randint(3, 9)]
        trees[f"k{t}"] = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 40))}
    df = spark.createDataFrame([(k, p) for k, v in trees.items() for p in v for _ in range(rng.randint(1, 2))] + [("none", None), ("none", "")], "key string, path string")
    got = {}
    for r in evidence.tree_listing(df, "key", entries=12, depth=3, children=5).orderBy("key", "line").collect():
        got.setdefault(r.key, []).append(r.text)
    assert got == {k: brute_tree(v, 12, 3, 5) for k, v in trees.items() if brute_tree(v, 12, 3, 5)}
    assert any("truncated" in x for v in got.values() for x in v) and any("omitted" in x for v in got.values() for x in v)
    assert evidence.first_test_file(spark.createDataFrame([("k", "tests/test_b.py"), ("k", "tests/test_a.py"), ("k", "tests/x/test_0.py"), ("l", "main.py")], "key string, path string"), "key").collect() == [("k", "tests/test_a.py")]


def test_numbering_splits_keys(spark):
    from brindle.plans.ranges import numbered

    rows = [(k, i, i * i) for k, n in (("hot", 400), ("b", 3), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, at long, v long").repartition(7)
    got = {(r.key, r["at"]): (r.position, r.total, r.before_v) for r in numbered(df, "key", "at", ("v",)).collect()}
    size = {"hot": 400, "b": 3, None: 5}
    assert got == {(k, i): (i + 1, size[k], (i - 1) ** 2 if i else None) for k, i, _ in rows}
    assert numbered(df.limit(0), "key", "at").count() == 0


def test_win_rate_without_decision_is_null(spark):
    df = spark.createDataFrame([(1, "x", "tie"), (2, "x", None)], "match_id long, g string, winner string")
    r = matches.win_rates(df, "g").collect()[0]
    assert (r.wins, r.losses, r.ties, r.win_rate) == (0, 0, 2, None)


def test_trials(spark):
    df = spark.createDataFrame([("g", 1, 1, "a", 0.5), ("g", 1, 1, "b", 1.0), ("h", 1, 1, "a", 0.0), ("h", 2, 1, "a", 1.0)], "grp string, trial int, task int, judge string, score double")
    got = {r.grp: (r["mean"], r.sd, r.n_trials) for r in report.trial_rollup(df).collect()}
    assert got["g"] == (0.75, None, 1) and got["h"][1] == pytest.approx(math.sqrt(0.5), abs=1e-6)
    assert {tuple(r.missing) for r in report.missing_judges(df, ["a", "b"]).collect()} == {("b",)}


def test_keyed_pairs_refuses_repeats_and_gaps(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "task int, replicate int, u string")
    b = spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "task int, replicate int, v string")
    assert report.keyed_pairs(a, b, ["task", "replicate"]).count() == 2
    for x, y in ((a, b.limit(1)), (a.union(a), b)):
        with pytest.raises(Exception, match="keys differ or repeat"):
            report.keyed_pairs(x, y, ["task", "replicate"]).collect()


def test_best_checkpoint(spark):
    log = spark.createDataFrame([(0, 0.1), (150, 2.0), (300, 1.0), (450, 0.2)], "step long, val_loss double")
    saved = spark.createDataFrame([(150,), (300,), (0,)], "step long")
    assert tuple(training.best_checkpoint(log, saved).collect()[0]) == (300, 1.0)
    bad = log.union(spark.createDataFrame([(150, float("nan"))], log.schema))
    with pytest.raises(Exception, match="not finite"):
        training.best_checkpoint(bad, saved).collect()
    assert training.total_steps(10, 0.1, 100) == 1 and training.total_steps(10, 3, 4) == 8


def test_trace_rules(spark):
    rows = [(1, 0, True, None), (2, 0, None, None), (3, 1, None, "x"), (4, 124, False, None), (5, 1, False, "[API Error: Connection error."), (6, None, None, None)]
    df = spark.createDataFrame([(i, c, s, ("e", m, [("t1", "a"), ("t2", "b" * 300)])) for i, c, s, m in rows], "status_id long, exit_code int, trace_has_success_result boolean, failure struct<subtype:string,message:string,last_tool_calls:array<struct<tool:string,args:string>>>")
    got = {r.status_id: (r.completed, r.failed, r.outcome) for r in traces.classify_runs(df).collect()}
    assert got == {1: (True, False, "success"), 2: (False, False, "unknown"), 3: (False, True, "failure"), 4: (False, True, "timeout"), 5: (False, True, "infra_error"), 6: (False, False, "unknown")}
    assert traces.classify_runs(df).first().last_tools == "t2 " + "b" * 200 + "|t1 a"
    events = spark.createDataFrame([("k", 1, "success"), ("k", 2, "error"), ("m", 1, "other")], "key string, at long, kind string")
    assert {tuple(r) for r in traces.last_any_success(events, "key", "at").collect()} == {("k", True, False), ("m", False, False)}


def test_stream_reassembly(spark):
    def chunk(index, **delta):
        import json

        finish = delta.pop("finish", None)
        return "data: " + json.dumps({"id": "i", "model": "m", "choices": [{"index": index, "delta": delta, "finish_reason": finish}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}})

    call = lambda i, name, args: [{"index": i, "id": f"c{i}", "function": {"name": name, "arguments": args}}]
    lines = [": comment", chunk(0, role="assistant", content="Hel"), chunk(1, content="B"), "data: {bad", chunk(0, content="lo", finish="stop"), chunk(1, tool_calls=call(0, "f", "{")), chunk(1, tool_calls=call(1, "g", "[]")), chunk(1, tool_calls=call(0, None, "}")), "data: [DONE]", ""]
    df = spark.createDataFrame([(9, k, x) for k, x in enumerate(lines)], "stream_id long, ord long, line string")
    got = {r["index"]: r for r in traces.assemble_streams(df.repartition(3)).collect()}
    assert got[0].content == "Hello" and got[0].finish_reason == "stop" and got[0].role == "assistant" and got[0].tool_calls is None
    assert got[1].content == "B" and [(c["name"], c["arguments"]) for c in got[1].tool_calls] == [("f", "{}"), ("g", "[]")]
    assert [(c["id"], c["type"]) for c in got[1].tool_calls] == [("c0", "function"), ("c1", "function")] and got[0].reasoning is None and got[0].stop_reason is None
    assert got[0].n_bad == 1 and got[0].n_chunks == 6 and got[0].id == "i" and got[0].usage.prompt_tokens == 3
    assert traces.assemble_streams(df.limit(0)).count() == 0
    more = ['data: {"choices": [{"delta": {"reasoning": "why ", "content": ""}}]}', 'data: {"choices": [{"delta": {"reasoning_content": "not"}, "stop_reason": ""}], "usage": {}}', 'data: {"choices": null}\r', "data: 5"]
    only = traces.assemble_streams(spark.createDataFrame([(1, k, x) for k, x in enumerate(more)], "stream_id long, ord long, line string")).first()
    assert (only.content, only.reasoning, only.stop_reason, only.usage, only.role, only.n_chunks) == (None, "why not", "", None, "assistant", 3)


LINE = StructType([StructField("k", LongType()), StructField("v", StringType())])


def test_json_modes(spark, tmp_path):
    p = tmp_path / "ledger.jsonl"
    p.write_text('{"k": 1, "v": "a"}\n\n{"k": 2\n{"k": 3, "v": null}\n')
    path = f"file://{p}"
    assert {r.k for r in json_lines.read_lines(spark, path, LINE, "skip").collect()} == {1, 3}
    assert json_lines.read_lines(spark, path, LINE, "count").cache().where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        json_lines.read_lines(spark, path, LINE).collect()
    assert json_lines.read_lines(spark, f"file://{tmp_path}/none", LINE).count() == 0
    with pytest.raises(ValueError):
        json_lines.read_lines(spark, path, LINE, "other")
    files = spark.createDataFrame([("a.jsonl",), ("a.jsonl.gz",), ("b.jsonl",), ("x/run_1.py",), ("main.py",), ("domain.py",)], "path string")
    assert {r.path for r in json_lines.prefer_compressed(files).collect()} >= {"a.jsonl.gz", "b.jsonl"}
    assert [r.path for r in json_lines.entry_scripts(files).collect()] == ["main.py", "x/run_1.py"]


def test_sinks(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], LINE)
    sinks.append_new(df, f"{base}/l", ["k"])
    sinks.append_new(df.union(spark.createDataFrame([(3, "c")], LINE)), f"{base}/l", ["k"])
    assert sorted(r.k for r in json_lines.read_lines(spark, f"{base}/l", LINE).collect()) == [1, 2, 3]
    sinks.write_once(df, f"{base}/once")
    sinks.write_once(df.repartition(3), f"{base}/once")
    with pytest.raises(ValueError):
        sinks.write_once(df.limit(1), f"{base}/once")
    sinks.upsert(df.limit(2), f"{base}/table", ["k"])
    sinks.upsert(spark.createDataFrame([(2, "new"), (5, "e")], LINE), f"{base}/table", ["k"])
    assert [tuple(r) for r in spark.read.parquet(f"{base}/table").orderBy("k").collect()] == [(1, "a"), (2, "new"), (5, "e")]
    sinks.write_json_file(df.limit(1), f"{base}/one.json")
    assert (tmp_path / "one.json").read_text().strip() == '{"k":1,"v":"a"}'
    sinks.write_json_file(spark.createDataFrame([(7, "z")], LINE), f"{base}/one.json")
    assert (tmp_path / "one.json").read_text().strip() == '{"k":7,"v":"z"}'


def test_a_crash_between_the_renames_loses_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], LINE), path, ["k"])
    done = []

    def once(fs, p, source, target):
        if done:
            raise OSError("lost")
        done.append(rename(fs, p, source, target))

    rename = sinks._rename
    with monkeypatch.context() as m:
        m.setattr(sinks, "_rename", once)
        with pytest.raises(OSError, match="lost"):
            sinks.upsert(spark.createDataFrame([(2, "new")], LINE), path, ["k"])
    assert not (tmp_path / "table").exists()
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, "a"), (2, "b")]
    sinks.upsert(spark.createDataFrame([(2, "new")], LINE), path, ["k"])
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, "a"), (2, "new")]
    (tmp_path / "table").rename(tmp_path / "table.old")
    sinks.replace_table(spark.createDataFrame([(9, "x")], LINE), path)
    assert [tuple(r) for r in sinks.read_table(spark, path).collect()] == [(9, "x")] and not (tmp_path / "table.old").exists()


def test_guards_broadcast_no_table(spark):
    df = spark.range(1000).withColumn("v", F.lit("x"))
    for got in (json_lines.expect_count(df, 1000, "rows"), json_lines.lookup(df, "v", "x")):
        assert got.count() == 1000
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "BroadcastExchange" not in plan


def test_texts(spark):
    df = spark.createDataFrame([(1, "Result: ok.\n\n```json\n{\"a\": 1}\n```"), (2, '{"a": 1}'), (3, "no"), (4, 'x {"a": 1} y'), (5, None), (6, "")], "id int, text string")
    got = {r.id: r.part for r in df.select("id", X.json_candidate(F.col("text")).alias("part")).collect()}
    assert got[2] == "whole" and got[3] == "none" and got[4] == "braces" and got[1] in ("braces", "fenced")
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(X.normalise_id(F.lit("03"))) == one(X.normalise_id(F.lit("query3"))) == "query_3" and one(X.normalise_id(F.lit("abc"))) == "query_abc"
    with pytest.raises(Exception, match="empty id"):
        one(X.normalise_id(F.lit(" ")))
    assert one(X.folder_id(F.lit("/a/query_12_x"))) == "12" and one(X.folder_id(F.lit("/a/7-run"))) == "7" and one(X.folder_id(F.lit("/a/none"))) is None
    assert one(X.shorten(F.lit("a  b\n" * 50), 10)) == "a b a b..." and one(X.replace_first(F.lit("aXbX"), F.lit("X"), F.lit("-"))) == "a-bX"
    assert one(X.unsafe_path(F.lit("a/../b"))) and one(X.unsafe_path(F.lit("/a"))) and not one(X.unsafe_path(F.lit("a/b..c")))
    assert one(threads.role_of_thread(F.lit("You are a general-purpose subagent."))) == "worker"


def test_checks(spark):
    df = spark.createDataFrame([(1, "mail me: a.b@example.org"), (2, "/home/user/x"), (3, "fine"), (4, None)], "id int, text string")
    assert {tuple(r) for r in checks.leaks(df, "id", ("FINE",)).collect()} == {(1, "email"), (2, "home_path"), (3, "denied:FINE")}
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert [r.k for r in checks.overlap(a, b, "k").collect()] == [2]
    assert {tuple(r) for r in checks.unequal(a, b, "k").collect()} == {(1, "left"), (3, "right")}
    assert [r.k for r in checks.outside(a, b, "k").collect()] == [1] and checks.outside(a.limit(0), b, "k", 5).count() == 0
    assert checks.unions_differ([a, b], spark.range(1, 4).withColumnRenamed("id", "k"), "k").count() == 0
    files = spark.createDataFrame([("r/a.json",), ("r/raw.json",), ("b.json",)], "path string")
    assert {r.path for r in json_lines.excluding(files, {"raw.json"}, ("b.json",)).collect()} == {"r/a.json"} and json_lines.excluding(files).count() == 3


def test_longest_prefix_takes_the_longest(spark):
    df = spark.createDataFrame([("Alpha-Mini-2",), ("alpha-x",), ("beta",), (None,)], "m string")
    got = [r.rate for r in report.longest_prefix(df, "m", [("alpha", 1.0), ("alpha-mini", 2.0)]).collect()]
    assert got == [2.0, 1.0, None, None]


def test_order_of_rows_does_not_matter(spark):
    rows = [("k", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, at long, n long")
    a = evidence.skip_greedy(df, "key", "at", "n", 700).orderBy("at").collect()
    assert a == evidence.skip_greedy(df.orderBy(F.rand(1)).repartition(5), "key", "at", "n", 700).orderBy("at").collect()
