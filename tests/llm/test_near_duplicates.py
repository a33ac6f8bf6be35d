import json
import random

import numpy as np
import pytest

from brindle.llm import near_duplicates as N

SCHEMA = "request_id long, path string, status int, request string, words string, set_no string, band string"


def request(prompt, extra=()):
    return json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": prompt}, *extra]})


def table(spark, rows):
    return spark.createDataFrame([(i, "/v1/chat/completions", 200, r, "x", None, "y") for i, r in rows], SCHEMA)


def brute(prompts):
    sets = {i: set(N.words_of(p)) for i, p in prompts.items()}
    sets = {i: w for i, w in sets.items() if len(w) >= N.MIN_WORDS}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"]
    prompts = {}
    for i in range(0, 300, 3):
        base = rng.sample(words, rng.randint(5, 60))
        prompts[i] = " ".join(base)
        prompts[i + 1] = " ".join(base[1:] + ["new"])
        rng.shuffle(base)
        prompts[i + 2] = ", ".join(base).upper()
    got = N.near_duplicate_openings(table(spark, [(i, request(p)) for i, p in prompts.items()])).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(prompts)


def test_dirt(spark):
    p = "alpha beta gamma delta epsilon"
    rows = [
        (1, request(p)), (1, request(p)), (2, request([{"type": "text", "text": "Alpha beta"}, {"type": "text", "text": "gamma delta epsilon"}])),
        (3, None), (4, ""), (5, "{"), (6, request("too few words")), (7, request(p, [{"role": "assistant", "content": "x"}])), (8, request(p, [{"role": "user", "content": "x"}])),
        (9, request(None)), (10, "[]"), (11, json.dumps({"messages": [1]})), (12, request("word " * 50000)), (None, request(p)),
    ]
    df = table(spark, rows)
    assert set(map(tuple, N.near_duplicate_openings(df).collect())) == {(1, 2)}
    got = {r.request_id: (r.class_id, r.n_links) for r in N.duplicate_classes(df).collect()}
    assert got == {1: (1, 0), 2: (1, 0)}
    assert N.near_duplicate_openings(df.limit(0)).count() == 0 and N.duplicate_classes(df.limit(0)).count() == 0


def test_classes_follow_chains(spark):
    words = [f"t{i}" for i in range(30)]
    rows = [(k, request(" ".join(words[k : k + 20]))) for k in range(8)]
    got = N.duplicate_classes(table(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 8


def test_hot_group(spark):
    rows = [(i, request("the same prompt for every single run " + ("" if i % 2 else "x" * (i % 7)))) for i in range(120)]
    prompts = {i: json.loads(r)["messages"][1]["content"] for i, r in rows}
    assert set(map(tuple, N.near_duplicate_openings(table(spark, rows)).collect())) == brute(prompts)


def test_small_blocks_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(30)]
    prompts = {i: " ".join(base if i % 3 else [*base, f"v{rng.randrange(25)}"]) for i in range(60)}
    prompts |= {100 + i: " ".join(rng.sample(base, 26)) for i in range(20)}
    got = N.near_duplicate_openings(table(spark, [(i, request(p)) for i, p in prompts.items()])).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(prompts)


def test_no_join_of_growing_tables_is_a_broadcast(spark):
    words = [f"w{i}" for i in range(30)]
    df = table(spark, [(i, request(" ".join(words[i % 7 : 20 + i % 7]))) for i in range(40)])
    for got in (N.near_duplicate_openings(df), N.duplicate_classes(df), N.similar_sets(N._members_and_sets(N.opening_sets(df))[1])):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("shared", [0.2, 0.5, 0.8])
def test_signature_estimates_weighted_similarity(shared):
    rng = np.random.default_rng(1)
    n = 200
    k = int(n * shared)
    elements = rng.integers(0, 2**63, 2 * n - k, dtype=np.uint64)
    weights = rng.uniform(1, 3, 2 * n - k)
    a, b = np.arange(n), np.arange(n - k, 2 * n - k)
    sig = N.prob_min_hash(np.repeat([0, 1], n), elements[np.r_[a, b]], weights[np.r_[a, b]], 2, 4000)
    true = weights[n - k : n].sum() / weights.sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
