import pytest

from brindle.llm import mixture as M

SIZES = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int, demand string"


def test_shares_caps_and_order(spark):
    rows = [(i, "big", 50 + i % 7) for i in range(400)] + [(1000 + i, "small", 10) for i in range(30)] + [(2000 + i, "mid", 30) for i in range(200)]
    rows += [(3000, None, 99), (3001, "untargeted", 5), (3002, "mid", 0)]
    sizes = spark.createDataFrame(rows, SIZES)
    targets = spark.createDataFrame([("big", 0.5, 1, ""), ("small", 0.1, 3, ""), ("mid", 0.3, 2, ""), ("absent", 0.1, 2, ""), ("zero", 0.0, 2, "")], TARGETS)
    mixed = M.mixture(sizes, targets).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    uses = {}
    for r in mixed:
        uses.setdefault((r.source, r.doc_id), set()).add(r["copy"])
    caps = {"big": 1, "small": 3, "mid": 2}
    assert all(len(c) <= caps[s] for (s, _), c in uses.items()) and len(mixed) == sum(map(len, uses.values()))
    shares = {r.source: r for r in M.mixture_shares(M.mixture(sizes, targets), sizes, targets).collect()}
    # The share of the absent source is spread over the others; "small" is what limits the total.
    for s, want in (("big", 0.5 / 0.9), ("small", 0.1 / 0.9), ("mid", 0.3 / 0.9)):
        assert shares[s].actual_share == pytest.approx(want, abs=0.02)
    assert shares["small"].most_copies == 3 and shares["absent"].tokens == 0 and shares["zero"].tokens == 0
    early = [r.source for r in mixed[: len(mixed) // 4]].count("small")
    late = [r.source for r in mixed[-len(mixed) // 4 :]].count("small")
    assert early > late  # short documents come early


def test_empty(spark):
    sizes, targets = spark.createDataFrame([], SIZES), spark.createDataFrame([("a", 1.0, 1, "")], TARGETS)
    assert M.mixture(sizes, targets).count() == 0
    assert M.mixture_shares(M.mixture(sizes, targets), sizes, targets).collect()[0].actual_share == 0
    full = spark.createDataFrame([(1, "a", 5)], SIZES)
    assert M.mixture(full, targets.limit(0)).count() == 0
    assert [tuple(r)[:4] for r in M.mixture(full, targets).collect()] == [(1, 0, "a", 5)]


def test_sizes_in_tokens(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", 9), (2, None, "a", 9), (3, "", None, 9)], "doc_id long, text string, source string, n_tokens int")
    assert sorted((r.doc_id, r.n_tokens) for r in M.token_sizes(docs).collect()) == [(1, 3), (2, 0), (3, 0)]


@pytest.fixture
def many(spark):
    rows = [(i, ("big", "small", "mid")[min(2, i % 5)], 5 + i * 7 % 40) for i in range(500)]
    return rows, spark.createDataFrame(rows, SIZES), spark.createDataFrame([("big", 0.4, 1, ""), ("small", 0.25, 3, ""), ("mid", 0.35, 2, "")], TARGETS)


def test_order_does_not_depend_on_buckets_or_plan(many):
    _, sizes, targets = many
    want = M.mixture(sizes, targets, bits=1).collect()
    assert len(want) > 200
    for bits, small in ((6, 10), (16, 10), (6, 0)):
        assert M.mixture(sizes, targets, bits=bits, small_plan=small).collect() == want


def test_equals_brute_force(many):
    import hashlib
    import math

    rows, sizes, targets = many
    goal = {"big": (0.4, 1), "small": (0.25, 3), "mid": (0.35, 2)}
    own = {s: [(d, n) for d, x, n in rows if x == s] for s in goal}
    held = {s: sum(n for _, n in v) for s, v in own.items()}
    total = min(r * held[s] / share for s, (share, r) in goal.items())
    lean = {s: math.log(held[s] / len(own[s])) for s in goal}
    mean = sum(goal[s][0] * lean[s] for s in goal)
    widest = max(abs(v - mean) for v in lean.values())
    out = []
    for s, (share, _) in goal.items():
        demand, k = math.floor(round(total * share, 6)), M.DRIFT * (lean[s] - mean) / widest
        start, copy = 0, 0
        while start < demand:
            for d, n in sorted(own[s], key=lambda r: (hashlib.md5(f"{r[0]}/{copy}".encode()).hexdigest()[:15], r[0])):
                if start < demand:
                    t, hi = 0.0, 1.0  # invert the integral of the schedule by bisection
                    for _ in range(60):
                        mid = (t + hi) / 2
                        t, hi = (mid, hi) if mid + k * (mid * mid - mid) < start / demand else (t, mid)
                    out.append((d, copy, s, n, t * total))
                start += n
            copy += 1
    got = sorted(map(tuple, M.mixture(sizes, targets).collect()))
    out.sort()
    assert [r[:4] for r in got] == [r[:4] for r in out]
    assert all(a[4] == pytest.approx(b[4], abs=1e-6 * total) for a, b in zip(got, out))
