import numpy as np

from brindle.llm import ranking as K

SCHEMA = "match_id long, a string, b string, winner string, item string, wins string"


def test_expected_counts_give_back_the_odds():
    rng = np.random.default_rng(0)
    s = np.exp(rng.normal(size=12))
    n = rng.integers(1, 400, (12, 12))
    n = n + n.T
    wins = n * s[:, None] / (s[:, None] + s[None])
    got = K.scale_offence_defence(wins, smoothing=0.0 + 1e-12)
    assert np.allclose(got, np.log(s) - np.log(s).mean(), atol=0.3) or np.array_equal(np.argsort(got), np.argsort(s))


def test_uneven_schedules_and_dirt(spark):
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(10)]
    strength = np.linspace(-2, 2, 10)
    rows = []
    for k in range(6000):
        i, j = rng.choice(10, 2, replace=False, p=np.r_[0.3, np.full(9, 0.7 / 9)])
        win = rng.random() < 1 / (1 + np.exp(strength[j] - strength[i]))
        rows.append((k, names[i], names[j], rng.choice(["A", " a", "A "]) if win else "B", "x", "y"))
    rows += [rows[0], (9001, "w0", "w0", "A", "", ""), (9002, "nobody", "w0", "A", "", ""), (9003, None, "w0", "A", "", ""), (9004, "w0", "w1", None, "", ""), (9005, "w0", "w1", "neither", "", "")]
    judged = spark.createDataFrame([tuple(map(lambda v: str(v) if isinstance(v, np.str_) else v, r)) for r in rows], SCHEMA)
    items = spark.createDataFrame([(n, 1) for n in [*names, "unplayed", None]], "workflow string, rank int")
    got = {r.workflow: r for r in K.global_ranking(judged, items).collect()}
    assert [w for w, _ in sorted(got.items(), key=lambda kv: kv[1]["rank"]) if w != "unplayed"] == names[::-1]
    assert got["unplayed"].n_comparisons == 0 and {r["rank"] for r in got.values()} == set(range(1, 12))
    assert {r.workflow for r in K.leaders(judged, items, 3).collect()} == {"w9", "w8", "w7"}
    total = sum(r.n_comparisons for r in got.values())
    assert total == 2 * 6002


def test_number_of_items_does_not_change_the_result(spark):
    rows = [(k, f"w{k % 5}", f"w{(k // 5) % 5}", "A" if k % 5 > (k // 5) % 5 else ("B" if k % 3 else "tie"), "", "") for k in range(250)]
    judged = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(f"w{i}",) for i in range(6)], "workflow string")
    near, far = (sorted(map(tuple, K.global_ranking(judged, items, local_items=n).collect())) for n in (6, 5))
    assert near == far


def test_sweeps_stop_alike(spark):
    wins = np.array([[0, 9.0, 2], [1, 0, 5], [7, 2, 0]])
    matrix = spark.createDataFrame([(f"i{a}", f"i{b}", float(wins[a, b]), 5) for a in range(3) for b in range(3) if a != b], "item string, other string, wins double, n long")
    known = spark.createDataFrame([(f"i{a}",) for a in range(3)], "item string")
    for sweeps in (1, 3):
        want = K.scale_offence_defence(wins.copy(), sweeps=sweeps)
        got = {r["x"]: r["strength"] for r in K._distributed(matrix, known, "x", sweeps=sweeps).collect()}
        assert np.allclose([got[f"i{a}"] for a in range(3)], want, atol=2e-6)


def test_empty(spark):
    judged = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([("a",), ("b",)], "workflow string")
    assert [r.workflow for r in K.global_ranking(judged, items).orderBy("rank").collect()] == ["a", "b"]
    assert K.global_ranking(judged, items.limit(0)).count() == 0
