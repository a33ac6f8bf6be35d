import json

import numpy as np
import pytest

from brindle.llm import defects as D

SCHEMA = "request_id long, path string, status int, request string, response string, defect string, votes string"
FULL = [f"The plan of item{i} keeps its balanced metric and a report at {i}.5. Across {i} seeds the curve improved." for i in range(200)]
Q = "Compare the header of alpha with a nested signal and a plain sensor. Store the result under data/out.json together with the log. When the run is slow, the table is kept at level 0.5."

# Held-out pairs with their defects, none of which is in the tables.
LABELLED = [
    (Q, "", "empty"), (Q, " ​\n", "empty"), (Q, None, "empty"),
    (Q, "I'm sorry, but I can't help with this request.", "refusal"), (Q, "Leider darf ich dazu keine Auskunft geben.", "refusal"), (Q, "抱歉，我无法协助完成这个请求。", "refusal"), (Q, "I must decline: this is something I won't do.", "refusal"),
    (Q, Q, "echo"), (Q, "You asked: " + Q, "echo"), (Q, "> " + Q, "echo"),
    (Q, "Wir haben die Messung mit 12 Läufen geprüft, weil die Schätzung noch zu ungenau war. Nach der Prüfung wurde auch die Tabelle gespeichert.", "language"),
    (Q, "由于记录太大，稀疏的窗口在名单中被校正，需要重新计算轨迹。", "language"),
    (Q, "After the header was compared with the signal, the plain sensor reached 0.7 in all runs because of", "truncated"),
    (Q, "The first run is complete.\n\n```python\ndef f(rows):\n    return len(", "truncated"), (Q, '{"winner": "A", "rationale": "the first", "n', "truncated"), (Q, "Steps:\n1. Load the table.\n2. Fit the curve.\n3.", "truncated"),
    (Q, "I cannot recommend alpha over beta, because both stay within 0.3; I kept beta and finished the table.", None), (Q, "Sorry for the earlier mix-up: the corrected value is 0.3, and data/a.csv now holds it.", None),
    (Q, "The runs are complete.\n\nOutput files:\n- data/a.csv\n- notes/b.md", None), (Q, '{"winner": "A", "n": 3}', None), (Q, "It works.\n\n```\na 1\nb 2\n```", None),
    (Q + " Please answer in German.", "Wir haben die Messung mit 12 Läufen geprüft, weil die Schätzung noch zu ungenau war.", None),
    (Q, "> Compare the header of alpha with a nested signal and a plain sensor.\n\nThe header of alpha is 0.3 above the signal. The sensor lost 12 rows, so the run was repeated and the file kept.", None),
]


def record(i, question, answer, calls=None):
    request = json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": question}]})
    return (i, "/v1/chat/completions", 200, request, json.dumps({"choices": [{"message": {"content": answer, "tool_calls": calls}, "finish_reason": "stop"}]}), "x", "y")


def corpus():
    rows = [record(1000 + i, Q.replace("alpha", f"a{i}"), t) for i, t in enumerate(FULL)]
    return rows + [record(i, q, a) for i, (q, a, _) in enumerate(LABELLED)]


def test_labelled_pairs(spark):
    rows = corpus()
    rows += [rows[-1], record(500, Q, "", [{"id": "1"}]), (501, "/v1/chat/completions", 200, "{", '{"choices": []}', "", ""), (502, "/v1/chat/completions", 200, None, None, "", ""), (503, "/health", 200, None, None, None, None), (504, "/v1/chat/completions", 500, rows[0][3], rows[0][4], "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.request_id: r.defect for r in D.defective_pairs(df).collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(LABELLED) if d}
    assert D.labelled_pairs(df).where("posterior <= 0.5").count() == 0
    assert D.defective_pairs(df.limit(0)).count() == 0


def test_residue_is_no_pair(spark):
    rows = corpus() + [record(900, Q, "[API Error: terminated]"), record(901, Q, "Please enable JavaScript and cookies to continue.")]
    got = {r.request_id for r in D.defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got & {900, 901}


def test_label_model_recovers_classes():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.04
    votes = np.where(y[:, None], rng.random((20000, 4)) < 0.85, rng.random((20000, 4)) < 0.04)
    patterns, inverse = np.unique(["".join("01"[int(v)] for v in r) for r in votes], return_inverse=True)
    post, _, share = D.fit_label_model(list(patterns), np.bincount(inverse).astype(float), ((0.8, 0.05),) * 4)
    assert abs(share - 0.04) < 0.01 and ((post[inverse] > 0.5) == y).mean() > 0.995


def test_very_long_texts():
    q, a = "word " * 100_000, "other thing. " * 50_000
    assert D.echo_votes(q, a) == "000" and D.language_votes(q, a)[0] == "-" and len(D.truncated_votes(a, None)) == 6 and D.refusal_votes(a)[1] == "0"


def test_cutoffs_are_validated():
    post, label = np.array([0.999, 0.9, 0.4, 0.02, 0.01]), np.array([True, True, False, False, False])
    assert D.validated_cutoff(post, label) == pytest.approx(0.65)
    assert D.validated_cutoff(np.array([0.9, 0.8, 0.7]), np.array([True, False, True])) < 0.7
    for d in D.DEFECTS:
        label = np.array([d in x for *_, x in D.LABELLED])
        votes = D._example_votes()[d]
        post = D.posteriors(votes, np.array(D.BELIEFS[d]).T[::-1], 0.03)
        cutoff = D.validated_cutoff(post, label)
        assert [v for v, y, p in zip(votes, label, post) if (p > cutoff) != y] == [], d


def test_two_defects_of_one_record(spark):
    both = "Wir haben die Messung mit 12 L\u00e4ufen gepr\u00fcft, weil die Sch\u00e4tzung noch zu ungenau war, und nach der Pr\u00fcfung wurde auch die"
    df = spark.createDataFrame([*corpus(), record(700, Q, both)], SCHEMA)
    assert {r.defect for r in D.labelled_pairs(df).where("request_id = 700").collect()} == {"language", "truncated"}
    assert D.defective_pairs(df).where("request_id = 700").count() == 1
