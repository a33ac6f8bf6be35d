import random

import numpy as np

from brindle.llm import encodings as E

SCHEMA = "doc_id long, text string, source string, chain string, weight string"
WORDS = {
    "fr": "été légère répétée méthode préférée élève façon où après prévision déjà hôtel".split(),
    "de": "Prüfung größer Störung für Läufe Änderung wäre geprüft übrige Schätzung".split(),
    "ru": "таблица проверка была изменена после оценки средняя запись хранится общая".split(),
    "pl": "średnia łączność zmieniona jest część długość również źródło".split(),
}
PLAIN = "the run was kept because level of report and table".split()


def corpus(rng, n=900):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) if rng.random() < 0.5 else rng.choice(PLAIN) for _ in range(40)]
        out.append(" ".join(words) + rng.choice([".", " – ok.", " “quoted”.", " 22 °C."]))
    return out


def test_detection_and_repair(spark):
    rng = random.Random(2)
    texts = corpus(rng)
    chains = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1251", "cp1252"), ("utf-8", "cp437"), ("utf-8", "cp1251")]
    rows, truth = [], {}
    for i, t in enumerate(texts):
        if i % 9 == 0:
            true, wrong = chains[(i // 9) % len(chains)]
            try:
                bad = t.encode(true).decode(wrong)
                if (i // 9) % 6 == 0 and true == "utf-8" and wrong == "cp1252":
                    bad = bad.encode("utf-8").decode("cp1252")  # twice
            except UnicodeError:
                bad = t
            if bad != t:
                truth[i] = t
                t = bad
        rows.append((i, t, rng.choice(["a", "b", None]), "x", "y"))
    rows += [(5000, None, "a", "", ""), (5001, "", "a", "", ""), (5002, "plain ascii", None, "", ""), (5003, "Pr�fung der St�rung", "a", "", ""), (None, "Ã©tÃ©", "a", "", ""), (5004, "straße " * 30_000, "b", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id for r in E.garbled_documents(docs).collect()}
    want = {*truth, 5003}
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 2
    fixed = {r.doc_id: r for r in E.repaired_documents(docs).collect()}
    right = sum(fixed[i].text == t for i, t in truth.items() if i in fixed)
    assert right >= 0.8 * len(truth) and fixed[5003].chain == E.LOST and not fixed[5003].changed


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert E.garbled_documents(docs).count() == 0 and E.repaired_documents(docs).count() == 0
    assert E.garbled_documents(spark.createDataFrame([(1, None, None, "", ""), (2, "abc", "s", "", "")], SCHEMA)).count() == 0


def test_characters_lost_to_question_marks(spark):
    rng = random.Random(5)
    trees = ["\n".join(["Files of the run."] + [rng.choice(["├── ", "│   ├── ", "└── "]) + f"data/part{rng.randrange(99)}.log" for _ in range(8)] + ["Is it kept? Yes."]) for _ in range(200)]
    sums = [f"RMSE of run {i}.\n\nRMSE = √(Σ(yᵢ − ŷᵢ)² / n) ≈ 0.{i}, α ≤ 0.05, β = γ" for i in range(100)]
    texts = corpus(rng) + trees + sums
    rows = [(i, t, rng.choice(["a", "b", None]), "", "") for i, t in enumerate(texts)]
    lost = {5000 + k: t.encode("ascii", "replace").decode() for k, t in enumerate([trees[0], trees[1], sums[0], "Die Prüfung der Störung wäre größer."])}
    clean = ["Pourquoi ? Oui, est-ce là ?", "x = a ? b : c; y = v ?? 3", "?? src/a.py\n?? b/c.txt", "SELECT a FROM t WHERE b = ? AND c IN (?, ?)", "(?:a|b) https?://a.b/c?d=e", "| ? | ? |", "what??? no?! ok?Yes"]
    rows += [(i, t, "a", "", "") for i, t in lost.items()] + [(6000 + k, t, "a", "", "") for k, t in enumerate(clean)]
    assert all(t.isascii() for t in lost.values()) and not any(map(E.lost_marks, clean))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id for r in E.garbled_documents(docs).collect()}
    assert found >= set(lost) and len(found - set(lost)) <= 2


def test_one_garbled_stretch_in_a_long_text(spark):
    rng = random.Random(7)
    words = sorted({a + b for v in WORDS.values() for a in v for b in v if not (a + b).isascii()})
    rng.shuffle(words)
    long, half = " ".join(words * 3), len(words) // 2
    with_ = {k: " ".join([*words[:half], *(words * 2), bad, *words[half:]]) for k, bad in ((7000, "prÃ©fÃ©rÃ©e"), (7001, "Pr\ufffdfung"), (7002, "run \x93kept\x94 here"))}
    assert len(words) > 400
    rows = [(i, t, rng.choice(["a", "b", None]), "", "") for i, t in enumerate([*corpus(rng), *[long] * 5])] + [(i, t, "a", "", "") for i, t in with_.items()]
    found = {r.doc_id for r in E.garbled_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == set(with_)


def test_best_part_is_the_best_of_all_parts():
    rng = random.Random(8)
    for _ in range(300):
        at, hits = 0, []
        for _ in range(rng.randrange(1, 12)):
            at += rng.randrange(40)
            n = rng.randrange(1, 4)
            hits.append((at, at + n, rng.random() * 3))
            at += n
        least = rng.randrange(1, 80)
        parts = (sum(g for *_, g in hits[k : m + 1]) + E._CLEAN * max(least, hits[m][1] - hits[k][0]) for m in range(len(hits)) for k in range(m + 1))
        assert abs(E._best_part(hits, least) - max(parts)) < 1e-9


def test_stretches_garbled_in_several_ways_are_all_repaired(spark):
    rng = random.Random(9)
    ru, fr = "таблица была изменена после оценки", "été légère répétée préférée"
    as_koi, as_utf8 = ru.encode("cp1251").decode("koi8-r"), fr.encode("utf-8").decode("cp1252")
    rows = [(i, t, rng.choice(["a", "b", None]), "", "") for i, t in enumerate(corpus(rng))]
    rows += [(8000, f"the run {as_koi} of report {as_utf8} was kept", "a", "", ""), (8001, "Pr\ufffdfung der St\ufffdrung gr\ufffdßer f\ufffdr: prÃ©fÃ©rÃ©e was kept", "a", "", "")]
    got = {r.doc_id: r for r in E.repaired_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[8000].text == f"the run {ru} of report {fr} was kept"
    assert got[8001].text == "Pr\ufffdfung der St\ufffdrung gr\ufffdßer f\ufffdr: préférée was kept" and got[8001].changed and got[8001].chain == E.LOST


def test_many_sources_and_the_salted_join_give_the_same_priors(spark):
    rng = random.Random(10)
    rows = []
    for i, t in enumerate(corpus(rng)):
        rows.append((i, t.encode("utf-8").decode("cp1252", "ignore") if i % 7 == 0 and t.isprintable() else t, rng.choice(["hot", None, "", f"s{i}"]), "", ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = E.character_model(docs)
    one = {r.doc_id: round(r.posterior, 9) for r in E.chain_posteriors(docs, model).collect()}
    two = {r.doc_id: round(r.posterior, 9) for r in E.chain_posteriors(docs, model, small_sources=3).collect()}
    assert one == two and len(one) > 100


def test_null_and_empty_sources_are_apart(spark):
    evidence = spark.createDataFrame([(1, "", [0], [9.0]), (2, "=", [0], [9.0])], "doc_id long, source string, chain array<int>, weight array<double>")
    sizes = spark.createDataFrame([("", 1), ("=", 100_000)], "source string, size long")
    _, got = E._fit_priors(evidence, sizes)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1]["size"] == 1 and by[2]["size"] == 100_000 and by[1].seen == [0] and by[1].n[0] > by[2].n[0]


def test_counts_beyond_32_bits():
    uni, bi = np.zeros(E.UNIGRAMS), np.zeros(E.BIGRAMS, dtype=np.float32)
    uni[ord(" ")], uni[ord("a")] = 3e9, 2.5e9
    bi[(ord(" ") * 1000003 + ord("a")) % E.BIGRAMS] = 2.4e9
    assert -1 < E.CharacterModel(uni, bi).pair(" ", "a") < 0


def test_garbled_many_times(spark):
    rng = random.Random(12)
    model = E.character_model(spark.createDataFrame([(i, t, "a", "", "") for i, t in enumerate(corpus(rng))], SCHEMA))
    bad = "préférée"
    for _ in range(5):
        bad = bad.encode("utf-8").decode("latin-1")
    assert E.repair_text(f"the run {bad} was kept", {}, model) == "the run préférée was kept"
