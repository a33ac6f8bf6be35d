import random

import numpy as np
import pytest

from brindle.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, ids string, key string, chunk string"


@pytest.fixture(scope="module")
def exact():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(5)
    alphabet = "ab  \n\t 　漢字é's12,.\U0001f600<|endoftext|>"
    shared = "A passage that many documents share, word for word. " * 40
    out = ["", None, " ", " ", "<|endoftext|>", "x" * 9000, " " * 6000 + "y", "漢字" * 4000, "ab1" * 3000, shared, "intro " + shared, shared + " outro"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3000))) for _ in range(120)]


def test_equals_reference_encoder(spark, exact):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts())] + [(None, "lost", "", "", "")]
    got = {r.doc_id: r.ids for r in T.encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: exact(t) if t else [] for i, t, *_ in rows if i is not None}


def test_empty_table(spark):
    assert T.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_joins_are_repaired():
    rng = random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice("ab  \n 　漢é's12,.") for _ in range(rng.randint(13, 200)))
        cuts = [(0, True), *T.cuts_of(text, 8)]
        ids, joins = [], []
        for k, (start, sure) in enumerate(cuts):
            if not sure:
                joins.append(len(ids))
            ids += T.encode(text[start : cuts[k + 1][0] if k + 1 < len(cuts) else None])
        assert T.repair(ids, joins) == T.encoding().encode_ordinary(text)


def test_certain_ends_hold_in_every_context(exact):
    rng = random.Random(7)
    alphabet = "ab Z0\u0663\u00bd'.,-\u3002\u6f22\u5b57\u0301\u00a0\n\u200b\U0001f600\u0e01\u0e31\u00e9\u2160"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 40)))
        c = np.array(list(map(ord, text)))
        k = rng.choice([0, *(np.nonzero(T.certain_ends(c[:-1], c[1:]))[0] + 1)])
        assert T.encode(text[:k]) + T.encode(text[k:]) == T.encode(text)


def test_texts_without_blanks_are_cut_at_certain_places():
    rng = random.Random(8)
    text = "".join(rng.choice("\u6f22\u5b57\u6587\u7ae0\u7684\u4e86\u662f") + ("\u3002" if rng.random() < 0.05 else "") for _ in range(20_000))
    cuts = T.cuts_of(text)
    assert len(cuts) > 20 and sum(sure for _, sure in cuts) >= 0.9 * len(cuts)


def test_chunks_are_shared():
    passage = " ".join(f"word{i} of the passage" for i in range(400))

    def chunks(text):
        cuts = [p for p, _ in T.cuts_of(text)]
        return {text[a:b] for a, b in zip(cuts, cuts[1:])}

    a, b = chunks("one intro. " + passage), chunks("another, longer introduction here. " + passage)
    assert len(a & b) >= len(a) - 2 > 3
