import heapq
import random

import numpy as np
import pytest

from brindle.llm import splitting as S


def brute(n, ends, limit, overlap):
    ends, out, s = set(ends), [], 0
    while n - s > limit:
        e = next((x for x in range(s + limit, s + limit // 2, -1) if x in ends), s + limit)
        out.append((s, e))
        s = e - overlap
    return [*out, (s, n)]


def merged_slowly(n, ends, limit, overlap, weight):
    """Weakest pair first by looking at all pairs each time."""
    marks, settled = [0, *ends, n], set()
    while True:
        pairs = []
        for i in range(1, len(marks)):
            if marks[i] in settled:
                continue
            start = marks[i - 1] - overlap if marks[i - 1] else 0
            q = marks[i + 1] if i + 1 < len(marks) else marks[i]
            pairs.append(((weight.get(marks[i], 0.0), q - start, marks[i]), i, start, q))
        if not pairs:
            break
        _, i, start, q = min(pairs)
        e = marks[i]
        if e - start > limit:
            marks.insert(i, start + limit)
            settled.add(start + limit)
        elif e == n or q - start > limit:
            settled.add(e)
        else:
            del marks[i]
    return [(a - overlap if a else 0, b) for a, b in zip(marks, marks[1:])]


def case(rng):
    n, limit = rng.randint(1, 400), 2 * rng.randint(5, 40)
    overlap = rng.randint(0, limit // 2 - 1)
    ends = sorted(rng.sample(range(1, n), min(n - 1, rng.choice([0, 3, 20, n - 1])))) if n > 1 else []
    return n, ends, limit, overlap


def test_equals_brute_force():
    rng = random.Random(1)
    for _ in range(2000):
        n, ends, limit, overlap = case(rng)
        assert S.agglomerate(n, ends, limit, overlap, S.by_reach(limit)) == brute(n, ends, limit, overlap)


def test_order_of_the_heap_matters(monkeypatch):
    rng = random.Random(4)
    cases = [case(rng) for _ in range(200)]
    monkeypatch.setattr(heapq, "heappop", lambda heap: heap.pop(heap.index(max(heap))))
    assert any(S.agglomerate(n, ends, limit, overlap, S.by_reach(limit)) != brute(n, ends, limit, overlap) for n, ends, limit, overlap in cases)
    weight = {5: 1, 10: 9, 15: 1, 20: 9, 25: 1}
    assert S.agglomerate(30, sorted(weight), 12, 2, S.by_weight(weight)) != [(0, 10), (8, 20), (18, 30)]


def test_weakest_first():
    weight = {5: 1, 10: 9, 15: 1, 20: 9, 25: 1}
    assert S.agglomerate(30, sorted(weight), 12, 2, S.by_weight(weight)) == [(0, 10), (8, 20), (18, 30)]
    rng = random.Random(2)
    for _ in range(500):
        n, limit, overlap = rng.randint(1, 300), rng.randint(8, 40), rng.randint(0, 5)
        ends = sorted(rng.sample(range(1, n), min(n - 1, 30))) if n > 1 else []
        weight = {e: rng.randint(1, 4) for e in ends}
        got = S.agglomerate(n, ends, limit, overlap, S.by_weight(weight))
        assert got == merged_slowly(n, ends, limit, overlap, weight)
        assert got[0][0] == 0 and got[-1][1] == n and all(e - s <= limit for s, e in got)
        assert all(b[0] == a[1] - overlap for a, b in zip(got, got[1:]))


def test_no_room():
    with pytest.raises(ValueError):
        S.agglomerate(10, [], 4, 4, S.by_reach(4))


IDS = [1, 13, 2, 3, 13, 4, 5, 6, 7, 8, 9, 10]
ROWS = [
    (1, "user", IDS, None, "x"), (1, "user", IDS, None, "x"), (2, "user", IDS, [0] * 6 + [1] * 6, "x"), (3, "user", IDS, [1], "x"), (4, None, IDS, None, "x"), (5, "odd", IDS, None, "x"), (6, "user", None, None, "x"),
    (7, "user", [], [], "x"), (8, "user", IDS[:4], None, "x"), (None, "user", IDS, None, "x"), (9, "user", [1] * 100_000, None, "x"), (10, "user", [None, 13] * 6, [None] * 12, "x"), (11, "user", IDS, [], "x"),
]


@pytest.fixture
def tables(spark):
    blocks = spark.createDataFrame(ROWS, "block_id long, kind string, ids array<int>, mask array<int>, max_tokens string")
    limits = spark.createDataFrame([("user", 6, 1), ("tool", 4, 9), (None, 3, 1)], "kind string, max_tokens int, overlap_tokens int")
    stops = spark.createDataFrame([(13, "stop"), (None, "x")], "token_id int, label string")
    return blocks, limits, stops


def pieces(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.block_id, []).append((r.piece_no, r.start_pos, r.end_pos))
    return got


def test_table(tables):
    blocks, limits, stops = tables
    got = pieces(S.split_blocks(*tables))
    for block_id, ids, mask in ((1, IDS, None), (2, IDS, [0] * 6 + [1] * 6), (3, IDS, [1]), (11, IDS, []), (10, [0, 13] * 6, [0] * 12)):
        ends = S.natural_boundaries(np.array(ids), None if mask is None else np.array(mask), np.array([13]))
        assert [p[1:] for p in sorted(got[block_id])] == brute(12, ends.tolist(), 6, 1)
    assert set(got) == {1, 2, 3, 9, 10, 11} and len(got[9]) == 20_000
    assert S.split_blocks(blocks.limit(0), limits, stops).count() == 0 and S.split_blocks(blocks, limits.limit(0), stops.limit(0)).count() == 0


def test_by_weight(tables):
    blocks, limits, stops = tables
    got = pieces(S.split_blocks_by_weight(*tables))
    assert set(got) == {1, 2, 3, 9, 10, 11} and len(got[9]) == 20_000
    for p in got.values():
        p = sorted(p)
        assert all(b[1] == a[2] - 1 for a, b in zip(p, p[1:])) and all(e - s <= 6 for _, s, e in p)
    assert S.split_blocks_by_weight(blocks.limit(0), limits, stops).count() == 0
