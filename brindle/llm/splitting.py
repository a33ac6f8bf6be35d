"""Splitting oversized blocks of token ids at natural boundaries, by agglomerative merging.

The atoms of a block lie between neighbouring natural boundaries. A heap holds
every pair of adjacent segments by the strength of the boundary between them;
the weakest pair is taken first and becomes one segment while its size plus the
overlap carried into it fits the limit. What cannot be merged stays a cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: boundary_tokens is a table of token kinds; more rows than a vocabulary has are refused.
MAX_BOUNDARY_TOKENS = 1_000_000
#: What stands for a null id or mask value: no token has it, and two of them are equal.
_NULL = np.int64(-(1 << 62))

#: (start of the left segment, boundary, end of the right segment) -> (sort key of the pair, whether the boundary may stay a cut)
Strength = Callable[[int, int, int], tuple[tuple, bool]]


def natural_boundaries(ids: np.ndarray, mask: np.ndarray | None, stops: np.ndarray) -> np.ndarray:
    """Positions e in 1..n-1 with ids[e-1] in ``stops`` or mask[e] different from mask[e-1] (mask of the length of ids only)."""
    at = np.isin(ids[:-1], stops)
    if mask is not None and len(mask) == len(ids):
        at |= mask[1:] != mask[:-1]
    return np.nonzero(at)[0] + 1


def agglomerate(n: int, boundaries: Sequence[int], limit: int, overlap: int, strength: Strength) -> list[tuple[int, int]]:
    """Pieces (start, end) of 0..n, each of at most ``limit`` positions, consecutive ones sharing ``overlap``.

    Segments are linked to their neighbours. A pair is taken from the heap,
    weakest first, and merged if both segments and the overlap fit ``limit``;
    the pairs on either side are then put back with their new strength. A pair
    that does not fit is settled, since segments only grow. Where its boundary
    may not stay, or the left segment alone is too long, the excess is cut off
    hard at the limit and the rest goes on as a segment of its own.
    """
    if overlap >= limit:
        raise ValueError("overlap must be smaller than the limit")
    ends = [int(b) for b in boundaries if 0 < b < n]
    marks = [0, *ends, n]
    before = dict(zip(marks[1:], marks))
    after = dict(zip(marks, marks[1:]))
    current: dict[int, tuple] = {}  # the key of each pair that is in the heap; others are stale
    heap: list[tuple[tuple, int]] = []

    def insert(e: int) -> None:
        p = before[e]
        key, _ = strength(p - overlap if p else 0, e, after.get(e, e))
        if current.get(e) != key:
            current[e] = key
            heapq.heappush(heap, (key, e))

    for e in marks[1:]:
        insert(e)
    while heap:
        key, e = heapq.heappop(heap)
        if current.get(e) != key:
            continue
        del current[e]
        p = before[e]
        start = p - overlap if p else 0
        if e - start <= limit:
            if e == n:
                continue  # the last segment fits and has no right neighbour
            q = after[e]
            if q - start <= limit:  # merge
                del before[e], after[e]
                before[q], after[p] = p, q
                for x in (p, q):
                    if x in current:
                        insert(x)
                continue
            if strength(start, e, q)[1]:
                continue  # stays a cut
            hard, gone, q = start + limit, e, q
        else:
            hard, gone, q = start + limit, None, e
        if gone is not None:
            del before[gone], after[gone]
        before[hard], after[p] = p, hard
        before[q], after[hard] = hard, q
        current.pop(q, None)
        insert(q)
    out, at = [], 0
    while at < n:
        out.append((at - overlap if at else 0, after[at]))
        at = after[at]
    return out


def by_reach(limit: int) -> Strength:
    """The strength that the fixed rule "greatest boundary in (s + limit/2, s + limit]" asks for.

    The later a boundary, the longer the piece it makes, so the stronger it is:
    pairs are merged from the left, and a boundary whose pair no longer fits is
    the greatest one in reach of its piece. One in the first half of the limit may not stay.
    """
    return lambda start, e, q: ((e,), 2 * (e - start) > limit)


def by_weight(weight: dict[int, float]) -> Strength:
    """Boundaries of little weight first, of equal ones the pair with the smaller sum, then the leftmost; hard cuts have no weight; any may stay."""
    return lambda start, e, q: ((weight.get(e, 0.0), q - start, e), True)


def _ints(values: pa.Array) -> np.ndarray:
    """The numbers of an array, nulls as ``_NULL``."""
    out = np.full(len(values), _NULL)
    known = values.is_valid().to_numpy(zero_copy_only=False)
    out[known] = values.drop_null().to_numpy(zero_copy_only=False)
    return out


def _marked(ids: pa.ListArray, mask: pa.ListArray, stops: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, boundaries, kinds) of every row, found in one pass over the values of the batch; the kind is the token before the boundary, or ``_NULL`` where the mask changes."""
    flat, flat_mask = _ints(ids.flatten()), _ints(mask.flatten())
    sizes = np.diff(ids.offsets.to_numpy())
    known = mask.is_valid().to_numpy(zero_copy_only=False)
    mask_sizes = np.where(known, np.diff(mask.offsets.to_numpy()), -1)
    stop = np.isin(flat, stops)
    turn = np.zeros(len(flat_mask), dtype=bool)
    turn[1:] = flat_mask[1:] != flat_mask[:-1]
    at = mask_at = 0
    for n, m in zip(sizes.tolist(), mask_sizes.tolist()):
        hit = stop[at : at + n - 1].copy() if n else stop[:0]
        kind = flat[at : at + n - 1] if n else flat[:0]
        if m == n and n:
            change = turn[mask_at + 1 : mask_at + n]
            hit |= change
            kind = np.where(change, _NULL, kind)
        ends = np.nonzero(hit)[0]
        yield n, ends + 1, kind[ends]
        at += n
        mask_at += max(m, 0)


def _stops(boundary_tokens: DataFrame) -> np.ndarray:
    rows = boundary_tokens.select("token_id").where("token_id is not null").distinct().limit(MAX_BOUNDARY_TOKENS + 1).collect()
    if len(rows) > MAX_BOUNDARY_TOKENS:
        raise ValueError("boundary_tokens holds more rows than a vocabulary")
    return np.array(sorted(r[0] for r in rows), dtype=np.int64)


def _oversized(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """(block_id, ids, mask, max_tokens, overlap_tokens) of the blocks longer than the limit of their kind."""
    sizes = limits.where("kind is not null and max_tokens > 0 and overlap_tokens >= 0 and overlap_tokens < max_tokens").select("kind", "max_tokens", "overlap_tokens")
    return (
        blocks.where("block_id is not null and kind is not null and ids is not null")
        .select("block_id", "kind", "ids", "mask")
        .join(sizes, "kind")
        .where(F.size("ids") > F.col("max_tokens"))
        .select("block_id", "ids", "mask", "max_tokens", "overlap_tokens")
    )


_PIECES = "block_id long, piece_no long, start_pos long, end_pos long"


def _cut(big: DataFrame, stops: np.ndarray, strength: Callable[[int, np.ndarray, np.ndarray], Strength]) -> DataFrame:
    """Pieces of the blocks; ``strength`` gets limit, boundaries and kinds of a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            heads = zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            for (block_id, limit, overlap), (n, ends, kinds) in zip(heads, _marked(b.column(1), b.column(2), stops)):
                pieces = agglomerate(n, ends.tolist(), limit, overlap, strength(limit, ends, kinds))
                out += [(block_id, k, s, e) for k, (s, e) in enumerate(pieces, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["block_id", "piece_no", "start_pos", "end_pos"])

    return big.mapInArrow(cut, _PIECES).distinct()


def split_blocks(blocks: DataFrame, limits: DataFrame, boundary_tokens: DataFrame) -> DataFrame:
    """(block_id, piece_no, start_pos, end_pos): the pieces of every block longer than max_tokens of its kind, by the fixed rule.

    Blocks with null id, kind or ids, or of a kind without limit, are left out;
    a null mask, or one of another length, gives no boundaries; rows loaded
    twice count once; limits with nulls or an overlap that leaves no room are
    ignored. Only ids and mask of oversized blocks leave the JVM.
    """
    return _cut(_oversized(blocks, limits), _stops(boundary_tokens), lambda limit, ends, kinds: by_reach(limit))


def boundary_weights(big: DataFrame, stops: np.ndarray) -> dict[int, float]:
    """Weight of each kind of boundary: the rarer over all oversized blocks, each counted once, the heavier. One number a boundary token reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *x) for i, (_, _, kinds) in zip(b.column(0).to_pylist(), _marked(b.column(1), b.column(2), stops)) for x in zip(*(x.tolist() for x in np.unique(kinds, return_counts=True)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], ["block_id", "kind", "n"])

    seen = big.select("block_id", "ids", "mask").mapInArrow(count, "block_id long, kind long, n long").distinct()
    rows = seen.groupBy("kind").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    return {r["kind"]: round(float(-np.log(r["n"] / total)), 6) + 1.0 for r in rows}


def split_blocks_by_weight(blocks: DataFrame, limits: DataFrame, boundary_tokens: DataFrame) -> DataFrame:
    """(block_id, piece_no, start_pos, end_pos): the same limits and overlaps, but merged anywhere in the block, commonest kinds of boundary first.

    Paragraph ends and changes of the mask, which are rare, thereby outlast
    blanks and full stops. Nulls and repeated rows as in ``split_blocks``.
    """
    big = _oversized(blocks, limits)
    stops = _stops(boundary_tokens)
    weights = boundary_weights(big, stops)

    def strength(limit: int, ends: np.ndarray, kinds: np.ndarray) -> Strength:
        return by_weight({e: weights.get(k, 1.0) for e, k in zip(ends.tolist(), kinds.tolist())})

    return _cut(big, stops, strength)
