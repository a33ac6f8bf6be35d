"""Encoding a corpus with a public tokenizer: content-defined chunks are encoded once.

Texts are cut where a rolling hash of their own characters says so, so a passage
shared by many documents yields the same chunks in all of them. Distinct chunks
are encoded once and joined back. Where the kind of character changes (letter,
digit, other sign, or a blank after any of them) a token ends in every context,
so joins there are exact as they are; at every other cut the ids around the join
are decoded and encoded again, in a window that grows until its outer ids agree
with those that were there.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from brindle.plans.materialize import materialize

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk ends on average after so many characters (a power of two).
MEAN_CHUNK = 512
WINDOW = 12
#: A cut moves forward to the next certain boundary within so many characters, if there is one.
REACH = 64
#: The encoder merges pairs of one pre-token in quadratic time; runs longer than this go to the merge with a heap.
LONG_RUN = 2000

#: Kinds of characters. Those that are not known for certain to any version of Unicode are UNSURE.
UNSURE, LETTER, NUMBER, SIGN, BLANK, SPACE = range(6)
_APOSTROPHE = ord("'")
_RUN = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(path: str = DEFAULT_VOCABULARY) -> tiktoken.Encoding:
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def encode(text: str, path: str = DEFAULT_VOCABULARY) -> list[int]:
    """Ids of ``text``; special tokens are ordinary text; very long runs are merged with a heap."""
    if not _RUN.search(text):
        return encoding(path).encode_ordinary(text)
    import regex

    out: list[int] = []
    for piece in regex.findall(PATTERN, text):
        if len(piece) <= LONG_RUN:
            out += encoding(path).encode_ordinary(piece) if not piece.isspace() else _merge(piece.encode(), _ranks(path))
        else:
            out += _merge(piece.encode(), _ranks(path))
    return out


def _merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token, lowest rank and leftmost first, in O(n log n)."""
    import heapq

    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts at i; 0 where no part starts
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        p = before[i]
        if p >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of every code point: only characters whose category is the same in the first and the present edition of the table are told apart."""
    out = np.full(0x110000, UNSURE, dtype=np.uint8)
    first = unicodedata.ucd_3_2_0
    for i in range(0x10000):
        c = chr(i)
        now, then = unicodedata.category(c), first.category(c)
        if now[0] == then[0] and now not in ("Cn", "Cs"):
            out[i] = {"L": LETTER, "N": NUMBER}.get(now[0], SIGN)
        if c.isspace():
            out[i] = SPACE
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    return out


def certain_ends(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether a token ends between two neighbouring code points in every context.

    A pre-token is a run of one kind, with a blank before it at most, or an
    apostrophe with letters; so only a blank and an apostrophe stick to what follows.
    """
    kinds = _kinds()
    a, b = kinds[left], kinds[right]
    known = (a >= LETTER) & (a <= SIGN) & (b >= LETTER) & (b <= SIGN)
    return (b == BLANK) & (a < BLANK) | known & (a != b) & (left != _APOSTROPHE)


def cuts_of_all(texts: list[str], mean: int = MEAN_CHUNK) -> list[list[tuple[int, bool]]]:
    """Per text, the chunk starts after 0, with whether the cut is a certain token boundary.

    All texts are hashed as one array; windows never reach over the start of a text.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    if n <= WINDOW:
        return [[] for _ in texts]
    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    h = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):  # the hash of the WINDOW characters before each position
            h *= np.uint64(0x100000001B3)
            h += c[k : n - WINDOW + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    at = np.nonzero(h % np.uint64(mean) == 0)[0] + WINDOW
    sure = np.nonzero(certain_ends(c[:-1], c[1:]))[0] + 1
    owner = np.searchsorted(starts, at, side="right") - 1
    # Texts of length 0 share their start with the next one; the last of them owns the position.
    inside = (at - starts[owner] >= WINDOW) & (at < starts[owner] + sizes[owner])
    at, owner = at[inside], owner[inside]
    nxt = np.searchsorted(sure, at)
    found = sure[np.minimum(nxt, len(sure) - 1)] if len(sure) else np.zeros(len(at), dtype=np.int64)
    ok = (nxt < len(sure)) & (found - at <= REACH) & (found < starts[owner] + sizes[owner])
    cut = np.where(ok, found, at) - starts[owner]
    out: list[list[tuple[int, bool]]] = [[] for _ in texts]
    for i, p, certain in zip(owner.tolist(), cut.tolist(), ok.tolist()):
        if not out[i] or p > out[i][-1][0]:
            out[i].append((p, certain))
    return out


def cuts_of(text: str, mean: int = MEAN_CHUNK) -> list[tuple[int, bool]]:
    """The cuts of one text."""
    return cuts_of_all([text], mean)[0]


_CHUNKS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("exact", BooleanType()),
        StructField("pos", IntegerType()),
        StructField("certain", BooleanType()),
        StructField("key", BinaryType()),
        StructField("chunk", StringType()),
    ]
)


def _with_cuts(ids: list[int], texts: list[str]) -> Iterator[tuple[int, str, list[tuple[int, bool]]]]:
    """Rows with the cuts of their texts, hashed in groups of about a million characters."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > 1_000_000 or k + 1 == len(texts):
            yield from zip(ids[start : k + 1], texts[start : k + 1], cuts_of_all(texts[start : k + 1]))
            start, size = k + 1, 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_CHUNKS)
    for b in batches:
        rows: list[tuple] = []
        size = 0
        for doc_id, text, found in _with_cuts(b.column(0).to_pylist(), b.column(1).to_pylist()):
            cuts = [(0, True), *found]
            exact = all(ok for _, ok in cuts)
            for i, (start, ok) in enumerate(cuts):
                chunk = text[start : cuts[i + 1][0]] if i + 1 < len(cuts) else text[start:]
                rows.append((doc_id, exact, i, ok, hashlib.blake2b(chunk.encode(), digest_size=16).digest(), chunk))
                size += len(chunk)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _encoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t, path) for t in b.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def repair(ids: list[int], joins: list[int], path: str = DEFAULT_VOCABULARY) -> list[int]:
    """The exact ids, given ids that are joined at token indices ``joins`` where the cut was not certain."""
    words = encoding(path)
    byte = words.decode_single_token_bytes

    def certain(i: int) -> bool:
        """Whether a token ends before token i in every context."""
        head, k = byte(ids[i]), i + 1
        while len(head) < 4 and k < len(ids):
            head += byte(ids[k])
            k += 1
        tail, k = b"", i - 1
        while len(tail) < 4 and k >= 0:
            tail = byte(ids[k]) + tail
            k -= 1
        if head[0] & 0xC0 == 0x80:
            return False  # inside a character
        a, b = tail[-4:].decode("utf-8", "ignore")[-1:], head[:4].decode("utf-8", "ignore")[:1]
        return bool(a and b and certain_ends(np.array([ord(a)]), np.array([ord(b)]))[0])

    def left(i: int, least: int) -> int:
        i -= 1
        while i > least and not certain(i):
            i -= 1
        return max(i, least)

    def right(i: int) -> int:
        i += 1
        while i < len(ids) and not certain(i):
            i += 1
        return min(i, len(ids))

    out: list[int] = []
    done = 0
    for j in joins:
        if j < done:
            continue  # inside the window of the join before
        low, high = left(j, done), right(j)
        while True:
            # One more stretch on either side tells whether the ids around the window hold.
            first, last = left(low, done), right(high)
            again = encode(b"".join(map(byte, ids[first:last])).decode("utf-8"), path)
            end = len(again) - (last - high)
            if end >= low - first and again[: low - first] == ids[first:low] and again[end:] == ids[high:last]:
                break
            low, high = first, last
        out += ids[done:low]
        out += again[low - first : end]
        done = high
    return out + ids[done:]


def _repairer(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                ids: list[int] = []
                joins: list[int] = []
                for p in parts:
                    if not p["certain"]:
                        joins.append(len(ids))
                    ids += p["ids"]
                out.append(repair(ids, joins, path))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>): ids of every document's whole text, without special tokens.

    Null and empty texts give the empty list. doc_id is taken to be unique;
    rows with a null doc_id are left out. Each distinct chunk is encoded once;
    a chunk that very many documents share is one row on the encoded side, and
    the rows that refer to it are small and can be split by the engine.
    """
    texts = documents.where("doc_id is not null and text is not null and length(text) > 0").select("doc_id", "text")
    chunks = materialize(texts.mapInArrow(_chunks, _CHUNKS), "chunks")
    distinct = chunks.groupBy("key").agg(F.first("chunk").alias("chunk"))
    ids_type = ArrayType(IntegerType())
    encoded = materialize(distinct.mapInArrow(_encoder(vocabulary), StructType([StructField("key", BinaryType()), StructField("ids", ids_type)])), "encoded")
    refs = chunks.select("doc_id", "exact", "pos", "certain", "key").join(encoded.hint("merge"), "key")
    parts = F.array_sort(F.collect_list(F.struct("pos", "certain", "ids")))
    whole = refs.where("exact").groupBy("doc_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    joined = refs.where("not exact").groupBy("doc_id").agg(parts.alias("parts"))
    mended = joined.mapInArrow(_repairer(vocabulary), StructType([StructField("doc_id", LongType()), StructField("ids", ids_type)]))
    blank = documents.where("doc_id is not null and (text is null or length(text) = 0)").select("doc_id", F.array().cast(ids_type).alias("ids"))
    return whole.unionByName(mended).unionByName(blank)
