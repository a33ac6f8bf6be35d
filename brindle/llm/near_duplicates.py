"""Near-duplicate prompts: ProbMinHash signatures, banding, exact verification.

Words are the shingles. Each word gets a weight between 1 (common) and
``SPREAD`` (rare); the signature draws, per register, a word with the weighted
"probability Jaccard" of the two sets as collision probability. Common words
shared by unrelated prompts thereby lose their pull, while the bounded spread
keeps a floor under the collision rate of every pair that must be found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from brindle.llm.chat import chat_rows, map_rows, messages_of, text_of
from brindle.plans.materialize import discard, materialize

WORD = re.compile(r"[^\W_]+")
MIN_WORDS = 5
#: Registers are grouped into BANDS bands of ROWS. A pair whose weighted similarity is w is a candidate with probability 1 - (1 - w**ROWS)**BANDS.
ROWS, BANDS = 9, 110
SPREAD = 1.5
#: Document frequencies are kept in a table of this fixed size; collisions only raise a frequency, that is, move a weight towards 1.
DF_BUCKETS = 1 << 18
#: Groups are paired in blocks of about so many members, so that no task pairs a large group by itself.
BLOCK = 1000

_SETS = StructType(
    [StructField("request_id", LongType()), StructField("set_id", BinaryType()), StructField("words", ArrayType(LongType()))]
)
_BAND = StructType([StructField("band", LongType()), StructField("set_no", LongType()), StructField("size", IntegerType())])


def words_of(text: str) -> list[str]:
    """Distinct words, sorted: maximal runs of letters and digits in lower case."""
    return sorted(set(WORD.findall(text.lower())))


def prompt_of(request: str | None) -> str | None:
    """The prompt of an opening: one user message and no assistant message; else None."""
    messages = messages_of(request)
    if messages is None:
        return None
    user = None
    for m in messages:
        role = m.get("role")
        if role == "assistant" or (role == "user" and user is not None):
            return None
        if role == "user":
            user = m
    return None if user is None else text_of(user.get("content"))


def _set_rows(request_id: int, request: str | None) -> Iterator[tuple]:
    prompt = prompt_of(request)
    words = words_of(prompt) if prompt else []
    if len(words) >= MIN_WORDS:
        joined = "\n".join(words)
        yield request_id, hashlib.md5(joined.encode("utf-8", "surrogatepass")).digest(), [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63) for w in words]


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prob_min_hash(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures (n x registers) of n weighted sets given as parallel arrays.

    Every element is a Poisson process whose rate is its weight: arrivals come
    at exponential gaps and land on uniform registers, each of which keeps its
    earliest arrival. An element stops once its clock has passed the latest
    register of its set, since no later arrival can win. All draws are functions
    of element and arrival number, so equal elements act alike everywhere.
    """
    best = np.full(n * registers, np.inf)
    sig = np.zeros(n * registers, dtype=np.uint64)
    limit = np.full(n, np.inf)
    alive, clock, arrival = np.arange(len(elements)), np.zeros(len(elements)), 0
    with np.errstate(over="ignore"):
        while len(alive):
            arrival += 1
            r = _mix(elements[alive] + np.uint64(arrival * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            clock[alive] -= np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weights[alive]
            keep = clock[alive] < limit[owner[alive]]
            alive, r = alive[keep], r[keep]
            slot = owner[alive] * registers + (_mix(r ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
            at = clock[alive]
            np.minimum.at(best, slot, at)
            won = best[slot] == at
            sig[slot[won]] = elements[alive[won]]
            if arrival % 4 == 0:
                limit = best.reshape(n, registers).max(axis=1)
    return sig.reshape(n, registers)


def _frequency_table(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Hashed document frequencies over all sets: DF_BUCKETS counters, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(DF_BUCKETS + 1, dtype=np.int64)
        for b in batches:
            words = b.column(0)
            flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            table[:-1] += np.bincount((flat % np.uint64(DF_BUCKETS)).astype(np.int64), minlength=DF_BUCKETS)
            table[-1] += b.num_rows
        at = np.nonzero(table)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["bucket", "n"])

    got = sets.select("words").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(DF_BUCKETS + 1, dtype=np.int64)
    table[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return table[:-1], int(table[-1])


def word_weights(table: np.ndarray, n_sets: int) -> np.ndarray:
    """Weight of each bucket: 1 for words in a fifth of all sets or more, SPREAD for words in a thousandth or fewer."""
    share = np.maximum(table, 1) / max(1, n_sets)
    rare = (np.log(1 / 5) - np.log(share)) / np.log(1000 / 5)
    return 1.0 + (SPREAD - 1.0) * np.clip(rare, 0.0, 1.0)


def _bands(sets: DataFrame, weights: np.ndarray) -> DataFrame:
    shared = sets.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                words = b.column("words")
                sizes = np.diff(words.offsets.to_numpy())
                elements = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(b.num_rows), sizes)
                rate = w[(elements % np.uint64(DF_BUCKETS)).astype(np.int64)].astype(np.float64)
                sig = prob_min_hash(owner, elements, rate, b.num_rows, ROWS * BANDS).reshape(b.num_rows, BANDS, ROWS)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (b.num_rows, BANDS)).copy()
                    for k in range(ROWS):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
                ids = np.repeat(b.column("set_no").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids), pa.array(np.repeat(sizes, BANDS).astype(np.int32))], ["band", "set_no", "size"])

    return sets.select("set_no", "words").mapInArrow(sign, _BAND)


def _blocks(n: str) -> F.Column:
    """How many blocks a group of ``n`` rows is split into."""
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _block_of(ident: str, n: str) -> F.Column:
    """The block of a member, by hash, so that no group is sorted or numbered in one place."""
    return F.pmod(F.xxhash64(ident), _blocks(n)).cast("int")


def _band_groups(bands: DataFrame) -> DataFrame:
    """(mark, set_no, size, n): the groups of sets that meet in a band, each group once, however many bands it meets in.

    The mark of a group is an order-free hash of its members; groups that
    collide are compared as one, which only adds candidates.
    """
    along = Window.partitionBy("band")
    met = bands.withColumn("n", F.count("*").over(along)).withColumn("mark", F.bit_xor(F.xxhash64("set_no")).over(along)).where("n > 1")
    return met.select(F.xxhash64("mark", "n").alias("mark"), "set_no", "size", "n").distinct()


def candidate_pairs(groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of one group whose sizes allow the similarity, each pair once.

    A group of n sets is cut into blocks of about ``BLOCK`` and every pair of
    blocks is a join key of its own, so a band that holds a third of all sets is
    spread over many tasks and no key pairs more than about BLOCK x BLOCK rows.
    """
    placed = groups.withColumn("own", _block_of("set_no", "n"))
    left = placed.select("mark", F.col("own").alias("u"), F.explode(F.sequence("own", _blocks("n") - 1)).alias("v"), F.col("set_no").alias("x"), F.col("size").alias("size_x"))
    right = placed.select("mark", F.explode(F.sequence(F.lit(0), "own")).alias("u"), F.col("own").alias("v"), F.col("set_no").alias("y"), F.col("size").alias("size_y"))
    low, high = F.least("size_x", "size_y"), F.greatest("size_x", "size_y")
    met = left.join(right.hint("merge"), ["mark", "u", "v"]).where(((F.col("u") < F.col("v")) | (F.col("x") < F.col("y"))) & (low >= high * F.lit(similarity) - F.lit(1e-9)))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_sets(sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Pairs (a, b) of set_no with a < b whose exact word similarity reaches ``similarity``.

    ``sets`` holds each distinct word set once: set_no long, words array<long>.
    Candidates meet in a band; pairs whose sizes alone rule them out are not
    emitted. The verification is exact, so the result holds no false pair. A
    pair at 0.8 is missed with probability below 1e-5 for usual word
    frequencies and 0.2 % in the worst case (all shared words common, all others rare).
    All joins are sort-merge joins by hint: the sizes the planner would guess
    for the outputs of Python stages are far too small to decide on a broadcast.
    """
    table, n = _frequency_table(sets)
    groups = materialize(_band_groups(_bands(sets, word_weights(table, n))), "groups")
    candidates = candidate_pairs(groups, similarity)
    wa = sets.select(F.col("set_no").alias("a"), F.col("words").alias("words_a"))
    wb = sets.select(F.col("set_no").alias("b"), F.col("words").alias("words_b"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    either = F.size("words_a") + F.size("words_b") - both
    return candidates.join(wa.hint("merge"), "a").join(wb.hint("merge"), "b").where(both >= either * F.lit(similarity) - F.lit(1e-9)).select("a", "b")


def opening_sets(requests: DataFrame) -> DataFrame:
    """(request_id, set_id, words) of every opening with at least five words, each request once."""
    rows = chat_rows(requests, ["request_id", "request"], only_ok=False)
    got = map_rows(rows, _set_rows, _SETS, batch=1000)
    return materialize(got, "openings")


def _members_and_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, set_no, n) of every opening, and (set_no, words, n) of every distinct word set; n counts the rows of the set. The numbers are fixed by writing the sets."""
    firsts = rows.groupBy("set_id").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    sets = materialize(firsts.withColumn("set_no", F.monotonically_increasing_id()), "sets")
    members = rows.select("request_id", "set_id").distinct().join(sets.select("set_id", "set_no", "n").hint("merge"), "set_id").select("request_id", "set_no", "n")
    return materialize(members, "members"), sets.select("set_no", "words", "n")


def near_duplicate_openings(requests: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: openings whose prompts share at least ``similarity`` of their words.

    Nulls, invalid JSON, several user messages and prompts under five words are
    left out; rows loaded twice count once; extra columns are ignored; an empty
    table gives no rows. Equal word sets are compared once, as one class, and
    only expanded to request pairs at the end, since the result lists requests;
    a class of very many copies is expanded block by block.
    """
    members, sets = _members_and_sets(opening_sets(requests))
    pairs = materialize(similar_sets(sets, similarity), "set-pairs")
    own = sets.where("n > 1").select(F.col("set_no").alias("a"), F.col("set_no").alias("b"))
    sizes = sets.select(F.col("set_no").alias("b"), "n")
    links = pairs.unionByName(own).join(sizes.hint("merge"), "b").select("a", "b", F.explode(F.sequence(F.lit(0), _blocks("n") - 1)).alias("block"))
    ma = members.select(F.col("set_no").alias("a"), F.col("request_id").alias("x"))
    mb = members.select(F.col("set_no").alias("b"), _block_of("request_id", "n").alias("block"), F.col("request_id").alias("y"))
    return (
        links.join(ma.hint("merge"), "a")
        .join(mb.hint("merge"), ["b", "block"])
        .where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )


def duplicate_classes(requests: DataFrame) -> DataFrame:
    """(request_id, class_id, n_links): openings with their class and the number of similar distinct prompts.

    Classes are connected components over set pairs, found by alternately
    taking minima over neighbours and jumping pointers; the tables are cut into
    the shared folder each round, the round before is deleted, and only a row
    count reaches the driver. A root with very many members is one row on one
    side of a sort-merge join of numbers, which the engine's skew handling splits.
    """
    members, sets = _members_and_sets(opening_sets(requests))
    pairs = materialize(similar_sets(sets), "set-pairs")
    edges = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "set-edges")
    links = edges.groupBy("a").agg(F.count("*").alias("n_links"))
    label, before = sets.select("set_no", F.col("set_no").alias("root")), None
    while True:
        near = edges.join(label.select(F.col("set_no").alias("b"), F.col("root").alias("seen")).hint("merge"), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = label.join(near.hint("merge"), label.set_no == near.a, "left").select("set_no", "root", F.least("root", F.coalesce("seen", "root")).alias("next"))
        hop = step.select(F.col("set_no").alias("next"), F.col("next").alias("far"))
        moved = materialize(step.join(hop.hint("merge"), "next").select("set_no", F.least("next", "far").alias("new"), "root"), "roots")
        discard(before)
        label, before = moved.select("set_no", F.col("new").alias("root")), moved
        if moved.where("new <> root").isEmpty():
            break
    named = members.select("request_id", "set_no").join(label.hint("merge"), "set_no")
    names = named.groupBy("root").agg(F.min("request_id").alias("class_id"))
    return (
        named.join(names.hint("merge"), "root")
        .join(links.hint("merge"), named.set_no == links.a, "left")
        .select("request_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
