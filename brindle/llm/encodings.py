"""Garbled text from wrong encodings: latent encoding chains, EM over sources, repair by posterior.

A chain (w, t) says: bytes of encoding t were decoded with w. Undoing it is
``stretch.encode(w).decode(t)``, so the likelihood of a stretch under a chain is
the likelihood of the undone text under a character model of the corpus. Weak
evidence is pooled: stretches of one document add up, and per source the prior
of every chain is learned by expectation-maximization over all documents.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from brindle.plans.materialize import discard, materialize

#: The character model has tables of these fixed sizes, whatever the corpus.
UNIGRAMS, BIGRAMS = 1 << 16, 1 << 21
#: Share of a garbled document's stretches that are garbled; what one clean stretch costs follows from it.
STRETCH_SHARE = 0.03
#: Only the part of a text that speaks most for a chain counts, so clean text elsewhere costs nothing; it has at least so many stretches, or all.
PART = 160
_CLEAN = math.log(1 - STRETCH_SHARE)
#: Evidence of one stretch is bounded, so that no single stretch outweighs all others.
STRETCH_BOUND = 25.0
#: Ordinary text seldom forms valid UTF-8 sequences by chance; each continuation byte found in place speaks for the chain by so much.
SEQUENCE = 3.5
#: Prior share of garbled documents before the first round, and pseudo-documents behind it.
PRIOR, STRENGTH = 0.05, 100.0
ROUNDS = 6
#: Posterior from which a document counts as garbled: a missed one spoils training text, a false alarm is only looked at again.
CUTOFF = 0.1
#: A chain that the rest of the document says nothing for still has this share when a stretch is repaired.
LEAST_SHARE = 1e-5
#: The priors of the sources are broadcast up to so many sources; beyond, they are joined by shuffle, each split into SALTS keys.
SMALL_SOURCES, SALTS = 10_000, 16
#: A stretch that a text repeats is the same observation again: it counts so often at most in the evidence (in the repair every occurrence is mended).
REPEATS = 3

# Encodings a text may have been decoded with, or written in.
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "iso8859-15", "cp1254", "cp1253")
MULTI = ("utf-8", "gb18030", "cp932", "euc_jp", "big5", "euc_kr")
READ_AS = (*SINGLE, "gb18030", "big5", "cp932", "euc_kr")
LOST = "lost"
CHAINS = [(w, t) for w in READ_AS for t in (*MULTI, *SINGLE) if w != t]
_WAYS = {w: [(i, t) for i, (x, t) in enumerate(CHAINS) if x == w] for w in READ_AS}

_TOKEN = re.compile(r"[A-Za-z'\u0080-\U0010ffff]*[\u0080-\U0010ffff][A-Za-z'\u0080-\U0010ffff]*")
_C1 = re.compile("[\u0080-\u0084\u0086-\u009f]")
#: Where '?' may stand for a lost character: inside a word, or after a blank, a bracket or a line start.
_MARKS = re.compile(r"(?<=[^\W\d_])\?+(?=[^\W\d_])|(?<![^\s(])\?+")
#: The same in the dialect of the scan, for texts that are ASCII otherwise.
MARKS_FILTER = r"[A-Za-z]\?+[A-Za-z]|(?:^|[\s(])\?"
#: Places where marks are usual after all: placeholders of SQL, regex groups, operators, table cells, git's short status.
_SQL = re.compile(r"\b(?:select|insert|update|delete|where|values)\b", re.I)
_CODE_MARK = re.compile(r"\(\?[:=!<>Pimsxu#-]|(?<=\S)[ \t]+\?(?=[ \t][^?\n]*[^?\s][^?\n]* : )|(?<=[\w\])'\"]) \?\?=? (?=[\w\['\"{(])|(?m:^[ \t]*)\?\? (?=[\w./\"-]*[./])|\|[ \t]*\?+[ \t]*(?=\|)")
_IN_CODE = re.compile(r"[/=&\\\[\]{}^$|*+<>_@#]")
#: French puts a blank before the mark that ends a sentence.
_FRENCH = re.compile(r"[\w»”\"')\]][ \u00a0\u202f]\?+[ !?]*(?=$|[»”\"')]|[ \u00a0][^\Wa-z\d_])")
#: Lost characters are weighed against the most frequent non-ASCII ones, over at most so many in a row.
LOST_CANDIDATES, LOST_RUN = 256, 4
#: Most that one run of marks can say.
LOST_BOUND = 12.0


@functools.cache
def _tables() -> tuple[dict[str, dict[str, int]], dict[str, list[str]]]:
    """Per single-byte encoding: character to byte, byte to character. Undefined bytes stand for C1 controls; for cp1252 the controls themselves count too, so it includes Latin-1."""
    to_byte: dict[str, dict[str, int]] = {}
    to_char: dict[str, list[str]] = {}
    for name in SINGLE:
        chars = [bytes([b]).decode(name, "replace") for b in range(256)]
        chars = [c if c != "\ufffd" else chr(b) for b, c in enumerate(chars)]
        to_char[name] = chars
        to_byte[name] = {c: b for b, c in enumerate(chars)}
        if name == "cp1252":
            to_byte[name] |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in to_byte[name]}
    return to_byte, to_char


@functools.cache
def _translations() -> tuple[dict[str, dict[int, int]], dict[str, dict[int, str]]]:
    """The tables in the form str.translate takes: to the Latin-1 character of a byte, and back."""
    to_byte, to_char = _tables()
    # Latin-1 characters that the encoding lacks must fail, so they go beyond Latin-1.
    there = {n: {b: 0x100 for b in range(256)} | {ord(c): b for c, b in t.items()} for n, t in to_byte.items()}
    back = {n: dict(enumerate(chars)) for n, chars in to_char.items()}
    return there, back


def _encode(text: str, name: str) -> bytes | None:
    try:
        return text.translate(_translations()[0][name]).encode("latin-1") if name in SINGLE else text.encode(name)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, name: str) -> str | None:
    if name in SINGLE:
        return data.decode("latin-1").translate(_translations()[1][name])
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        if name != "utf-8":
            return None
    text = data.decode(name, "replace")
    n = text.count("\ufffd")
    return text if n and any(ord(c) > 0x7F and c != "\ufffd" for c in text) and n * 3 <= len(text) else None


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uni, bi = np.zeros(UNIGRAMS, dtype=np.int64), np.zeros(BIGRAMS, dtype=np.int64)

    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        for k in range(0, len(texts), 500):
            joined = " " + " ".join(texts[k : k + 500]) + " "
            c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            uni += np.bincount(c % UNIGRAMS, minlength=UNIGRAMS)
            bi += np.bincount((c[:-1] * 1000003 + c[1:]) % BIGRAMS, minlength=BIGRAMS)
    for kind, table in ((0, uni), (1, bi)):
        at = np.nonzero(table)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(table[at])], ["kind", "bucket", "n"])


class CharacterModel:
    """log P(character | character before) from hashed counts, backed off to single characters."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray) -> None:
        self.uni, self.bi = uni, bi  # counts as floating-point numbers: they may exceed any integer type of half the size
        self.total = float(self.uni.sum())
        #: Characters seen at least twice; nothing can speak for others but the form of their bytes.
        self.known = frozenset(map(chr, np.nonzero(uni > 1)[0].tolist()))
        self._log: dict[tuple[str, str], float] = {}
        self._token: dict[str, list[tuple[int, float, str]]] = {}
        self._marks: dict[tuple[str, int, str], float] = {}
        self._likely: tuple[list[str], np.ndarray] | None = None

    def pair(self, a: str, b: str) -> float:
        got = self._log.get((a, b))
        if got is None:
            x, y = ord(a), ord(b)
            single = (self.uni[y % UNIGRAMS] + 0.02) / (self.total + 2000.0)
            first, second = self.uni[x % UNIGRAMS], self.uni[y % UNIGRAMS]
            both = min(self.bi[(x * 1000003 + y) % BIGRAMS], first, second)  # what collides is at least no more than either
            got = math.log((both + 8.0 * single) / (first + 8.0))
            if y == 0xFFFD or 0x80 <= y < 0xA0 and y != 0x85:
                got = min(got, -14.0)
            if len(self._log) > 2_000_000:
                self._log.clear()
            self._log[a, b] = got
        return got

    def score(self, text: str) -> float:
        get, last, total = self._log.get, " ", 0.0
        for c in text + " ":
            got = get((last, c))
            total += self.pair(last, c) if got is None else got
            last = c
        return total

    def score_above(self, text: str, floor: float) -> float:
        """The score, or minus infinity as soon as it can only end below ``floor``: no character adds to it."""
        get, last, total = self._log.get, " ", 0.0
        for c in text + " ":
            got = get((last, c))
            total += self.pair(last, c) if got is None else got
            if total <= floor:
                return -math.inf
            last = c
        return total

    def undo(self, token: str) -> list[tuple[int, float, str]]:
        """(chain index, log-likelihood ratio against "not garbled", undone token) of the chains that improve the token."""
        got = self._token.get(token)
        if got is None:
            got = self._undo(token)
            if len(self._token) > 300_000:
                self._token.clear()
            self._token[token] = got
        return got

    def _undo(self, token: str) -> list[tuple[int, float, str]]:
        own = self.score(token)
        out: list[tuple[int, float, str]] = []
        seen: dict[str, float] = {token: own}
        for w, ways in _WAYS.items():
            data = _encode(token, w)
            if data is None:
                continue
            for i, t in ways:
                text = _decode(data, t)
                if text is None or t != "utf-8" and not self.known.issuperset(text):
                    continue
                value = seen.get(text)
                if value is None or value == -math.inf and t == "utf-8":
                    value = seen[text] = self.score(text) if t == "utf-8" else self.score_above(text, own)
                value -= 2.0 * max(0, len(text) - len(token))
                if t == "utf-8":
                    value += SEQUENCE * (len(data) - len(text) if w in SINGLE else 1)
                    text, value = self._again(text, value, w, seen)
                if value > own:
                    out.append((i, min(STRETCH_BOUND if t == "utf-8" else _bound(token, text), value - own), text))
        if "\ufffd" in token:
            out.append((len(CHAINS), STRETCH_BOUND, token))
        elif not out and _C1.search(token):
            out.append((len(CHAINS), 8.0, token))
        return out

    def marks(self, run: tuple[str, int, str]) -> float:
        """Log-likelihood ratio of the likeliest non-ASCII characters against the '?' of a run (character before, length, character after)."""
        got = self._marks.get(run)
        if got is None:
            got = self._marks[run] = self._weigh_marks(*run)
        return got

    def _weigh_marks(self, before: str, n: int, after: str) -> float:
        if self._likely is None:
            order = np.argsort(-self.uni[0xA0:], kind="stable")[:LOST_CANDIDATES] + 0xA0
            chars = [chr(c) for c in order.tolist() if self.uni[c] > 1 and c != 0xFFFD and not 0xD800 <= c < 0xE000]
            self._likely = chars, np.array([[self.pair(a, b) for b in chars] for a in chars])
        chars, step = self._likely
        if not chars:
            return 0.0
        best = np.array([self.pair(before, c) for c in chars])
        for _ in range(n - 1):
            best = (best[:, None] + step).max(axis=0)
        lost = float((best + np.array([self.pair(c, after) for c in chars])).max())
        own = self.pair(before, "?") + (n - 1) * self.pair("?", "?") + self.pair("?", after)
        return min(LOST_BOUND, lost - own)

    def _again(self, text: str, value: float, wrong: str, seen: dict[str, float]) -> tuple[str, float]:
        """Undo UTF-8 read as ``wrong``, or as Latin-1, as often as that is more likely; each time makes the text shorter, so it ends."""
        improved = True
        while improved and not text.isascii():
            improved = False
            for w in dict.fromkeys((wrong, "cp1252")):
                data = _encode(text, w)
                more = _decode(data, "utf-8") if data is not None else None
                if more is not None and "\ufffd" not in more and len(more) < len(text):
                    known = seen.get(more)
                    if known is None or known == -math.inf:
                        known = seen[more] = self.score(more)
                    total = value - seen[text] + known + SEQUENCE * (len(data) - len(more))
                    if total > value:
                        text, value, improved = more, total, True
                        break
        return text, value


def _bound(token: str, text: str) -> float:
    """Most that a stretch can say for a chain whose bytes are valid anyway: a lone sign says little, a word a lot."""
    letters = sum(c.isalpha() for c in set(token)) + sum(c.isalpha() for c in set(text))
    return min(STRETCH_BOUND, 2.0 * letters)


_held: list[CharacterModel] = []


def _model(tables: tuple[np.ndarray, np.ndarray]) -> CharacterModel:
    """The model of these tables, kept between the tasks of a worker with all tokens it has weighed."""
    if not _held or _held[0].uni is not tables[0]:
        _held[:] = [CharacterModel(*tables)]
    return _held[0]


def character_model(documents: DataFrame) -> CharacterModel:
    """Counts over the texts of all documents; only two tables of fixed size reach the driver."""
    rows = documents.where("text is not null").select("text").mapInArrow(_count_characters, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    kind, bucket, n = (got.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    uni, bi = np.zeros(UNIGRAMS), np.zeros(BIGRAMS, dtype=np.float32)
    uni[bucket[kind == 0]] = n[kind == 0]
    bi[bucket[kind == 1]] = n[kind == 1]
    return CharacterModel(uni, bi)


def lost_marks(text: str) -> list[tuple[str, int, str]]:
    """(character before, length, character after) of the runs of '?' in places where no question mark can stand."""
    out: list[tuple[str, int, str]] = []
    for line in text.split("\n") if "?" in text else ():
        if "?" not in line or _SQL.search(line):
            continue
        usual = [m.span() for p in (_CODE_MARK, _FRENCH) for m in p.finditer(line)]
        for m in _MARKS.finditer(line):
            start, end = m.span()
            before, after = line[start - 1 : start] or "\n", line[end : end + 1] or "\n"
            if before.isalpha() and (after.isupper() or _IN_CODE.search(_word(line, start, end))):
                continue
            if not any(a <= start and end <= b or start < b <= end for a, b in usual):
                out.append((before, min(end - start, LOST_RUN), after))
    return out


def _word(line: str, start: int, end: int) -> str:
    """What stands around a stretch up to the next blanks."""
    left, right = line[:start].rsplit(None, 1), line[end:].split(None, 1)
    return (left[-1] if left else "") + (right[0] if right else "")


def evidence_of(text: str, model: CharacterModel) -> dict[int, float]:
    """Per chain, the log-likelihood ratio of the part of the document that speaks most for it against "no stretch is garbled"; U+FFFD and C1 controls that no chain explains decide by themselves."""
    stretches = Counter(_TOKEN.findall(text))
    marks = Counter(lost_marks(text))
    lost = len(CHAINS)
    hits: dict[int, list[tuple[int, int, float]]] = {}
    at = 0
    weighed = [(n, [(i, ratio) for i, ratio, _ in model.undo(token)]) for token, n in stretches.items()]
    weighed += [(n, [(lost, model.marks(run))]) for run, n in marks.items()]
    for n, ratios in weighed:
        n = min(n, REPEATS)
        for i, ratio in ratios:
            if ratio > 0:
                hits.setdefault(i, []).append((at, at + n, n * (math.log(1 - STRETCH_SHARE + STRETCH_SHARE * math.exp(ratio)) - _CLEAN)))
        at += n
    out = {i: v for i, found in hits.items() if (v := _best_part(found, min(at, PART))) > 0}
    if "\ufffd" in text:
        out[lost] = max(out.get(lost, 0.0), STRETCH_BOUND)
    elif _C1.search(text) and lost in hits:
        out[lost] = max(out.get(lost, 0.0), LOST_BOUND)
    return out


def _best_part(hits: list[tuple[int, int, float]], least: int) -> float:
    """Greatest evidence of a part of the text: gains of its hits (start, end, gain) less the cost of its stretches, of which there are at least ``least``."""
    best = -math.inf
    opened = math.inf  # least sum of gains and cost before a hit, among the hits that start at least ``least`` stretches back
    gains, k = [0.0], 0
    for _, _, gain in hits:
        gains.append(gains[-1] + gain)
    for m, (_, end, _) in enumerate(hits):
        while k <= m and hits[k][0] <= end - least:
            opened = min(opened, gains[k] + hits[k][0] * _CLEAN)
            k += 1
        best = max(best, gains[m + 1] + end * _CLEAN - opened)
        if k <= m:
            best = max(best, gains[m + 1] - gains[k] + least * _CLEAN)
    return best


_EVIDENCE = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("source", StringType()),
        StructField("chain", ArrayType(IntegerType())),
        StructField("weight", ArrayType(DoubleType())),
    ]
)


class _Odds:
    """The chains of a batch of documents, one after the other, with their log odds against "not garbled" under the priors of their sources."""

    def __init__(self, b: pa.RecordBatch, pooled: np.ndarray) -> None:
        chains = b.column("chain")
        counts = np.diff(chains.offsets.to_numpy())
        self.starts = np.cumsum(counts) - counts
        self.row = np.repeat(np.arange(b.num_rows), counts)
        self.chain = chains.flatten().to_numpy()
        names = b.column("source").dictionary_encode()
        self.names, self.source = names.dictionary.to_pylist(), names.indices.to_numpy()
        first = np.unique(self.source, return_index=True)[1]
        prior = np.tile(STRENGTH * pooled, (len(first), 1))
        for k, (size, seen, n) in enumerate(zip(*(b.column(c).take(pa.array(first)).to_pylist() for c in ("size", "seen", "n")))):
            prior[k, seen] += n
            prior[k, -1] += max(0.0, size - sum(n))
        own = self.source[self.row]
        self.odds = np.log(prior[own, self.chain]) - np.log(prior[own, -1]) + b.column("weight").flatten().to_numpy()

    def posterior(self, taken: np.ndarray | None = None) -> np.ndarray:
        """Of each chain, against the others (of those ``taken``) of its document and "not garbled"."""
        odds = self.odds if taken is None else np.where(taken, self.odds, -np.inf)
        top = np.maximum(0.0, np.maximum.reduceat(odds, self.starts)) if len(odds) else odds
        e = np.exp(odds - top[self.row])
        return e / (np.add.reduceat(e, self.starts) + np.exp(-top))[self.row] if len(odds) else e

    def alone(self) -> np.ndarray:
        """Of each chain, against "not garbled" only."""
        return 1 / (1 + np.exp(-np.clip(self.odds, -700, 700)))


def chain_posteriors(documents: DataFrame, model: CharacterModel | None = None, small_sources: int = SMALL_SOURCES) -> DataFrame:
    """(doc_id, posterior, chain, undoable, share, alone): documents with some evidence, their posterior of being garbled, their best chain, and the chains that can be undone with their posteriors, against each other and each alone against "not garbled"."""
    spark = documents.sparkSession
    model = model or character_model(documents)
    shared = spark.sparkContext.broadcast((model.uni, model.bi))
    # A null source is a source of its own, apart from the empty one.
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), "text")
    odd = rows.where(F.col("text").rlike("[^\\x00-\\x7f]") | F.col("text").rlike(MARKS_FILTER))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared.value)
        for b in batches:
            ids, names, chains, weights = [], [], [], []
            for doc_id, source, text in zip(*(c.to_pylist() for c in b.columns)):
                got = evidence_of(text, own)
                if got:
                    ids.append(doc_id)
                    names.append(source)
                    chains.append(list(got))
                    weights.append(list(got.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(chains, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))],
                ["doc_id", "source", "chain", "weight"],
            )

    evidence = materialize(odd.mapInArrow(weigh, _EVIDENCE), "chains")
    pooled, weighed = _fit_priors(evidence, rows.groupBy("source").agg(F.count("*").alias("size")), small_sources)
    shared_shares = spark.sparkContext.broadcast(pooled)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{w}<{t}" for w, t in CHAINS] + [LOST])
        for b in batches:
            if not b.num_rows:
                continue
            o = _Odds(b, shared_shares.value)
            p = o.posterior()
            kept = o.chain < len(CHAINS)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(o.row[kept], minlength=b.num_rows))].astype(np.int32))
            top = np.maximum.reduceat(p, o.starts)
            at = np.flatnonzero(p == top[o.row])
            best = at[np.unique(o.row[at], return_index=True)[1]]
            lists = (o.chain[kept].astype(np.int32), o.posterior(kept)[kept], o.alone()[kept])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.add.reduceat(p, o.starts)), pa.array(names[o.chain[best]].tolist()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists)], ["doc_id", "posterior", "chain", "undoable", "share", "alone"]
            )

    return weighed.mapInArrow(decide, "doc_id long, posterior double, chain string, undoable array<int>, share array<double>, alone array<double>")


def _with_priors(evidence: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """The evidence with size, seen and n of its source; a source may hold any share of the rows."""
    if small:
        return evidence.join(F.broadcast(sources), "source")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return evidence.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["source", "salt"]).drop("salt")


def _fit_priors(evidence: DataFrame, sizes: DataFrame, small_sources: int = SMALL_SOURCES) -> tuple[np.ndarray, DataFrame]:
    """The shares of the chains and of clean documents (last) over all, and the evidence with what its source was found to hold, by EM.

    The state is a table with one row a source; the driver only sees the sums by
    chain. Sources of few documents lean on the pooled shares, whatever their number.
    """
    spark = evidence.sparkSession
    k = len(CHAINS) + 2
    base = np.full(k, PRIOR / (k - 1))
    base[-1] = 1 - PRIOR
    sizes = materialize(sizes, "source-sizes")
    total, n_sources = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    small = n_sources <= small_sources
    empty = (F.array().cast("array<int>").alias("seen"), F.array().cast("array<double>").alias("n"))
    pooled, state, before = base, sizes.select("source", F.lit(0).cast("long").alias("size"), *empty), None
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(pooled)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    o = _Odds(b, shared.value)
                    n = np.bincount(o.source[o.row] * k + o.chain, o.posterior(), len(o.names) * k)
                    at = np.flatnonzero(n > 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array([o.names[i] for i in (at // k).tolist()], pa.string()), pa.array((at % k).astype(np.int32)), pa.array(n[at])], ["source", "chain", "n"])

        joined = _with_priors(evidence.select("doc_id", "source", "chain", "weight"), state, small)
        got = joined.mapInArrow(expect, "source string, chain int, n double").groupBy("source", "chain").agg(F.sum("n").alias("n"))
        found = got.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("chain", "n"))).alias("found"))  # at most one entry a chain
        held = sizes.join(found.hint("merge"), "source", "left").select("source", "size", F.coalesce("found.chain", empty[0]).alias("seen"), F.coalesce("found.n", empty[1]).alias("n"))
        state = materialize(held, "source-priors")
        discard(before)
        before = state
        over = np.zeros(k)
        for r in state.select(F.explode(F.arrays_zip("seen", "n")).alias("x")).groupBy("x.seen").agg(F.sum("x.n").alias("n")).collect():  # one row a chain
            over[r["seen"]] = r["n"]
        over[-1] = max(0.0, total - over.sum())
        pooled = (over + STRENGTH * base) / (over.sum() + STRENGTH)
    return pooled, _with_priors(evidence, state, small)


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id): documents that hold at least one garbled stretch.

    Null and empty texts are clean; a null source is a source of its own; U+FFFD
    counts as garbled, since decoders write it for lost characters, and so does
    '?' where no question mark can stand.
    """
    return chain_posteriors(documents).where(F.col("posterior") > CUTOFF).select("doc_id")


def repair_text(text: str, shares: dict[int, tuple[float, float]], model: CharacterModel) -> str:
    """Undo in every stretch the chain that improves it most, if clearly, again until none does (or a text comes back); ``shares`` (posteriors of the document's chains against each other and alone) are the prior."""
    need = math.log((1 - STRETCH_SHARE) / STRETCH_SHARE)
    logs = {i: (math.log(max(v, LEAST_SHARE)), math.log(max(w, LEAST_SHARE))) for i, (v, w) in shares.items()}
    least = (math.log(LEAST_SHARE),) * 2
    known: dict[str, str] = {}

    def once(m: re.Match) -> str:
        token = m.group(0)
        fixed = known.get(token)
        if fixed is None:
            best, fixed = -math.inf, token
            for i, ratio, undone in model.undo(token):
                against, alone = logs.get(i, least)
                if i < len(CHAINS) and ratio + alone > need and ratio + against > best:
                    best, fixed = ratio + against, undone
            known[token] = fixed
        return fixed

    met: set[str] = set()
    while text not in met:
        met.add(text)
        text = _TOKEN.sub(once, text)
    return text


def repaired_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, chain, text, changed): the garbled documents with their most probable chain, and their texts restored stretch by stretch where a chain can be undone."""
    model = character_model(documents)
    found = materialize(chain_posteriors(documents, model).where(F.col("posterior") > CUTOFF).select("doc_id", "chain", "undoable", "share", "alone"), "garbled")
    shared = documents.sparkSession.sparkContext.broadcast((model.uni, model.bi))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            fixed = [repair_text(t, dict(zip(c, zip(p, q))), own) for t, c, p, q in zip(texts, *(b.column(x).to_pylist() for x in ("undoable", "share", "alone")))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("chain"), pa.array(fixed, pa.string()), pa.array([a != c for a, c in zip(fixed, texts)], pa.bool_())], ["doc_id", "chain", "text", "changed"]
            )

    rows = documents.select("doc_id", "text").join(found.hint("merge"), "doc_id")
    return rows.mapInArrow(mend, "doc_id long, chain string, text string, changed boolean")
