"""Version histories: champions, score-boards, deltas, recurring issues."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from brindle.functions.text import action_items, shorten
from brindle.plans.folds import fold_by_key
from brindle.plans.ranges import numbered


def champions(rounds: DataFrame, key: str, baseline: bool) -> DataFrame:
    """(key, champion, has_win, needs): who holds the crown after the last version of every key.

    ``rounds``: key, version, winner, arbitration (map<long, string>: reigning
    champion to winner of its direct match against this version). Winner B
    means that the version won: against its predecessor, or, in ``baseline``
    mode, against the baseline. A winning version takes the crown if it beat the
    holder directly (its predecessor, or an unproven holder in baseline mode) or
    won the arbitration against it. ``needs``: the last version won, but the
    deciding match is missing. Versions before 1 only count as proof in baseline mode.
    """
    kind = rounds.schema[key].dataType
    out = StructType([StructField(key, kind), StructField("champion", LongType()), StructField("has_win", BooleanType()), StructField("needs", BooleanType())])

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        holder, proven, needs = 0, False, False
        for _, version, winner, arbitration in rows:
            needs = False
            if winner != "B":
                continue
            if version == 0:
                proven = baseline
                continue
            direct = not proven if baseline else holder == version - 1
            verdict = None if direct else dict(arbitration or {}).get(holder, "missing")
            if direct or verdict == "B":
                holder, proven = version, True
            needs = verdict == "missing"
        yield k[0], holder, proven, needs

    return fold_by_key(rounds.select(key, "version", "winner", "arbitration"), [key], ["version"], fold, out)


def scoreboards(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, board): one mark a version, W, L, T or ? where it was not judged, from 0 to the last version."""
    mark = F.when(F.col("winner") == "B", "W").when(F.col("winner") == "A", "L").when(F.col("winner") == "tie", "T").otherwise("?")
    last = verdicts.groupBy(key).agg(F.max("version").alias("last"), F.map_from_entries(F.collect_list(F.struct(F.col("version").cast("long"), mark))).alias("marks"))
    cell = lambda v: F.concat(F.lit("v"), v.cast("string"), F.lit(" "), F.coalesce(F.try_element_at(F.col("marks"), v), F.lit("?")))
    return last.select(key, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long")), cell), " · ").alias("board"))


def version_deltas(texts: DataFrame, key: str, order: str, newest: int = 3, long: int = 1500, short: int = 400) -> DataFrame:
    """(order, version, delta, kept): position within the key, change of length against the predecessor, length of the text cut by recency.

    The lengths are taken before anything is shuffled; texts stay in the scan.
    """
    length = F.length("text").cast("long")
    sizes = texts.select(key, order, length.alias("n"), F.length(shorten(F.col("text"), long)).cast("long").alias("long"), F.length(shorten(F.col("text"), short)).cast("long").alias("short"))
    placed = numbered(sizes, key, order, ("n",))
    recent = F.col("total") - F.col("position") < newest
    return placed.select(order, F.col("position").cast("long").alias("version"), (F.col("n") - F.col("before_n")).alias("delta"), F.when(recent, F.col("long")).otherwise(F.col("short")).alias("kept"))


# Recurring issues and the patterns that speak of them.
ISSUES = (
    ("report-metrics inconsistency", "inconsistent|mismatch|contradict|does not match|conflict"),
    ("missing deliverables or sections", "missing|absent|not found|not present"),
    ("stability/robustness gap", "stability|robustness|subperiod|pre_2020|post_2020"),
    ("null/nan quality defect", "nan|null|none|non-standard json"),
    ("reproducibility gap", "reproducibility|not reproducible|cannot reproduce|requirements|pin"),
    ("validation/test weakness", "validation|test|insufficient evidence|not proven|unclear"),
)


def issue_counts(texts: DataFrame, order: str) -> DataFrame:
    """(bucket, n, example), most frequent first, of equal counts in the order of ``ISSUES``: texts that speak of each issue, each counted once, with the first action item of the earliest of them that has one; one pass, no cross join."""
    low = F.lower("text")
    hits = F.filter(F.array(*(F.when(low.rlike(p), F.struct(F.lit(k).alias("k"), F.lit(name).alias("bucket"))) for k, (name, p) in enumerate(ISSUES))), lambda x: x.isNotNull())
    item = F.get(action_items(F.col("text"), 1), F.lit(0))
    rows = texts.where(F.length(F.trim("text")) > 0).select(order, F.explode(hits).alias("hit"), item.alias("item"))
    counted = rows.groupBy("hit").agg(F.count("*").alias("n"), F.min(F.when(F.col("item").isNotNull(), F.struct(F.col(order), F.col("item")))).alias("e"))
    return counted.orderBy(F.desc("n"), "hit.k").select("hit.bucket", "n", F.col("e.item").alias("example"))
