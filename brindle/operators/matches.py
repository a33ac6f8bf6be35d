"""Matches: schedules, win counts, ratings, ranks and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_label(label: Column) -> Column:
    """A, B or tie: trimmed and in upper case; whatever names neither side is a tie."""
    up = F.upper(F.btrim(label))
    return F.when(up == "A", "A").when(up == "B", "B").otherwise("tie")


def unswap(winner: Column, swapped: Column) -> Column:
    """The winner in terms of the original order, where it was given in terms of the presented one."""
    return F.when(swapped & (winner == "A"), "B").when(swapped & (winner == "B"), "A").otherwise(winner)


def win_rates(matches: DataFrame, by: str) -> DataFrame:
    """(by, wins, losses, ties, win_rate): rate over decisive matches, null where there are none."""
    label = clean_label(F.col("winner"))
    got = matches.dropDuplicates(["match_id"]).groupBy(by).agg(
        F.count_if(label == "A").alias("wins"), F.count_if(label == "B").alias("losses"), F.count_if(label == "tie").alias("ties")
    )
    return got.withColumn("win_rate", F.round(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), 6))


def tournament(competitors: DataFrame, task: str, name: str, opponents: int, seed: int) -> DataFrame:
    """(task, a, b): every competitor meets the ``opponents`` nearest on a ring in hashed order, each pair once, its sides turned by a hash bit.

    ``opponents`` must be even and at least 2. Where a task has no more than
    ``opponents`` competitors, the ring distances coincide and every pair occurs once.
    """
    if opponents < 2 or opponents % 2:
        raise ValueError("opponents must be even and at least 2")
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(task).cast("string"), F.col(name)))
    w = Window.partitionBy(task).orderBy(order, name)
    ring = competitors.select(task, name).distinct().withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(task)))
    steps = ring.select(task, F.col(name).alias("x"), "i", "n", F.explode(F.sequence(F.lit(1), F.lit(opponents // 2))).alias("step"))
    ahead = steps.select(task, "x", ((F.col("i") + F.col("step")) % F.col("n")).alias("j"))
    met = ahead.join(ring.select(task, F.col(name).alias("y"), F.col("i").alias("j")), [task, "j"]).where(F.col("x") != F.col("y"))
    pairs = met.select(task, F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).distinct()
    turn = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(task).cast("string"), F.col("p"), F.col("q"))), 1, 1) < F.lit("8")
    return pairs.select(task, F.when(turn, F.col("q")).otherwise(F.col("p")).alias("a"), F.when(turn, F.col("p")).otherwise(F.col("q")).alias("b"))


def win_counts(matches: DataFrame, by: str) -> DataFrame:
    """(by, i, j, wins): wins of i over j, ties half; matches of one with itself and nulls do not count."""
    score = F.when(clean_label(F.col("winner")) == "A", 1.0).when(clean_label(F.col("winner")) == "B", 0.0).otherwise(0.5)
    own = matches.where("a is not null and b is not null and a <> b").dropDuplicates(["match_id"]).select(by, "a", "b", score.alias("s"))
    sides = own.select(by, F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), F.col("s").alias("wins")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), (1 - F.col("s")).alias("wins")))).alias("r"))
    return sides.groupBy(by, "r.i", "r.j").agg(F.sum("r.wins").alias("wins"))


def strengths(one: np.ndarray, other: np.ndarray, wins: np.ndarray, n: int, rounds: int = 500, prior: float = 0.5) -> np.ndarray:
    """Log strengths of n items by minorisation-maximisation, from wins of ``one`` over ``other``; every item has ``prior`` wins against strength 1; the mean strength is 1.

    Only pairs that met are held, so memory follows the pairs and not the square of the items.
    """
    a, b, games = np.r_[one, other], np.r_[other, one], np.r_[wins, wins]
    gained = np.bincount(one, wins, n) + prior
    p = np.ones(n)
    for _ in range(rounds):
        p = gained / (prior / (p + 1.0) + np.bincount(a, games / (p[a] + p[b]), n))
        p = p / p.mean()
    return np.log(p)


def ratings(matches: DataFrame, by: str) -> DataFrame:
    """(by, item, rating): one fit per group, over counts by pair that were aggregated before."""
    kind = matches.schema[by].dataType.simpleString()

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items, at = np.unique(np.r_[rows["i"].to_numpy(str), rows["j"].to_numpy(str)], return_inverse=True)
        got = strengths(at[: len(rows)], at[len(rows) :], rows["wins"].to_numpy(float), len(items))
        return pd.DataFrame({by: [key[0]] * len(items), "item": items.tolist(), "rating": np.round(got, 6) + 0.0})

    return win_counts(matches, by).where(F.col(by).isNotNull()).groupBy(by).applyInPandas(fit, f"{by} {kind}, item string, rating double")


def rank_bands(scored: DataFrame, by: str, name: str, score: str, train: int = 15, validation: int = 16) -> DataFrame:
    """(by, name, rank, band): ranks by score, ties by name; band train up to rank ``train``, validation at one rank, else none."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), name)
    r = F.col("rank")
    return scored.select(by, name, F.row_number().over(w).cast("long").alias("rank")).withColumn("band", F.when(r <= train, "train").when(r == validation, "validation").otherwise("none"))
