"""One global ranking from pairwise comparisons: offence-defence scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.plans.materialize import discard, materialize

#: Wins added to either side of every pair, so that each item has beaten and lost to each other a little.
SMOOTHING = 0.05
#: Up to so many items the square win matrix (8 MB at most) is scaled in one place; beyond, in distributed sweeps with the same stopping rule, so the result is the same.
LOCAL_ITEMS = 1000
#: Sweeps end when no defence moves by more than TOLERANCE in the logarithm, or after SWEEPS.
SWEEPS, TOLERANCE = 400, 1e-12


def win_matrix(judgments: DataFrame, items: DataFrame, name: str = "workflow") -> DataFrame:
    """(item, other, wins, n): wins of item over other, ties and unknown labels counting half, both directions.

    Comparisons with null, unknown or equal sides do not count; rows with the
    same match_id count once. Pre-aggregated before any shuffle by pair.
    """
    known = items.where(F.col(name).isNotNull()).select(F.col(name).alias("item")).distinct()
    # Trimming also removes no-break and zero-width blanks.
    label = F.upper(F.regexp_replace("winner", r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$", ""))
    matches = (
        judgments.where("a is not null and b is not null and a <> b")
        .select("match_id", "a", "b", F.when(label == "A", 1.0).when(label == "B", 0.0).otherwise(0.5).alias("score"))
        .dropDuplicates(["match_id"])
        .groupBy("a", "b")
        .agg(F.sum("score").alias("won"), F.count("*").alias("n"))
        .join(known.select(F.col("item").alias("a")).hint("merge"), "a", "left_semi")
        .join(known.select(F.col("item").alias("b")).hint("merge"), "b", "left_semi")
    )
    there = matches.select(F.col("a").alias("item"), F.col("b").alias("other"), F.col("won").alias("wins"), "n")
    back = matches.select(F.col("b").alias("item"), F.col("a").alias("other"), (F.col("n") - F.col("won")).alias("wins"), "n")
    return there.unionByName(back).groupBy("item", "other").agg(F.sum("wins").alias("wins"), F.sum("n").alias("n"))


def scale_offence_defence(wins: np.ndarray, smoothing: float = SMOOTHING, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Log strengths of the items of a square win matrix.

    Sinkhorn sweeps find row and column factors that make the smoothed matrix
    doubly stochastic. With offence o = 1 / row factor and defence d = 1 /
    column factor: o = W (1 / d) and d = W' (1 / o), and an item's strength is
    o / d. If item i beats j with odds s_i : s_j, then W = diag(s) times a
    symmetric matrix, whatever the numbers of comparisons, and o / d is
    proportional to s; uneven schedules therefore cancel.
    """
    w = wins + smoothing
    np.fill_diagonal(w, smoothing)
    defence = np.ones(len(w))
    for _ in range(sweeps):
        offence = w @ (1 / defence)
        nxt = w.T @ (1 / offence)
        moved = np.abs(np.log(nxt / defence)).max() if len(w) else 0.0
        defence = nxt
        if moved < tolerance:
            break
    offence = w @ (1 / defence)
    strength = np.log(offence) - np.log(defence)
    return strength - strength.mean() if len(w) else strength


def global_ranking(judgments: DataFrame, items: DataFrame, name: str = "workflow", local_items: int = LOCAL_ITEMS) -> DataFrame:
    """(workflow, rank, strength, n_comparisons) of all items; ties are broken by name.

    Items without comparisons get the mean strength through smoothing; an empty
    item table gives no rows.
    """
    spark = judgments.sparkSession
    matrix = materialize(win_matrix(judgments, items, name), "wins")
    known = items.where(F.col(name).isNotNull()).select(F.col(name).alias("item")).distinct()
    n_items = known.limit(local_items + 1).count()
    if n_items <= local_items:
        names = sorted(r[0] for r in known.collect())
        at = {x: i for i, x in enumerate(names)}
        wins, played = np.zeros((len(names), len(names))), np.zeros(len(names))
        for r in matrix.collect():  # at most local_items squared
            wins[at[r["item"]], at[r["other"]]] += r["wins"]
            played[at[r["item"]]] += r["n"]
        strength = scale_offence_defence(wins)
        order = sorted(range(len(names)), key=lambda i: (-round(strength[i], 9), names[i]))
        rows = [(names[i], k, round(float(strength[i]), 6) + 0.0, int(played[i])) for k, i in enumerate(order, 1)]
        return spark.createDataFrame(rows, f"{name} string, rank long, strength double, n_comparisons long")
    return _distributed(matrix, known, name)


def _half_step(matrix: DataFrame, state: DataFrame, new: str, old: str) -> DataFrame:
    """``state`` with the column ``new`` computed from ``old``; smoothing enters through a total, so no dense matrix is built.

    The win table is summed by item before anything else, and an item with very
    many opponents is one key of a partial aggregation, not of a join.
    """
    key, other = ("item", "other") if new == "offence" else ("other", "item")
    total = state.agg(F.sum(1 / F.col(old))).scalar()
    shares = state.select(F.col("item").alias(other), (1 / F.col(old)).alias("share"))
    part = matrix.join(shares.hint("merge"), other).groupBy(F.col(key).alias("item")).agg(F.sum(F.col("wins") * F.col("share")).alias("part"))
    fresh = F.coalesce("part", F.lit(0.0)) + F.lit(SMOOTHING) * total
    return state.join(part.hint("merge"), "item", "left").select(*(fresh.alias(c) if c == new else F.col(c) for c in state.columns))


def _distributed(matrix: DataFrame, known: DataFrame, name: str, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same sweeps over the sparse win table; each sweep is a table in the shared folder, and the one before is deleted."""
    state, before = known.select("item", F.lit(1.0).alias("offence"), F.lit(1.0).alias("defence"), F.lit(1.0).alias("last")), None
    for i in range(sweeps):
        state = _half_step(matrix, state.withColumn("last", F.col("defence")), "offence", "defence")
        state = materialize(_half_step(matrix, state, "defence", "offence"), f"sweep{i}")
        discard(before)
        before = state
        moved = state.agg(F.max(F.abs(F.log(F.col("defence") / F.col("last"))))).first()[0]
        if moved is None or moved < tolerance:
            break
    state = materialize(_half_step(matrix, state, "offence", "defence"), "scaled")
    discard(before)
    played = matrix.groupBy("item").agg(F.sum("n").alias("n_comparisons"))
    mean = state.agg(F.avg(F.log("offence") - F.log("defence"))).scalar()
    scored = state.select("item", (F.log("offence") - F.log("defence") - mean).alias("strength"))
    counted = scored.join(played.hint("merge"), "item", "left").select("item", "strength", F.coalesce("n_comparisons", F.lit(0).cast("long")).alias("n_comparisons"))
    return _ranked(counted, name)


def _ranked(scored: DataFrame, name: str) -> DataFrame:
    """Ranks by a range sort: position inside the range plus the sizes of the ranges before it."""
    spread = scored.withColumn("key", -F.round("strength", 9)).repartitionByRange("key", "item").sortWithinPartitions("key", "item")
    placed = materialize(spread.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "ranked")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return placed.join(F.broadcast(before), "part").select(  # one row a range
       
        F.col("item").alias(name), (F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long").alias("rank"), (F.round("strength", 6) + F.lit(0.0)).alias("strength"), "n_comparisons"
    )


def leaders(judgments: DataFrame, items: DataFrame, k: int = 6) -> DataFrame:
    """(workflow): the k items that lead the global ranking."""
    return global_ranking(judgments, items).where(F.col("rank") <= k).select("workflow")
