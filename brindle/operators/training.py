"""Training plans: samplers, schedules, exposure, losses, checkpoints, crops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import md5_uniform
from brindle.plans.materialize import materialize


def stratified_draws(windows: DataFrame, draws: DataFrame, p_first: float, seed: int, first: str = "orch", second: str = "nonmain") -> DataFrame:
    """(rank, step, window_id): a task uniformly, then a role (``first`` with probability ``p_first`` where both exist), then a window uniformly.

    ``windows``: window_id, task, role_group. Every draw is a function of seed,
    rank, step and the numbered strata, so it can be repeated in any order.
    """
    numbered = windows.select("window_id", "task", "role_group").withColumn("k", F.row_number().over(Window.partitionBy("task", "role_group").orderBy("window_id")))
    sizes = windows.groupBy("task").agg(F.count_if(F.col("role_group") == first).alias("n1"), F.count_if(F.col("role_group") == second).alias("n2"))
    tasks = sizes.withColumn("t", F.row_number().over(Window.orderBy("task")))  # one task, over one row a task
    u = lambda salt: md5_uniform(F.lit(str(seed)), F.col("rank").cast("string"), F.col("step").cast("string"), F.lit(salt))
    n_tasks = sizes.agg(F.count("*")).scalar()
    picked = draws.withColumn("t", (F.floor(u("task") * n_tasks) + 1).cast("int")).join(tasks, "t")
    role = F.when(F.col("n2") == 0, first).when(F.col("n1") == 0, second).when(u("role") < p_first, first).otherwise(second)
    sized = picked.withColumn("role_group", role).withColumn("n", F.when(F.col("role_group") == first, F.col("n1")).otherwise(F.col("n2")))
    return sized.withColumn("k", (F.floor(u("window") * F.col("n")) + 1).cast("int")).join(numbered, ["task", "role_group", "k"]).select("rank", "step", "window_id")


def weighted_draws(windows: DataFrame, weights: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """(rank, step, window_id): a condition by weight (1 where it has none), then a window of it uniformly.

    The conditions are intervals of running weight. The axis is cut into as
    many cells as there are conditions; an interval is listed in every cell it
    touches and a draw looks into its own cell, so the join is by equality. The
    running sum takes one task, over one row a condition.
    """
    numbered_windows = windows.select("window_id", "condition").withColumn("k", F.row_number().over(Window.partitionBy("condition").orderBy("window_id")))
    sizes = windows.groupBy("condition").agg(F.count("*").alias("n")).join(weights, "condition", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    along = Window.orderBy("condition")
    summed = sizes.withColumn("hi", F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edges = materialize(summed.select("condition", "n", "hi", F.coalesce(F.lag("hi").over(along), F.lit(0.0)).alias("lo")), "edges")
    total, cells = edges.agg(F.max("hi"), F.count("*")).first()
    cell = lambda x: F.least(F.floor(x * F.lit(cells / (total or 1.0))).cast("long"), F.lit(max(0, cells - 1)).cast("long"))
    listed = edges.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    u = lambda salt: md5_uniform(F.lit(str(seed)), F.col("rank").cast("string"), F.col("step").cast("string"), F.lit(salt))
    at = draws.withColumn("at", u("condition") * F.lit(total or 0.0)).withColumn("cell", cell(F.col("at")))
    drawn = at.join(listed.hint("merge"), "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    return drawn.withColumn("k", (F.floor(u("window") * F.col("n")) + 1).cast("int")).join(numbered_windows.hint("merge"), ["condition", "k"]).select("rank", "step", "window_id")


def total_steps(n: int, epochs: float, batch: int) -> int:
    return max(1, math.ceil(epochs * n / batch))


def schedule(spark: SparkSession, steps: int, warmup: int, peak: float, floor: float) -> DataFrame:
    """(step, lr): linear warm-up to ``peak``, then a cosine down to ``floor`` of it."""
    s = F.col("step")
    rest = F.least(F.lit(1.0), (s - warmup) / max(1, steps - warmup))
    lr: Column = F.when(s < warmup, peak * (s + 1) / max(1, warmup)).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * rest))))
    return spark.range(steps).select(F.col("id").alias("step")).select("step", F.round(lr, 9).alias("lr"))


def exposure(draws: DataFrame) -> DataFrame:
    """(task, role, draws, tokens, windows): from parallel arrays of rows, strata and tokens per step."""
    one = draws.select(F.explode(F.arrays_zip("rows", "strata", "tokens")).alias("d")).select("d.rows", "d.strata", "d.tokens")
    return one.groupBy("strata").agg(F.count("*").alias("draws"), F.sum("tokens").cast("long").alias("tokens"), F.countDistinct("rows").alias("windows"))


def grouped_losses(losses: DataFrame, grains: list[str]) -> DataFrame:
    """One row per value of every grain and one overall: summed loss over at least one token, in one pass."""
    sets = losses.groupingSets([[losses[g]] for g in grains] + [[]], *(losses[g] for g in grains))
    return sets.agg(F.round(F.sum("loss") / F.greatest(F.lit(1), F.sum("tokens")), 4).alias("mean_loss"), F.sum("tokens").cast("long").alias("tokens"))


def best_checkpoint(log: DataFrame, saved: DataFrame) -> DataFrame:
    """(step, val_loss): the least loss among saved steps above 0, the earliest of equals; a null or non-finite loss there is an error."""
    rows = log.where("step > 0").join(saved.select("step").distinct(), "step", "left_semi")
    bad = F.isnan("val_loss") | F.col("val_loss").isNull() | (F.abs("val_loss") == float("inf"))
    checked = rows.withColumn("val_loss", F.when(bad, F.raise_error(F.lit("loss is not finite")).cast("double")).otherwise(F.col("val_loss")))
    return checked.agg(F.min(F.struct("val_loss", "step")).alias("m")).select("m.step", "m.val_loss")


def tail_crop(blocks: DataFrame, n: int) -> DataFrame:
    """(block_id, n_kept, first_id, trainable): ids and mask cut to their last ``n``; trainable if a mask bit after the first position is set."""
    rows = blocks.where("block_id is not null and ids is not null and mask is not null and size(ids) > 0 and size(ids) = size(mask)").dropDuplicates(["block_id"])
    keep = F.least(F.lit(n), F.size("ids"))
    ids, mask = F.slice("ids", -keep, keep), F.slice("mask", -keep, keep)
    return rows.select("block_id", keep.cast("long").alias("n_kept"), F.element_at(ids, 1).alias("first_id"), F.exists(F.slice(mask, F.lit(2), F.greatest(keep - 1, F.lit(0))), lambda m: m == 1).alias("trainable"))


def absmax_scales(vectors: DataFrame, limit: float = 448.0) -> DataFrame:
    """(vec_id, scale): the largest absolute value over ``limit``, at least 1e-12."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return vectors.select("vec_id", F.round(F.greatest(F.array_max(v) / limit, F.lit(1e-12)), 12).alias("scale"))
