"""From runs to training and validation sets: the ranking pipeline as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import matches, traces


def completed_pool(episodes: DataFrame, status: DataFrame) -> DataFrame:
    """(task, episode): episodes of which some run is completed."""
    done = status.where(traces.completed(F.col("exit_code"), F.col("trace_has_success_result"))).select("episode").distinct()
    return episodes.where("task is not null").select("task", "episode").distinct().join(done, "episode", "left_semi").select("task", "episode")


def rank_and_select(pool: DataFrame, verdicts: Callable[[DataFrame], DataFrame], opponents: int, seed: int, train: int, validation: int) -> DataFrame:
    """(task, episode, rank, band): schedule, verdicts, ratings, ranks and bands per task.

    ``verdicts`` adds ``winner`` (A, B or tie) to the scheduled pairs: a join to a
    table of judgments. Tasks with fewer episodes than the validation rank still
    get ranks, but no validation episode.
    """
    pairs = matches.tournament(pool, "task", "episode", opponents, seed)
    judged = verdicts(pairs).select(F.concat_ws("|", F.col("task").cast("string"), "a", "b").alias("match_id"), "task", "a", "b", "winner")
    rated = matches.ratings(judged, "task").withColumnRenamed("item", "episode")
    return matches.rank_bands(rated, "task", "episode", "rating", train, validation)


def split_errors(selected: DataFrame) -> DataFrame:
    """(episode, bands): episodes in more than one band other than none."""
    used = selected.where("band <> 'none'").groupBy("episode").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    return used.where(F.size("bands") > 1)
