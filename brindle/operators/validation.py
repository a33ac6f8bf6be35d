"""Validation: configurations, ranges, provenance, budgets, paths."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def config_errors(config: dict) -> list[str]:
    """What is wrong with a configuration: task lists that overlap, repeat or do not add up, numbers out of range, endpoints off the machine."""
    tasks = config.get("tasks", {})
    train, test, left_out, candidates = (tasks.get(k, []) for k in ("train", "test", "excluded", "train_candidates"))
    ranking = config.get("ranking", {})
    found = [f"{k} repeats tasks" for k, v in tasks.items() if len(set(v)) != len(v)]
    if set(train) & set(test):
        found.append("train and test share tasks")
    if candidates and set(train) | set(left_out) != set(candidates):
        found.append("train and excluded do not make up the candidates")
    opponents, top, validation = (ranking.get(k) for k in ("opponents", "train_top", "validation_rank"))
    if opponents is not None and (opponents < 2 or opponents % 2):
        found.append("opponents must be even and at least 2")
    if top is not None and validation is not None and not 0 < top < validation:
        found.append("the validation rank must follow the training ranks")
    if "endpoint" in config and urlparse(config["endpoint"]).hostname not in ("localhost", "127.0.0.1", "::1"):
        found.append("the endpoint is not on this machine")
    return found


def number_of(value: Column) -> Column:
    """A score given as a number or as an object with a score; null for anything else."""
    v = F.try_parse_json(value)
    return F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$.score", "double"))


def zero_if_short(text: Column, score: Column, least_bytes: int = 200) -> Column:
    """0 for a missing text or one of fewer bytes, else the score."""
    return F.when(text.isNull() | (F.octet_length(text) < least_bytes), F.lit(0.0)).otherwise(score)


def out_of_range(rows: DataFrame, score: str, low: float, high: float, unless: Column | None = None) -> DataFrame:
    """Rows whose score is null or outside low..high; rows where ``unless`` holds may have any."""
    bad = F.col(score).isNull() | ~F.col(score).between(low, high)
    return rows.where(bad if unless is None else bad & ~F.coalesce(unless, F.lit(False)))


def mismatches(rows: DataFrame, id_col: str, expected: dict[str, object]) -> DataFrame:
    """(id, errors): rows with fields that differ from what is expected, nulls included, each named with what it holds."""
    each = [
        F.when(~F.col(k).eqNullSafe(F.lit(v)), F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null")), F.lit(f", expected {v}")))
        for k, v in expected.items()
    ]
    errors = F.filter(F.array(*each), lambda e: e.isNotNull())
    return rows.select(id_col, errors.alias("errors")).where(F.size("errors") > 0)


def fits_context(system: Column, user: Column, output: int, window: int, safety: int) -> Column:
    """Whether the estimated input and the output fit the window less a margin."""
    estimate = F.greatest(F.lit(1), F.floor((F.length(system) + F.length(user) + 3) / 4))
    return estimate + output <= window - safety


def stated_limits(text: Column, pattern: str) -> Column:
    """Distinct numbers that a text states as limits, in order of mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def resolve(wanted: DataFrame, known: DataFrame, base: str, version: str) -> DataFrame:
    """Adds ``resolved``: the base for version 0; else base-vN if it is known, else the base if it is known, else null. ``known`` has the column name."""
    names = known.select("name").distinct()
    full = F.concat(F.col(base), F.lit("-v"), F.col(version).cast("string"))
    rows = wanted.withColumn("_full", full)
    with_full = rows.join(names.select(F.col("name").alias("_full"), F.lit(True).alias("_has")), "_full", "left")
    with_base = with_full.join(names.select(F.col("name").alias(base), F.lit(True).alias("_base")), base, "left")
    pick = F.when(F.col(version) == 0, F.col(base)).when(F.col("_has"), F.col("_full")).when(F.col("_base"), F.col(base))
    return with_base.withColumn("resolved", pick).drop("_full", "_has", "_base")


def sibling(name: Column, version: int) -> Column:
    """The name of another version: the _vN suffix is replaced, or dropped for version 0; null for names without one."""
    by = F.lit("") if version == 0 else F.lit(f"_v{version}")
    return F.when(name.rlike(r"_v\d+$"), F.regexp_replace(name, F.lit(r"_v\d+$"), by))


# First bytes of media files.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "pdf": "25504446"}


def media_kind(content: Column) -> Column:
    """png, jpeg, gif or pdf by the first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lit(None).cast("string")
    for name, start in MAGIC.items():
        kind = F.when(F.startswith(head, F.lit(start)), name).otherwise(kind)
    return kind
