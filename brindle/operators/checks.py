"""Checks: sets, uniqueness, leaks, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import LEAKS


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both; empty for sets that must be disjoint."""
    return a.select(key).intersect(b.select(key))


def unequal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only; empty for sets that must be equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").select(key, F.lit("left").alias("side")).unionByName(y.join(x, key, "left_anti").select(key, F.lit("right").alias("side")))


def outside(a: DataFrame, b: DataFrame, key: str, first: int | None = None) -> DataFrame:
    """(key): distinct keys of ``a`` that ``b`` lacks, sorted, or the ``first`` of them; empty where ``a`` is a subset."""
    got = a.select(key).distinct().join(b.select(key).distinct().hint("merge"), key, "left_anti").orderBy(key)
    return got if first is None else got.limit(first)


def unions_differ(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """(key, side): what distinguishes the union of ``parts`` (left) from ``whole`` (right); empty where they are equal."""
    union = parts[0].select(key)
    for p in parts[1:]:
        union = union.unionByName(p.select(key))
    return unequal(union, whole, key)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def leaks(texts: DataFrame, id_col: str, deny: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind): every kind of leak a text holds; denied terms in any case."""
    found = [F.when(F.col("text").rlike(p), F.lit(k)) for k, p in LEAKS.items()]
    found += [F.when(F.contains(F.lower("text"), F.lit(d.lower())), F.lit(f"denied:{d}")) for d in deny]
    return texts.select(id_col, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("kind"))


def manifest_status(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, status): missing, changed or same; ``manifest`` has sha256, ``files`` has content."""
    got = files.select(key, F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    joined = manifest.select(key, "sha256").join(got, key, "left")
    return joined.select(key, F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed").otherwise("same").alias("status"))
