"""Evidence texts: budgets, trees, diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from brindle.plans.folds import fold_by_key
from brindle.plans.materialize import materialize


def skip_greedy(items: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """(order, used): the items that are kept, with what is used of the key's budget after each.

    Items are taken in order while they fit what is left; one that does not fit
    is skipped and later, smaller ones may still fit. Items without a size, or
    above the whole budget, are dropped before the shuffle; the rest is two
    numbers a row, read as a stream, and nothing is looked at once the budget is used up.
    """
    out = StructType([StructField(order, LongType()), StructField("used", LongType())])

    def fold(_: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        used = 0
        for _, at, n in rows:
            if used + n <= budget:
                used += n
                yield at, used

    fits = items.select(key, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size)).where(F.col(size) <= budget)
    return fold_by_key(fits, [key], [order], fold, out)


# Folders that are never listed, and suffixes of files that are only named.
SKIPPED_FOLDERS = (".git", "__pycache__", ".pytest_cache", ".mypy_cache", "node_modules", ".venv", "venv")
BINARY_SUFFIXES = (
    ".parquet .pq .npy .npz .pkl .pickle .pt .pth .onnx .bin .h5 .hdf5 .feather .arrow .png .jpg .jpeg .gif .webp .pdf .zip .tar .gz"
).split()


def tree_listing(paths: DataFrame, key: str, entries: int = 400, depth: int = 6, children: int = 100) -> DataFrame:
    """(key, line, path, kind, text): the tree of every key's files, as lines in order; kind is dir, file, omitted or truncated.

    Folders come before files and both go by lower-case name at each level;
    folders and files take an entry each, and after ``entries`` the tree is
    marked as truncated. Below a folder with more than ``children`` immediate
    children stands one mark that takes no entry. ``depth`` limits the levels.
    Only the first lines of a key matter, so the engine keeps no more of any
    partition before it shuffles.
    """
    parts = F.filter(F.split("path", "/"), lambda x: F.length(x) > 0)
    rows = paths.select(key, parts.alias("parts")).where(F.size("parts") > 0)
    step = lambda d: F.struct(F.slice("parts", F.lit(1), d).alias("parts"), (d < F.size("parts")).alias("dir"))
    listed = rows.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth))), step)).alias("e")).groupBy(key, "e.parts").agg(F.max("e.dir").alias("dir"))
    hidden = F.exists(F.slice("parts", F.lit(1), F.size("parts") - F.when(F.col("dir"), 0).otherwise(1)), lambda x: x.isin(*SKIPPED_FOLDERS))
    seen = materialize(listed.where(~hidden), "tree")
    crowded = seen.groupBy(key, F.slice("parts", F.lit(1), F.size("parts") - 1).alias("folder")).agg(F.count("*").alias("n")).where(F.col("n") > children)
    above = seen.select(key, "parts", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda d: F.slice("parts", F.lit(1), d))).alias("folder"))
    lost = above.join(crowded.select(key, "folder").hint("merge"), [key, "folder"], "left_semi").select(key, "parts").distinct()
    kept = seen.join(lost.hint("merge"), [key, "parts"], "left_anti")
    # A folder sorts before files, and before what it holds.
    level = lambda x, d: F.concat(F.when((d + 1 < F.size("parts")) | F.col("dir"), "0").otherwise("1"), F.lower(x), F.lit("\u0001"), x)
    sorted_ = kept.select(key, "parts", "dir", F.transform("parts", level).alias("sort"))
    first = sorted_.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("sort"))).where(F.col("rank") <= entries + 1)
    ranked = materialize(first.drop("sort"), "tree-lines")
    name = F.element_at("parts", -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    text = F.concat(F.repeat(F.lit("  "), F.size("parts")), name, F.when(F.col("dir"), "/").when(suffix.isin(*BINARY_SUFFIXES), F.concat(F.lit("  ["), suffix, F.lit(" binary/large]"))).otherwise(""))
    path = F.array_join("parts", "/")
    shown = ranked.where(F.col("rank") <= entries).select(key, F.struct("rank", F.lit(0).alias("k")).alias("at"), path.alias("path"), F.when(F.col("dir"), "dir").otherwise("file").alias("kind"), text.alias("text"))
    # The mark of a crowded folder follows it, unless the entries are used up there; the root's own comes first.
    marks = crowded.join(ranked.select(key, F.col("parts").alias("folder"), "rank").hint("merge"), [key, "folder"], "left").where((F.col("rank") < entries) | (F.size("folder") == 0))
    omitted = F.concat(F.repeat(F.lit("  "), F.size("folder") + 1), F.lit("... [contents omitted: "), F.col("n").cast("string"), F.lit(f" entries exceed per-directory limit {children}]"))
    marked = marks.select(key, F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), F.lit(1).alias("k")).alias("at"), F.array_join("folder", "/").alias("path"), F.lit("omitted").alias("kind"), omitted.alias("text"))
    over = ranked.where((F.col("rank") > entries) | ((F.col("rank") == entries) & F.col("dir"))).select(key).distinct()
    cut = over.select(key, F.struct(F.lit(entries + 1).alias("rank"), F.lit(2).alias("k")).alias("at"), F.lit("").alias("path"), F.lit("truncated").alias("kind"), F.lit("... (tree truncated)").alias("text"))
    lines = shown.unionByName(marked).unionByName(cut)
    return lines.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).cast("long").alias("line"), "path", "kind", "text")


def first_test_file(files: DataFrame, key: str) -> DataFrame:
    """(key, path): the first of a key's files tests/test_*.py."""
    return files.where(F.col("path").rlike(r"^tests/test_[^/]*\.py$")).groupBy(key).agg(F.min("path").alias("path"))


@F.pandas_udf(StringType())
def _unified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), n=1, lineterm="")) for x, y in zip(a, b)])


def version_diffs(texts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, diff): unified diff with one line of context against the predecessor within the key."""
    w = Window.partitionBy(key).orderBy(order)
    rows = texts.select(key, order, "text", F.lag("text").over(w).alias("before"), F.row_number().over(w).alias("n")).where("n > 1")
    return rows.select(key, order, _unified("before", "text").alias("diff"))


def assemble(parts: DataFrame, key: str, order: str, header: str, body: str) -> DataFrame:
    """(key, text): sections of a key in order, each under its header; meant for parts that passed a budget, since a key's text is one value."""
    section = F.concat(F.lit("## "), F.col(header), F.lit("\n\n"), F.col(body))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), section.alias("s"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["s"]), "\n\n").alias("text"))


def deliverables(mentions: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, mentioned, found): distinct paths that a key mentions, and how many of them exist for it."""
    asked = mentions.select(key, "path").distinct()
    there = files.select(key, "path").distinct().withColumn("there", F.lit(1))
    return asked.join(there, [key, "path"], "left").groupBy(key).agg(F.count("*").alias("mentioned"), F.count("there").alias("found"))
