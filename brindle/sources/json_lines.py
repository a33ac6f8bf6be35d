"""JSON documents and JSON-lines ledgers in three modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str, schema: StructType, mode: str = "strict") -> DataFrame:
    """A ledger. ``strict``: a bad line is an error; ``skip``: it is dropped; ``count``: it is kept in the column _corrupt_record.

    Empty lines are ignored; a missing path is an empty relation; the codec
    follows from the file name (.gz and others).
    """
    if mode not in ("strict", "skip", "count"):
        raise ValueError(f"unknown mode {mode}")
    wide = StructType([*schema.fields, StructField(BAD, StringType())]) if mode == "count" else schema
    if not exists(spark, path):
        return spark.createDataFrame([], wide)
    how = {"strict": "FAILFAST", "skip": "DROPMALFORMED", "count": "PERMISSIVE"}[mode]
    return spark.read.schema(wide).option("mode", how).option("columnNameOfCorruptRecord", BAD).json(path)


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON document a file, over several lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def prefer_compressed(files: DataFrame) -> DataFrame:
    """Of path and path.gz, only the latter; ``files`` has the column path."""
    stem = F.regexp_replace("path", r"\.gz$", "")
    return files.groupBy(stem.alias("stem")).agg(F.max_by("path", F.endswith("path", F.lit(".gz")).cast("int")).alias("path")).select("path")


def read_texts(spark: SparkSession, path: str, glob: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, content): whole text files, recursively; bad UTF-8 is replaced, and ``limit`` cuts each content if given."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    got = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return got.select("path", (F.substring(text, 1, limit) if limit else text).alias("content"))


# Names of scripts that start a run.
ENTRY_SCRIPTS = r"(^|/)(run_[^/]*\.py|main\.py|pipeline\.py)$"


def entry_scripts(files: DataFrame) -> DataFrame:
    """(path): scripts that start a run, each once, sorted."""
    return files.where(F.col("path").rlike(ENTRY_SCRIPTS)).select("path").distinct().orderBy("path")


def combine_files(files: DataFrame, suffixes: tuple[str, ...], per_file: int = 20_000) -> DataFrame:
    """(folder, text): the first ``per_file`` characters of every file with one of the suffixes, in order of path, by folder."""
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | F.endswith("path", F.lit(s))
    rows = files.where(fits).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path", F.substring("content", 1, per_file).alias("content"))
    return rows.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda r: r["content"]), "\n").alias("text"))


def excluding(files: DataFrame, *names: set[str] | tuple[str, ...]) -> DataFrame:
    """The files whose last name is in none of the sets; ``files`` has the column path."""
    union = sorted(set().union(*names))
    return files.where(~F.element_at(F.split("path", "/"), -1).isin(union)) if union else files


def _guarded(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """The same rows, or an error at run time where ``holds`` is false; the test is made even if there are no rows, and nothing is broadcast but its one value."""
    test = F.when(holds, F.lit(False)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    guard = df.sparkSession.range(1).where(test).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
    return df.unionByName(guard)


def expect_count(df: DataFrame, n: int, what: str) -> DataFrame:
    """The same rows, or an error at run time where there are not exactly ``n``."""
    return _guarded(df, df.agg(F.count("*")).scalar() == n, f"{what}: expected {n} rows")


def lookup(catalogue: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of a catalogue with this key, or an error at run time where there are none."""
    rows = catalogue.where(F.col(key) == value)
    return _guarded(rows, rows.agg(F.count("*")).scalar() > 0, f"unknown {key}: {value}")
