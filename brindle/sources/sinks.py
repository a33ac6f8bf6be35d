"""Sinks: ledgers, write-once tables, single JSON files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.sources.json_lines import exists


def append(df: DataFrame, path: str, compressed: bool = False) -> None:
    """Append rows to a ledger of JSON lines."""
    df.write.mode("append").option("compression", "gzip" if compressed else "none").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose keys the ledger lacks, each key once, so a repeated call adds nothing."""
    spark = df.sparkSession
    rows = df.dropDuplicates(keys)
    if exists(spark, path):
        held = spark.read.schema(df.schema).json(path).select(*keys).distinct()
        rows = rows.join(held, keys, "left_anti")
    append(rows, path)


def write_once(df: DataFrame, path: str) -> None:
    """Write a table that must never change: the same rows again are a no-op, other rows an error."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return
    held = spark.read.parquet(path).select(*df.columns)
    if not (df.exceptAll(held).isEmpty() and held.exceptAll(df).isEmpty()):
        raise ValueError(f"{path} holds other rows")


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the constructor of its paths."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement that was cut off: the old table stands aside under ``path``.old until the new one is in place."""
    fs, p = _fs(spark, path)
    if fs.exists(p(f"{path}.old")):
        if fs.exists(p(path)):
            fs.delete(p(f"{path}.old"), True)
        else:
            _rename(fs, p, f"{path}.old", path)


def _rename(fs, p, source: str, target: str) -> None:  # noqa: ANN001
    if not fs.rename(p(source), p(target)):
        raise OSError(f"cannot rename {source} to {target}")


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table in place of another. At every moment the old or the new one is complete, under ``path`` or, after a crash, where ``recover`` finds it."""
    spark = df.sparkSession
    recover(spark, path)
    fs, p = _fs(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if fs.exists(p(path)):
        _rename(fs, p, path, f"{path}.old")
    _rename(fs, p, fresh, path)
    recover(spark, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``replace_table`` or ``upsert``."""
    recover(spark, path)
    return spark.read.parquet(path)


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace rows by key and keep the others, sorted by key."""
    spark = df.sparkSession
    recover(spark, path)
    rows = df
    if exists(spark, path):
        rows = df.unionByName(spark.read.parquet(path).join(df.select(*keys).distinct().hint("merge"), keys, "left_anti"), allowMissingColumns=True)
    replace_table(rows.orderBy(*keys), path)


def write_json_file(df: DataFrame, path: str) -> None:
    """One small result as one JSON file, in place of an earlier one in a single step: written to a folder beside it, then moved over it."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    folder = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.json(folder)
    part = fs.globStatus(p(f"{folder}/part-*"))[0].getPath()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(option, 1)
    how[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri()).rename(part, fs.makeQualified(p(path)), how)
    fs.delete(p(folder), True)
