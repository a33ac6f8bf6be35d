"""Cutting lineage with tables written to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent and everything runs on one machine
    (``local[...]`` or ``local-cluster[...]``, as in tests) a temporary folder is
    used; elsewhere its absence is an error, since executors could not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(-cluster)?(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="brindle-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike ``localCheckpoint`` this survives the loss of an executor, and later
    readers still get column pruning. The folder is removed by ``discard``, or
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written[path] = spark
    got = spark.read.schema(df.schema).parquet(path)
    got._brindle_path = path
    return got


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a result of ``materialize`` that no later plan reads; loops drop the round before with it."""
    path = getattr(df, "_brindle_path", None)
    spark = _written.pop(path, None)
    if spark is not None:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def _remove() -> None:
    for path, spark in _written.items():
        _delete(spark, path)
    _written.clear()
