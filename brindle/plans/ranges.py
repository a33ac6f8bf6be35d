"""Positions within keys of any size: no task ever holds a key as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.plans.materialize import materialize


def numbered(rows: DataFrame, key: str, order: str, before: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with position (1, 2, ... within the key by ``order``, which is unique there), total, and before_<c>: the value of each column of ``before`` in the row before.

    Rows are spread by ranges of key and order, so a key with a third of all
    rows lies in many parts. Rows are numbered within their part and key; what
    the parts before hold of a key is added from one small row a part and key.
    Nulls of the key are one key. Pass narrow rows: they are written once and sorted once more.
    """
    part = materialize(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "ranges")
    last = F.max_by(F.struct(F.lit(1).alias("_"), *before), order).alias("last")
    held = part.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(F.count("*").alias("_n"), last)
    along = Window.partitionBy("_key").orderBy("_at")
    offsets = held.select("_key", "_at", (F.sum("_n").over(along) - F.col("_n")).alias("_offset"), F.sum("_n").over(Window.partitionBy("_key")).alias("total"), F.lag("last").over(along).alias("_last"))
    inside = Window.partitionBy(key, "_part").orderBy(order)
    own = part.select("*", F.row_number().over(inside).alias("_row"), *(F.lag(F.struct(c)).over(inside).alias(f"_before_{c}") for c in before))
    joined = own.join(offsets.hint("merge"), own[key].eqNullSafe(offsets["_key"]) & (own["_part"] == offsets["_at"]))
    lagged = (F.when(F.col("_row") == 1, F.col(f"_last.{c}")).otherwise(F.col(f"_before_{c}.{c}")).alias(f"before_{c}") for c in before)
    return joined.select(*rows.columns, (F.col("_offset") + F.col("_row")).alias("position"), "total", *lagged)
