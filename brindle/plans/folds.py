"""Sequential folds by key without collecting groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_by_key(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: StructType) -> DataFrame:
    """Run ``fold(key, rows)`` over the ordered rows of every key.

    Rows are hashed by key and sorted within partitions; the fold then reads
    them as a stream across Arrow batches, so a group of any size needs no
    memory beyond the fold's own state, and sorting can spill.
    ``rows`` yields tuples of all columns of ``df``.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        ahead: list[tuple] = []

        def key_of(r: tuple) -> tuple:
            return tuple(r[i] for i in at)

        def group(first: tuple) -> Iterator[tuple]:
            yield first
            k = key_of(first)
            for r in rows:
                if key_of(r) != k:
                    ahead.append(r)
                    return
                yield r

        out: list[tuple] = []
        while True:
            first = ahead.pop() if ahead else next(rows, None)
            if first is None:
                break
            members = group(first)
            for o in fold(key_of(first), members):
                out.append(o)
                if len(out) >= 5000:
                    yield _batch(out, arrow)
                    out = []
            for _ in members:  # what the fold left unread
                pass
        if out:
            yield _batch(out, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
