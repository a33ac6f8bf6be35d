"""Reading chat records: requests and responses logged as JSON strings.

The JSON mixes types (content is a string or an array of parts), key order,
spacing and escaping vary, and some bodies are cut, so both columns are parsed
row by row in Arrow batches; the caller's filters run in the JVM before that.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHAT_PATH = "/v1/chat/completions"
#: Rows of an Arrow batch that are held as Python objects at once.
SLICE = 256
_ZERO = re.compile("[\u200b\ufeff]")


def is_blank(text: str | None) -> bool:
    """Null, or nothing but white space, U+200B and U+FEFF."""
    if not text:
        return True
    head = text[0]
    if not head.isspace() and head not in "\u200b\ufeff":
        return False
    return not _ZERO.sub("", text).strip()


def text_of(content: object) -> str:
    """A message's text: its content, or its text parts joined by one blank."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return " ".join(
            p["text"] for p in content if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str)
        )
    return ""


def messages_of(request: str | None) -> list[dict] | None:
    """The messages of a request, or None where it is not a valid JSON object with a list of messages."""
    try:
        doc = json.loads(request)
    except (ValueError, TypeError, RecursionError):
        return None
    got = doc.get("messages") if isinstance(doc, dict) else None
    return got if isinstance(got, list) and all(isinstance(m, dict) for m in got) else None


def reply_of(response: str | None) -> tuple[dict | None, str | None, bool]:
    """(reply message, finish reason, whether the body is JSON)."""
    try:
        doc = json.loads(response)
    except (ValueError, TypeError, RecursionError):
        return None, None, False
    choices = doc.get("choices") if isinstance(doc, dict) else None
    first = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
    message = first.get("message")
    finish = first.get("finish_reason")
    return (message if isinstance(message, dict) else None), (finish if isinstance(finish, str) else None), True


def chat_rows(requests: DataFrame, columns: list[str], only_ok: bool) -> DataFrame:
    """Chat records with the given columns; path and status are tested in the scan."""
    got = requests.where(F.col("path") == CHAT_PATH).where(F.col("request_id").isNotNull())
    if only_ok:
        got = got.where(F.col("status") == 200)
    return got.select(*columns)


def map_rows(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: StructType, batch: int = 2000) -> DataFrame:
    """Apply ``fn(*column values) -> rows`` to every row in Arrow batches.

    Long texts make batches heavy, so only ``SLICE`` rows at a time become
    Python objects and output is flushed every ``batch`` rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                for values in zip(*(c.to_pylist() for c in whole.slice(start, SLICE).columns)):
                    out.extend(fn(*values))
                    if len(out) >= batch:
                        yield _batch(out, arrow)
                        out = []
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
