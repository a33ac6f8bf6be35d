"""Columns over chat JSON, in the JVM: requests and responses as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chat_variant(json: str | Column) -> Column:
    """The JSON as a variant; null where it is no valid JSON."""
    return F.try_parse_json(json)


def messages(v: Column) -> Column:
    """The messages of a request as an array of variants."""
    return F.try_variant_get(v, "$.messages", "array<variant>")


def role(m: Column) -> Column:
    return F.try_variant_get(m, "$.role", "string")


def text(m: Column) -> Column:
    """A message's text: its content, or its text parts joined by one blank; null where it has neither."""
    parts = F.try_variant_get(m, "$.content", "array<variant>")
    is_text = lambda p: F.try_variant_get(p, "$.type", "string") == "text"
    joined = F.array_join(F.transform(F.filter(parts, is_text), lambda p: F.try_variant_get(p, "$.text", "string")), " ")
    return F.when(parts.isNotNull(), joined).otherwise(F.try_variant_get(m, "$.content", "string"))


def n_tool_calls(m: Column) -> Column:
    return F.coalesce(F.size(F.try_variant_get(m, "$.tool_calls", "array<variant>")), F.lit(0))


def reply(v: Column) -> Column:
    """The message of the first choice of a response."""
    return F.try_variant_get(v, "$.choices[0].message", "variant")
