"""Replies: replay form, usage in several shapes, text extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import chat_json as J


def replay_form(requests: DataFrame, drop_cut: bool = True) -> DataFrame:
    """(request_id, content, reasoning, n_calls, n_objects, kept): answered requests in the form they are replayed in.

    Null content is empty; ``reasoning``: whether there is a reasoning text; a
    call without type is a function; ``n_objects``: calls whose arguments are an
    object or a text that parses as one. A reply cut by length is not kept
    where ``drop_cut`` is set.
    """
    rows = requests.where((F.col("path") == "/v1/chat/completions") & (F.col("status") == 200)).select("request_id", J.chat_variant("response").alias("p"))
    choice = F.try_variant_get("p", "$.choices[0]", "variant")
    get = lambda path, kind="string": F.try_variant_get(choice, path, kind)
    calls = F.coalesce(get("$.message.tool_calls", "array<variant>"), F.expr("array()").cast("array<variant>"))
    args = lambda c: F.try_variant_get(c, "$.function.arguments", "string")
    is_object = lambda c: F.coalesce(F.startswith(F.ltrim(args(c)), F.lit("{")) & F.try_parse_json(args(c)).isNotNull(), F.lit(False))
    cut = F.coalesce(get("$.finish_reason") == "length", F.lit(False))
    return rows.where(choice.isNotNull()).select(
        "request_id", F.coalesce(get("$.message.content"), F.lit("")).alias("content"), (F.length(get("$.message.reasoning_content")) > 0).eqNullSafe(True).alias("reasoning"),
        F.size(calls).cast("long").alias("n_calls"), F.size(F.filter(calls, is_object)).cast("long").alias("n_objects"), (~(cut & F.lit(drop_cut))).alias("kept"),
    ).dropDuplicates(["request_id"])


def replay_message(choice: Column) -> Column:
    """struct<role, content, reasoning_content, tool_calls array<struct<id, type, name, arguments variant>>>: a choice's message in the form it is replayed in.

    Null content is empty; an empty reasoning, and no calls, are null; a call
    without type is a function; arguments that are a text which parses become
    the object it holds, others stay the text.
    """
    get = lambda path, kind="string": F.try_variant_get(choice, path, kind)
    calls = get("$.message.tool_calls", "array<variant>")

    def call(c: Column) -> Column:
        text = F.try_variant_get(c, "$.function.arguments", "string")
        whole = F.try_variant_get(c, "$.function.arguments", "variant")
        of = lambda path: F.try_variant_get(c, path, "string")
        is_text = F.schema_of_variant(whole) == "STRING"
        arguments = F.when(is_text, F.coalesce(F.try_parse_json(text), whole)).otherwise(whole)
        return F.struct(of("$.id").alias("id"), F.coalesce(F.nullif(of("$.type"), F.lit("")), F.lit("function")).alias("type"), of("$.function.name").alias("name"), arguments.alias("arguments"))

    return F.struct(
        F.lit("assistant").alias("role"), F.coalesce(get("$.message.content"), F.lit("")).alias("content"), F.nullif(get("$.message.reasoning_content"), F.lit("")).alias("reasoning_content"),
        F.when(F.size(calls) > 0, F.transform(calls, call)).alias("tool_calls"),
    )


def replayed(requests: DataFrame) -> DataFrame:
    """(request_id, finish_reason, message): the replies of answered chat requests as they are replayed, each once."""
    rows = requests.where((F.col("path") == "/v1/chat/completions") & (F.col("status") == 200) & F.col("request_id").isNotNull()).select("request_id", J.chat_variant("response").alias("p"))
    choice = F.try_variant_get("p", "$.choices[0]", "variant")
    # A variant cannot be compared, so repeated rows are dropped by their id.
    return rows.where(choice.isNotNull()).select("request_id", F.try_variant_get(choice, "$.finish_reason", "string").alias("finish_reason"), replay_message(choice).alias("message")).dropDuplicates(["request_id"])


# Where different services put their token counts.
INPUT_PATHS = ("$.usage.input_tokens", "$.usage.prompt_tokens", "$.usageMetadata.promptTokenCount")
OUTPUT_PATHS = ("$.usage.output_tokens", "$.usage.completion_tokens", "$.usageMetadata.candidatesTokenCount")
TOTAL_PATHS = ("$.usage.total_tokens", "$.usageMetadata.totalTokenCount")


def usage_of(response: Column) -> tuple[Column, Column, Column]:
    """(input, output, total) tokens of a response in any known shape; the total is their sum where it is not given."""
    v = F.try_parse_json(response)
    first = lambda paths: F.coalesce(*(F.try_variant_get(v, p, "long") for p in paths))
    i, o = first(INPUT_PATHS), first(OUTPUT_PATHS)
    return i, o, F.coalesce(first(TOTAL_PATHS), i + o)


def response_text(response: Column) -> Column:
    """The text of a response: its direct field, else its first text block, else the first choice's content."""
    v = F.try_parse_json(response)
    blocks = F.try_variant_get(v, "$.content", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull())
    joined = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    return F.coalesce(F.try_variant_get(v, "$.output_text", "string"), F.try_variant_get(v, "$.output[0].content[0].text", "string"), joined, F.try_variant_get(v, "$.choices[0].message.content", "string"))
