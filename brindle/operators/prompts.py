"""Prompts inside user messages: variants of a prompt, matches, substitution, lookup by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import chat_json as J
from brindle.functions.text import occurrences, replace_first

# Terms in which the client puts a blank before the sign, and what it makes of them.
METRIC_TERMS = {"precision@k": "precision @k", "recall@k": "recall @k"}


def sent_index(pairs: DataFrame, original: str, sent: str) -> DataFrame:
    """(key, sent): the form in which a text was sent, under the md5 of its original form; each original once."""
    return pairs.where(F.col(original).isNotNull()).select(F.md5(original).alias("key"), F.col(sent).alias("sent")).groupBy("key").agg(F.min("sent").alias("sent"))


def with_sent(df: DataFrame, prompt: str, index: DataFrame) -> DataFrame:
    """``df`` with the column sent: the sent form of ``prompt`` by its hash, null where the index has none."""
    return df.withColumn("key", F.md5(prompt)).join(index.hint("merge"), "key", "left").drop("key")


def metric_form(prompt: Column) -> Column:
    """The prompt as the client rewrites it; without one of the terms it stays as it is, with one it is also trimmed."""
    out = prompt
    for term, written in METRIC_TERMS.items():
        out = F.replace(out, F.lit(term), F.lit(written))
    return F.when(out != prompt, F.btrim(out, F.lit(" \t\n\r\x0b\x0c"))).otherwise(prompt)


def variants(prompt: Column, sent: Column) -> Column:
    """array<struct<text, mode>>: the forms under which a prompt may appear, in order, each text once; null and empty forms are left out."""
    trim = lambda c: F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))
    forms = [("exact", prompt), ("sent", sent), ("strip", trim(prompt)), ("metric", metric_form(prompt)), ("metric_strip", trim(metric_form(prompt)))]
    known = F.filter(F.array(*(F.struct(t.alias("text"), F.lit(m).alias("mode")) for m, t in forms)), lambda v: F.length(v["text"]) > 0)
    texts = F.transform(known, lambda v: v["text"])
    return F.filter(known, lambda v, k: F.array_position(texts, v["text"]) == k + 1)


def user_texts(message: Column) -> Column:
    """array<string>: the texts a user message consists of."""
    parts = F.try_variant_get(message, "$.content", "array<variant>")
    listed = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    return F.when(parts.isNotNull(), listed).otherwise(F.array(F.coalesce(F.try_variant_get(message, "$.content", "string"), F.lit(""))))


def match(texts: Column, forms: Column) -> Column:
    """struct<text, mode, hits>: the first variant that occurs in the texts and how often; null where none does. More than one hit is ambiguous."""
    hits = lambda v: F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.coalesce(occurrences(t, v), F.lit(0)).cast("long"))
    counted = F.transform(forms, lambda v: F.struct(v["text"].alias("text"), v["mode"].alias("mode"), hits(v["text"]).alias("hits")))
    return F.get(F.filter(counted, lambda c: c["hits"] > 0), F.lit(0))


def unambiguous(found: Column) -> Column:
    """The match, or an error at run time where the prompt occurs more than once."""
    error = F.raise_error(F.concat(F.lit("ambiguous prompt match: "), found["hits"].cast("string"), F.lit(" occurrences ("), found["mode"], F.lit(")")))
    return F.when(found["hits"] > 1, F.struct(error.cast("string").alias("text"), found["mode"].alias("mode"), found["hits"].alias("hits"))).otherwise(found)


def substitute(texts: Column, found: Column, bare: Column, bare_sent: Column) -> Column:
    """The texts with the matched prompt replaced once by the bare prompt, in the form in which the match was found; unchanged without a single hit."""
    form = F.when(found["mode"] == "sent", F.coalesce(bare_sent, bare)).when(F.startswith(found["mode"], F.lit("metric")), metric_form(bare)).otherwise(bare)
    return F.when(found["hits"] == 1, F.transform(texts, lambda t: replace_first(t, found["text"], form))).otherwise(texts)


def prompts_by_condition(episodes: DataFrame, by_condition: DataFrame, default: Column) -> DataFrame:
    """(episode, prompt): the prompt of an episode's condition, else the default; episodes left without a prompt are skipped."""
    known = by_condition.groupBy("condition").agg(F.min("prompt").alias("own"))
    joined = episodes.select("episode", F.col("condition_name").alias("condition"), default.alias("default")).join(known, "condition", "left")
    return joined.select("episode", F.coalesce("own", "default").alias("prompt")).where("prompt is not null")


def first_user_texts(messages: Column) -> Column:
    """The texts of the first user message of a request; null where it has none."""
    users = F.filter(messages, lambda m: J.role(m) == "user")
    return F.when(F.size(users) > 0, user_texts(F.get(users, F.lit(0))))
