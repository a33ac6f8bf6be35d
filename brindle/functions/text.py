"""Text columns: token estimates, shortening, truncation, sentences, scans, JSON candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """At least 1; a quarter of the characters, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def pair_token_estimate(system: Column, user: Column) -> Column:
    """At least 1; a quarter of both lengths, rounded up, in integer arithmetic."""
    return F.greatest(F.lit(1), F.floor((F.length(system) + F.length(user) + 3) / 4)).cast("long")


def collapse(text: Column) -> Column:
    """Runs of ASCII white space become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def shorten(text: Column, limit: int) -> Column:
    """Collapsed, and cut to ``limit`` characters with three dots where longer."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def head_tail(text: Column, limit: int, marker: str) -> Column:
    """Both halves of ``limit`` around a marker where the text is longer."""
    half = limit // 2
    cut = F.concat(F.substring(text, 1, half), F.lit(marker), F.right(text, F.lit(half)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def log_excerpt(text: Column, head: int, tail: int, slack: int = 200) -> Column:
    """The whole log up to head + tail + slack characters, else both ends."""
    cut = F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= head + tail + slack, text).otherwise(cut)


def fit_budget(text: Column, budget: int, rounds: int = 24, keep: float = 0.7, last: int = 256) -> Column:
    """Characters kept at either end so that the estimate of head + tail fits ``budget`` tokens.

    Starts from a quarter of the text at either end and shrinks by ``keep`` a
    round, at most ``rounds`` times; ``last`` characters if even that is too
    long; null where the whole text fits.
    """
    start = F.floor(F.length(text) / 4)
    fits = lambda n: F.ceil(n * 2 / 4) <= budget
    size = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), start.cast("long"), lambda n, _: F.when(fits(n), n).otherwise(F.floor(n * keep)).cast("long")
    )
    return F.when(token_estimate(text) <= budget, F.lit(None).cast("long")).otherwise(F.when(fits(size), size).otherwise(F.lit(last))).cast("long")


# Words that mark a sentence as naming a defect.
CUES = ("fail", "fails", "failed", "missing", "inconsistent", "mismatch", "not ", "lack", "weak", "nan", "null", "error", "defect", "reproducibility")


def action_items(text: Column, limit: int = 6) -> Column:
    """The first sentences with a cue, each once, in order."""
    sentences = F.split(F.regexp_replace(collapse(text), r"([.!?])\s+", "$1\u0001"), "\u0001")
    low = lambda s: F.lower(s)
    has_cue = lambda s: F.lit(False) if not CUES else _any([F.contains(low(s), F.lit(c)) for c in CUES])
    return F.slice(F.array_distinct(F.filter(sentences, lambda s: (F.length(s) > 0) & has_cue(s))), 1, limit)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    n = (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)
    return F.when(F.length(needle) > 0, n).otherwise(0).cast("long")


def replace_first(text: Column, needle: Column, by: Column) -> Column:
    """The text with the first occurrence of the needle replaced; unchanged where there is none."""
    at = F.instr(text, needle)
    tail = F.substr(text, at + F.length(needle))
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), by, tail)).otherwise(text)


def image_paths(text: Column) -> Column:
    """Distinct paths of PNG files, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)([A-Za-z0-9_./-]+\.png)"), F.lit(1))))


def file_paths(text: Column) -> Column:
    """Distinct relative file paths with at least one folder, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+\.[a-z]+)"), F.lit(1))))


def template_parts(text: Column, start: str, end: str) -> tuple[Column, Column, Column]:
    """(before, block, after): the block lies between the first start marker and the last end marker after it; nulls where a marker is missing."""
    at = F.instr(text, F.lit(start))
    rest = F.substr(text, at + len(start))
    back = F.instr(F.reverse(rest), F.lit(end[::-1]))
    ok = (at > 0) & (back > 0)
    stop = F.length(rest) - back - len(end) + 2
    return (
        F.when(ok, F.substr(text, F.lit(1), at - 1)),
        F.when(ok, F.substr(rest, F.lit(1), stop - 1)),
        F.when(ok, F.substr(rest, stop + len(end))),
    )


def json_candidate(text: Column) -> Column:
    """Which part of a text is its JSON object: whole, braces (outermost), fenced, or none; the first that parses."""
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    is_object = lambda c: F.coalesce(F.startswith(F.ltrim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), F.lit(False))
    return F.when(is_object(F.trim(text)), "whole").when(is_object(outer), "braces").when(is_object(fenced), "fenced").otherwise("none")


# Patterns of text that must not be published.
LEAKS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "home_path": r"/(home|Users)/[A-Za-z0-9._-]+",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "credential": r"(sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,})",
}


def unsafe_path(path: Column) -> Column:
    """Absolute, or with a parent step."""
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def md5_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the md5 of the parts: the same in any engine and order of rows."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normalise_id(raw: Column) -> Column:
    """query_3 for 3, 03, query3 and query_3; query_ and the text for others; an empty id is an error."""
    digits = F.regexp_extract(F.btrim(raw), r"^(?:query_?)?0*(\d+)$", 1)
    text = F.regexp_replace(F.btrim(raw), r"^query_", "")
    named = F.when(F.length(digits) > 0, F.concat(F.lit("query_"), digits)).otherwise(F.concat(F.lit("query_"), text))
    return F.when(F.length(F.btrim(raw)) > 0, named).otherwise(F.raise_error(F.lit("empty id")).cast("string"))


def folder_id(path: Column) -> Column:
    """The id in a folder name: query_N, qN or a leading number, in this order; null where there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    tries = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r"query_?(\d+)", r"\bq(\d+)\b", r"^(\d+)")]
    return F.coalesce(*tries)


def band(number: Column) -> Column:
    """Name of the range a query number lies in."""
    return F.when(number.between(1, 99), "first").when(number.between(200, 299), "second").when(number.between(300, 399), "third").otherwise("other")


def before_marker(text: Column, marker: str) -> Column:
    """The text before the first ``marker`` (all of it without one), written line breaks as real ones, trimmed."""
    return F.btrim(F.replace(F.split_part(text, F.lit(marker), F.lit(1)), F.lit("\\n"), F.lit("\n")), F.lit(" \t\n\r\x0b\x0c"))


def first_contained(text: Column, variants: list[Column]) -> Column:
    """(variant, hits) of the first distinct variant that occurs in the text; null where none does."""
    each = F.array_distinct(F.filter(F.array(*variants), lambda v: v.isNotNull() & (F.length(v) > 0)))
    counted = F.transform(each, lambda v: F.struct(v.alias("variant"), occurrences(text, v).alias("hits")))
    return F.get(F.filter(counted, lambda c: c["hits"] > 0), F.lit(0))


def trim_block(text: Column, prefix: str, end: str, tail: Column | None = None, probe: int = 200, last_share: float = 0.3) -> Column:
    """A generated block: null without the prefix; cut before a copy of the tail's first ``probe`` characters, else before an end marker in its last part."""
    at_tail = F.lit(0) if tail is None else F.coalesce(F.instr(text, F.substring(tail, 1, probe)), F.lit(0))
    back = F.instr(F.reverse(text), F.lit(end[::-1]))
    at_end = F.when(back > 0, F.length(text) - back - len(end) + 2).otherwise(0)
    cut = F.when(at_tail > 1, F.substr(text, F.lit(1), at_tail - 1)).when(at_end > F.length(text) * (1 - last_share), F.substr(text, F.lit(1), at_end - 1)).otherwise(text)
    return F.when(F.startswith(text, F.lit(prefix)), F.rtrim(cut))


def json_fenced_first(text: Column) -> Column:
    """Which part of a text is its JSON object, fenced first: fenced, braces or whole; none where nothing parses."""
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    is_object = lambda c: F.coalesce(F.startswith(F.ltrim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), F.lit(False))
    return F.when(is_object(fenced), "fenced").when(is_object(outer), "braces").when(is_object(F.trim(text)), "whole").otherwise("none")


def first_fenced_json(text: Column) -> Column:
    """The first ```json block of a text that parses; null where there is none."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))
    return F.get(F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull()), F.lit(0))
