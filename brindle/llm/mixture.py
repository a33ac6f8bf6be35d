"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.tokens import DEFAULT_VOCABULARY, encode_documents
from brindle.plans.materialize import materialize

#: Running sums of a source are taken in buckets of about so many documents of the whole corpus; the number of buckets is a power of two within bounds and never changes the order.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 200_000, 6, 16
#: The order of a pass has so many bits.
ORDER_BITS = 60
#: The sources with a demand are broadcast up to so many; beyond, they are joined by shuffle, each split into SALTS keys.
SMALL_PLAN, SALTS = 10_000, 64
#: How strongly weights may drift from start to end, as a share of the weight.
DRIFT = 0.5


def token_sizes(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens)."""
    ids = encode_documents(documents, vocabulary)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens")).join(documents.where("doc_id is not null").select("doc_id", "source").hint("merge"), "doc_id")


def character_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) with code points as the unit, for corpora that are not tokenized yet."""
    return documents.where("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"), "source")


def source_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: tokens held, tokens wanted, weight schedule.

    Shares of sources without tokens cannot be met; they are spread over the
    others in proportion. The total is the largest that no source has to exceed
    max_repeats for. The schedule of source s over training time t in 0..1 is
    w_s(t) = share_s * (1 + drift_s * (2t - 1)): sources with short documents
    come early, those with long ones late; the drifts are centred by the shares,
    so the weights add up to 1 at any time and integrate to the shares.
    """
    held = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("held"), F.avg("n_tokens").alias("length"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    got = wanted.join(held.hint("merge"), "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("held", F.lit(0).cast("long")).alias("held"), F.coalesce("length", F.lit(0.0)).alias("length"),
        ((F.coalesce("held", F.lit(0)) > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).alias("usable"),
    )
    usable = got.where("usable")
    usable_share = usable.agg(F.sum("target_share")).scalar()
    log_length = usable.agg(F.sum(F.col("target_share") * F.log("length"))).scalar()
    joined = got.withColumn("usable_share", usable_share).withColumn("log_length", log_length).withColumn("share", F.when(F.col("usable"), F.col("target_share") / F.col("usable_share")).otherwise(0.0))
    lean = F.when(F.col("usable"), F.log("length") - F.col("log_length") / F.col("usable_share")).otherwise(0.0)
    leaning = materialize(joined.withColumn("lean", lean), "sources")
    total = leaning.agg(F.min(F.when(F.col("usable"), F.col("max_repeats") * F.col("held") / F.col("share")))).scalar()
    widest = leaning.agg(F.max(F.abs("lean"))).scalar()
    return leaning.withColumn("total", total).withColumn("widest", widest).select(
        "source", "target_share", "max_repeats", "held", "share", F.floor(F.round(F.coalesce(F.col("total") * F.col("share"), F.lit(0.0)), 6)).alias("demand"),
        F.coalesce(F.lit(DRIFT) * F.col("lean") / F.when(F.col("widest") > 0, F.col("widest")), F.lit(0.0)).alias("drift"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
    )


def mixture(sizes: DataFrame, targets: DataFrame, bits: int | None = None, small_plan: int = SMALL_PLAN) -> DataFrame:
    """(doc_id, copy, source, n_tokens, position), sorted by position over the whole output.

    Every source is read in passes, each in its own pseudo-random order; a
    document of n tokens takes the next n of its source's demand, and the
    position is the training time at which the integral of the source's weight
    schedule reaches the start of these tokens, times the total. A document is
    used at most max_repeats times; the last pass ends with the document that
    begins within the demand. Empty documents, null sources and sources without
    target never appear.

    Running sums need no single task: sums of the buckets of a source and pass
    are added up first, and each bucket is then summed by itself. ``bits`` sets the
    number of buckets (2 to the power), by default from the number of documents;
    documents follow each other by the digest of doc_id and pass, whatever it is.
    """
    bits = bits or min(MOST_BITS, max(LEAST_BITS, (sizes.count() // BUCKET_ROWS).bit_length()))
    plan = materialize(source_plan(sizes, targets), "plan").where("demand > 0").select("source", "demand", "drift", "total", "held")
    texts = sizes.where("n_tokens > 0 and source is not null").select("doc_id", "source", "n_tokens")
    if plan.limit(small_plan + 1).count() <= small_plan:
        planned = texts.join(F.broadcast(plan), "source")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        planned = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["source", "salt"]).drop("salt")
    last = F.ceil(F.col("demand") / F.col("held")) - 1
    digest = F.md5(F.concat_ws("/", "doc_id", "copy").cast("binary"))
    rows = (
        planned.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("order", F.conv(F.substring(digest, 1, ORDER_BITS // 4), 16, 10).cast("long"))
        .withColumn("bucket", F.shiftright("order", ORDER_BITS - bits))
    )
    keys = ["source", "copy", "bucket"]
    buckets = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("sum"))
    along = Window.partitionBy("source", "copy").orderBy("bucket")
    before = materialize(buckets.select(*keys, (F.sum("sum").over(along) - F.col("sum")).alias("before")), "offsets")
    inside = Window.partitionBy(*keys).orderBy("order", "doc_id")
    start = F.col("copy") * F.col("held") + F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    placed = rows.join(before.hint("merge"), keys).withColumn("start", start).where("start < demand")
    # c = t + k (t^2 - t), solved for the training time t.
    c, k = F.col("start") / F.col("demand"), F.col("drift")
    t = F.when(F.abs(k) < 1e-9, c).otherwise((k - 1 + F.sqrt((1 - k) * (1 - k) + 4 * k * c)) / (2 * k))
    return placed.select("doc_id", "copy", "source", "n_tokens", (t * F.col("total") + F.lit(0.0)).alias("position")).orderBy("position", "source", "doc_id", "copy")


def mixture_shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies) of every target source."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), (F.max("copy") + 1).alias("most_copies"))
    all_tokens = used.agg(F.sum("tokens")).scalar()
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = F.lit(0).cast("long")
    return (
        wanted.join(used.hint("merge"), "source", "left")
        .select(
            "source", "target_share", F.coalesce(F.col("tokens") / all_tokens, F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", zero).alias("most_copies"),
        )
    )
