"""Keyed joins, usage, costs, trials and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import chat_json as J


def keyed_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that must be unique in both inputs and the same on both sides; else an error at run time."""
    def counted(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn(f"_n{side}", n)

    both = counted(a, "a").join(counted(b, "b"), keys, "full")
    unique = (F.coalesce("_na", F.lit(0)) == 1) & (F.coalesce("_nb", F.lit(0)) == 1)
    return both.where(F.when(unique, True).otherwise(F.raise_error(F.lit("keys differ or repeat")).cast("boolean"))).drop("_na", "_nb")


def remaining(work: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Work items that the ledger does not hold yet."""
    return work.join(ledger.select(*keys).distinct(), keys, "left_anti")


def request_usage(requests: DataFrame, by: str = "episode") -> DataFrame:
    """(by, n_requests, n_chat, prompt_tokens, completion_tokens, max_prompt): every logged request counts once; usage where the response has it."""
    usage = lambda name: F.try_variant_get(J.chat_variant("response"), f"$.usage.{name}", "long")
    chat = F.col("path") == "/v1/chat/completions"
    rows = requests.select("request_id", by, "path", usage("prompt_tokens").alias("p"), usage("completion_tokens").alias("c")).dropDuplicates(["request_id"])
    return rows.groupBy(by).agg(
        F.count("*").alias("n_requests"), F.count_if(chat).alias("n_chat"), F.coalesce(F.sum("p"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("completion_tokens"), F.coalesce(F.max("p"), F.lit(0)).alias("max_prompt"),
    )


def longest_prefix(rows: DataFrame, column: str, rates: list[tuple[str, float]]) -> DataFrame:
    """Adds ``rate``: of the longest prefix, whatever the case; null where none fits. The table is a constant, so it becomes one expression and no join."""
    low = F.lower(column)
    rate: Column = F.lit(None).cast("double")
    for prefix, value in sorted(rates, key=lambda r: (len(r[0]), r[0])):
        rate = F.when(F.startswith(low, F.lit(prefix.lower())), F.lit(value)).otherwise(rate)
    return rows.withColumn("rate", rate)


def cost_rollup(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, costed, cost): the sum over rows with a cost and their number; null where no row has one."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count("cost").alias("costed"), F.round(F.sum("cost"), 4).alias("cost"))


def trial_rollup(scores: DataFrame) -> DataFrame:
    """(grp, mean, sd, n_trials): judges to task means, tasks to trial means, trials to mean and sample deviation (null for one trial)."""
    task = scores.groupBy("grp", "trial", "task").agg(F.avg("score").alias("s"))
    trial = task.groupBy("grp", "trial").agg(F.avg("s").alias("s"))
    return trial.groupBy("grp").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_samp("s"), 6).alias("sd"), F.count("*").alias("n_trials"))


def missing_judges(scores: DataFrame, required: list[str]) -> DataFrame:
    """(grp, trial, task, missing): tasks that lack a required judge."""
    seen = scores.groupBy("grp", "trial", "task").agg(F.collect_set("judge").alias("judges"))
    return seen.select("grp", "trial", "task", F.array_sort(F.array_except(F.array(*map(F.lit, required)), "judges")).alias("missing")).where(F.size("missing") > 0)


def latest_or_default(keys: DataFrame, rows: DataFrame, key: str, value: str, order: list[str], default: str) -> DataFrame:
    """(key, value): of every key, the latest non-empty value, else the default."""
    last = rows.where(F.length(F.trim(value)) > 0).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return keys.select(key).distinct().join(last, key, "left").select(key, F.coalesce(value, F.lit(default)).alias(value))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``, nulls first; ties are broken by all other columns."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def least_loaded(loads: DataFrame, by: str, name: str, load: str) -> DataFrame:
    """(by, name): the name of least load, the first by name among equals."""
    return loads.groupBy(by).agg(F.min(F.struct(load, name)).alias("m")).select(by, F.col(f"m.{name}").alias(name))


def pair_id(task: Column, a: Column, b: Column) -> Column:
    """SHA-256 of the pair's canonical JSON, keys sorted."""
    return F.sha2(F.concat(F.lit('{"a":"'), a, F.lit('","b":"'), b, F.lit('","task":'), task.cast("string"), F.lit("}")), 256)


def comparison_key(old: Column, new: Column, kind: str = "adjacent") -> Column:
    """vA_vs_vB, champion_vA_vs_vB or vB_vs_no_harness."""
    form = {"adjacent": "v%d_vs_v%d", "champion": "champion_v%d_vs_v%d"}.get(kind)
    return F.format_string("v%d_vs_no_harness", new) if form is None else F.format_string(form, old, new)


def parse_key(key: Column) -> Column:
    """(kind, old, new) of a comparison key; null for other texts."""
    num = lambda i: F.regexp_extract(key, r"^(?:champion_)?v(\d+)_vs_(?:v(\d+)|no_harness)$", i).try_cast("int")
    kind = F.when(key.rlike(r"^v\d+_vs_v\d+$"), "adjacent").when(key.rlike(r"^champion_v\d+_vs_v\d+$"), "champion").when(key.rlike(r"^v\d+_vs_no_harness$"), "baseline")
    baseline = kind == "baseline"
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(~baseline, num(1)).alias("old"), F.when(baseline, num(1)).otherwise(num(2)).alias("new")))


def norm_errors(vectors: DataFrame, original: str, other: str) -> DataFrame:
    """(relative_error, identical): norm of the difference over the norm, and the share of equal entries, over all vectors."""
    pairs = vectors.select(F.explode(F.arrays_zip(F.col(original).alias("x"), F.col(other).alias("y"))).alias("p")).select(F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    d = F.col("x") - F.col("y")
    return pairs.agg(F.round(F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("relative_error"), F.round(F.avg((d == 0).cast("int")), 6).alias("identical"))


def seed_registry(seeds: DataFrame, by: list[str]) -> DataFrame:
    """(by, min, max, n): the range of the seeds of each file and their number."""
    return seeds.groupBy(*by).agg(F.min("seed").alias("min"), F.max("seed").alias("max"), F.count("seed").alias("n"))


def complete_means(rows: DataFrame, columns: dict[str, str], n: int) -> DataFrame:
    """One row with the mean of every column of ``columns`` (under its new name) and n; an error at run time where there are not exactly ``n`` rows. Flags count as 0 and 1; a null counts as 0 in the sum."""
    means = [(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) / n).alias(name) for c, name in columns.items()]
    got = rows.agg(F.count("*").alias("n"), *means)
    checked = F.when(F.col("n") == n, F.col("n")).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} rows, found "), F.col("n").cast("string"))).cast("long"))
    return got.withColumn("n", checked)
