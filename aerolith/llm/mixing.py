"""Problem 9: mix sources to target shares of all tokens.

Every document gets a random key (a hash of its id and a seed). Each source has a
budget of tokens, its share of the total; whole passes over the source (epochs)
are used while they fit, then a random prefix of one more pass: documents in key
order up to the prefix whose token sum is nearest to what is left. As keys are
uniform, the key range of a source is cut into buckets of about BUCKET_ROWS rows;
bucket sums give the prefix sums, and only the bucket in which the budget ends is
sorted row by row. So no source, however large, comes together in one task.

Defined results: `total_tokens` defaults to the tokens of all documents. A source
that cannot fill its budget within max_repeats is used max_repeats times and
reported as not met. Sources without target, and documents without source, have
share 0. Null, empty and blank texts are documents of 0 or few tokens like any
other. Repeated rows are documents of their own. Targets given twice add up (the
greater max_repeats holds); null or negative shares count as 0, a null max_repeats
as 1. Empty tables give an empty mix and a report of the targets alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.encode import token_counts
from aerolith.session import checkpoint_dir

BUCKET_ROWS = 200_000


def _targets(targets: DataFrame) -> DataFrame:
    share = F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))
    return (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum(share).alias("target_share"), F.max(F.coalesce(F.col("max_repeats"), F.lit(1))).cast("long").alias("max_repeats"))
    )


def _budgets(counts: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """One row a target: what it may use, in whole passes and tokens of a last, partial pass."""
    has = counts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("documents"))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.coalesce(F.col("all_tokens"), F.lit(0)).cast("double")
    everything = counts.agg(F.sum("n_tokens").alias("all_tokens"))
    fit = F.floor(F.col("budget_tokens") / F.col("available_tokens"))
    return (
        _targets(targets)
        .join(has, "source", "left")
        .crossJoin(F.broadcast(everything))  # one row
        .fillna(0, ["available_tokens", "documents"])
        .withColumn("budget_tokens", F.col("target_share") * total)
        .withColumn("epochs", F.when(F.col("available_tokens") > 0, F.least(fit, F.col("max_repeats"))).otherwise(F.lit(0)).cast("long"))
        .withColumn(
            "left_tokens",
            F.when((F.col("available_tokens") > 0) & (F.col("epochs") < F.col("max_repeats")), F.col("budget_tokens") - F.col("epochs") * F.col("available_tokens")).otherwise(F.lit(0.0)),
        )
        .withColumn("n_buckets", F.ceil((F.col("documents") + 1) / F.lit(BUCKET_ROWS)))
        .drop("all_tokens")
    )


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens), kept so that texts are encoded once."""
    checkpoint_dir(docs.sparkSession)
    return token_counts(docs, ["doc_id", "source"]).checkpoint()


def mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, times): each document used, and how many times."""
    plan = _budgets(counts, targets, total_tokens).select("source", "epochs", "left_tokens", "n_buckets")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")), 11)
    keyed = (
        counts.join(plan, "source")  # broadcast at run time while the targets are few
        .withColumn("key", key)
        .withColumn("bucket", F.floor(F.col("key") * F.col("n_buckets") / F.lit(float(1 << 53))))
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        keyed.groupBy("source", "bucket")
        .agg(F.sum("n_tokens").alias("bucket_tokens"), F.first("left_tokens").alias("left_tokens"))
        .withColumn("before", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)))
    )
    # The bucket in which the budget ends: the first whose sum reaches it.
    cut = (
        sums.where((F.col("left_tokens") > 0) & (F.col("before") < F.col("left_tokens")) & (F.col("before") + F.col("bucket_tokens") >= F.col("left_tokens")))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "before")).alias("at"))
        .select("source", F.col("at.bucket").alias("cut_bucket"), F.col("at.before").alias("cut_before"))
    )
    rows = keyed.join(cut, "source", "left")  # at most one row a target; its size decides how it is joined
    running = Window.partitionBy("source").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        rows.where(F.col("bucket") == F.col("cut_bucket"))
        .withColumn("upto", F.col("cut_before") + F.sum("n_tokens").over(running))
        .withColumn("under", F.col("left_tokens") - (F.col("upto") - F.col("n_tokens")))
        .withColumn("more", (F.col("upto") <= F.col("left_tokens")) | ((F.col("under") > 0) & (F.col("upto") - F.col("left_tokens") < F.col("under"))))
    )
    rest = rows.where(F.col("cut_bucket").isNull() | (F.col("bucket") != F.col("cut_bucket"))).withColumn(
        "more", (F.col("left_tokens") > 0) & F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(False))
    )
    out = ["doc_id", "source", "n_tokens", (F.col("epochs") + F.col("more").cast("long")).alias("times")]
    return inside.select(*out).unionByName(rest.select(*out)).where(F.col("times") > 0)


def shares(counts: DataFrame, mixed: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a source of either table: its target, what was reached, and whether within a document of the target."""
    used = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("times")).alias("reached_tokens"), F.max("times").alias("most_repeats"), F.max("n_tokens").alias("longest")
    )
    untargeted = counts.groupBy("source").agg(F.sum("n_tokens").alias("all_available"))
    plan = _budgets(counts, targets, total_tokens).select("source", "target_share", "max_repeats", "budget_tokens")
    merged = (
        untargeted.withColumnRenamed("source", "s")
        .join(plan, F.col("s").eqNullSafe(F.col("source")), "full")
        .select(F.coalesce("source", "s").alias("source"), "target_share", "max_repeats", "budget_tokens", "all_available")
    )
    joined = merged.join(used, "source", "left").fillna(0)
    total = used.agg(F.sum("reached_tokens").alias("mix_tokens"))
    return joined.crossJoin(F.broadcast(total)).select(  # one row
        "source",
        "target_share",
        "max_repeats",
        F.col("all_available").alias("available_tokens"),
        F.round("budget_tokens", 3).alias("budget_tokens"),
        "reached_tokens",
        "most_repeats",
        F.round(F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.col("mix_tokens")).otherwise(F.lit(0.0)), 9).alias("reached_share"),
        F.round(F.when(F.col("budget_tokens") > 0, F.col("reached_tokens") / F.col("budget_tokens")).otherwise(F.lit(0.0)), 9).alias("reached_of_budget"),
        (F.abs(F.col("budget_tokens") - F.col("reached_tokens")) <= F.col("longest")).alias("met"),
    )
