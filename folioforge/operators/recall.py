"""Token recall of one text against another, and its distribution over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(docs: DataFrame, key: str, text: str, count: str) -> DataFrame:
    """key, token and how often it occurs; tokens are runs of ASCII letters and digits, in lower case."""
    exploded = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    return exploded.groupBy(key, "token").agg(F.count(F.lit(1)).alias(count))


def token_recall(ours: DataFrame, reference: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """For each key of the reference, the share of its tokens (with repeats) that ours has; 1 for one without tokens."""
    # of ours only what the reference has keys of is looked into
    ours = ours.join(reference.select(key).distinct(), key, "left_semi")
    have, want = tokens(ours, key, text, "have"), tokens(reference, key, text, "want")
    met = want.join(have, [key, "token"], "left").groupBy(key).agg(F.sum(F.least("want", F.coalesce("have", F.lit(0)))).alias("found"), F.sum("want").alias("wanted"))
    return reference.select(key).distinct().join(met, key, "left").select(
        key, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("wanted", F.lit(0)).alias("wanted"), F.when(F.coalesce("wanted", F.lit(0)) == 0, 1.0).otherwise(F.col("found") / F.col("wanted")).alias("recall")
    )


def distribution(recalls: DataFrame, recall: str = "recall") -> DataFrame:
    """Mean, upper median, least, most, and the shares of recalls of at least 0.99, 0.95, 0.9 and 0.5.

    The median is the element at n // 2 of the sorted recalls. ``percentile`` finds it exactly from counts by value."""
    total = recalls.agg(
        F.count(F.lit(1)).alias("documents"), F.avg(recall).alias("mean"), F.min(recall).alias("min"), F.max(recall).alias("max"),
        *[F.avg(F.when(F.col(recall) >= x, 1.0).otherwise(0.0)).alias(f"at_least_{int(100 * x)}") for x in (0.99, 0.95, 0.9, 0.5)],
    )
    n = recalls.count()
    if not n:
        return total.withColumn("median", F.lit(None).cast("double"))
    # the rank n // 2, from 0, of n - 1 steps
    middle = recalls.agg(F.percentile(recall, F.lit((n // 2) / (n - 1) if n > 1 else 0.0)).alias("median"))
    return total.join(F.broadcast(middle)).select("documents", "mean", "median", "min", "max", "at_least_99", "at_least_95", "at_least_90", "at_least_50")
