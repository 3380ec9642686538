"""Fidelity of a rewrite: word retention, critical tokens, ratio buckets, and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the gate and bounds of the ratio buckets.
QUALITY, FAILURES, SURVIVAL = 0.95, 0.005, 0.99
QUALITY_FLOOR = 0.5
LIGHT, MEDIUM = 0.4, 0.6


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+", -1), lambda x: x != ""))


def quality_retention(original: Column, compressed: Column) -> Column:
    a = _words(original)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, _words(compressed))) / F.size(a))


def critical_survival(compressed: Column, critical: Column) -> Column:
    return F.when(F.forall(critical, lambda t: compressed.contains(t)), 1.0).otherwise(0.0)


def contrastive_failure(quality: Column, survival: Column) -> Column:
    return F.when((survival < 1) | (quality < QUALITY_FLOOR), 1.0).otherwise(0.0)


def ratio(original: Column, compressed: Column) -> Column:
    return F.when(F.length(original) == 0, 0.0).otherwise(1 - F.length(compressed) / F.length(original))


def ratio_bucket(r: Column) -> Column:
    return F.when((r >= 0) & (r < LIGHT), "light").when((r >= LIGHT) & (r < MEDIUM), "medium").otherwise("heavy")


def fidelity_rows(df: DataFrame) -> DataFrame:
    """df (transform, scope, original, compressed, critical) with its scores."""
    c = F.col
    out = df.withColumn("quality", quality_retention(c("original"), c("compressed"))).withColumn("survival", critical_survival(c("compressed"), c("critical")))
    return out.withColumn("failure", contrastive_failure(c("quality"), c("survival"))).withColumn("bucket", ratio_bucket(ratio(c("original"), c("compressed"))))


def fidelity_gate(rows: DataFrame) -> DataFrame:
    """Means over all, by transform, by transform and scope, and by transform and bucket, in one aggregation over grouping sets."""
    sets = [[], ["transform"], ["transform", "scope"], ["transform", "bucket"]]
    g = rows.groupingSets([[F.col(x) for x in s] for s in sets], "transform", "scope", "bucket")
    out = g.agg(F.avg("quality").alias("quality"), F.avg("failure").alias("failure"), F.avg("survival").alias("survival"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    ok = (F.col("quality") >= QUALITY) & (F.col("failure") <= FAILURES) & (F.col("survival") >= SURVIVAL)
    return out.withColumn("passed", ok)
