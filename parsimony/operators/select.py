"""Set-based forms of item selection: statistics, ranks and turns over a table of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numeric_stats(items: DataFrame, group: str, value: str) -> DataFrame:
    """group, med, mad: exact median, and median absolute deviation, of groups with two values or more."""
    med = items.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("med"), F.count(value).alias("n")).where("n >= 2")
    dev = items.join(med, group).groupBy(group).agg(F.first("med").alias("med"), F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad"))
    return dev


def modified_z(x: Column, med: Column, mad: Column) -> Column:
    return F.when(mad > 0, F.abs(x - med) / (1.4826 * mad)).when(x == med, 0.0).otherwise(1000.0)


def ranked(items: DataFrame, group: str, pos: str, failure: Column, score: Column, shape: Column) -> DataFrame:
    """items with rnk (failure, outlier score, edge, place) and turn (order in which shapes take turns)."""
    w = W.partitionBy(group)
    edge = (F.row_number().over(w.orderBy(pos)) == 1) | (F.row_number().over(w.orderBy(F.desc(pos))) == 1)
    out = items.withColumn("failure", failure).withColumn("score", F.round(score, 9)).withColumn("shape", shape).withColumn("edge", edge)
    best = [F.desc("failure"), F.desc("score"), F.desc("edge")]
    out = out.withColumn("rnk", F.row_number().over(w.orderBy(*best, pos)))
    out = out.withColumn("round", F.row_number().over(W.partitionBy(group, "shape").orderBy("rnk")))
    # a shape's own best key orders it among shapes; ties go to the name
    out = out.withColumn("first", F.first(F.struct((-F.col("failure").cast("int")).alias("f"), (-F.col("score")).alias("s"), (-F.col("edge").cast("int")).alias("e"))).over(W.partitionBy(group, "shape").orderBy("rnk")))
    return out.withColumn("turn", F.row_number().over(w.orderBy("round", "first", "shape"))).drop("first", "round")
