"""The ledger as a stream: windowed savings with a watermark, exactly once into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsimony.functions.text import parse_timestamp
from parsimony.operators.ledger import RECORD


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as they arrive; lines that don't parse are left out."""
    return spark.readStream.schema(RECORD).option("mode", "DROPMALFORMED").json(path)


def windows(records: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tokens by window and mode; the same on a table and on a stream, where records later than `late` are dropped."""
    at = records.withColumn("at", F.timestamp_seconds(parse_timestamp("timestamp"))).where("at is not null")
    if records.isStreaming:
        at = at.withWatermark("at", late)
    g = at.groupBy(F.window("at", length).alias("w"), "mode").agg(F.count("*").alias("requests"), F.sum("original_tokens").alias("original_tokens"), F.sum("saved_tokens").alias("saved_tokens"))
    return g.select(F.unix_seconds("w.start").alias("window_start"), "mode", "requests", "original_tokens", "saved_tokens")


def write(out: DataFrame, path: str, checkpoint: str):
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
