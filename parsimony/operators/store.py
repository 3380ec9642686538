"""Content-addressed store of payloads: put, retrieve, expiry and eviction. Entries: namespace, hash, body, stored_at, ttl, bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parsimony.functions.text import contains_secret, is_expired, safe_component

DEFAULT_TTL = 604_800
ENTRY = "namespace string, hash string, body string, stored_at long, ttl long, bytes long"


def dealt(df: DataFrame) -> DataFrame:
    """df for a join that deals both sides by key. Items and entries grow with the payloads, but Spark guesses their size from the columns alone, far too low, and would send them to the driver to broadcast them."""
    return df.hint("merge")


def put(entries: DataFrame, payloads: DataFrame) -> DataFrame:
    """entries after payloads (namespace, body, stored_at, ttl) were put: secrets and unsafe namespaces are refused, a later entry replaces an earlier one with the same key.

    Of entries stored at the same time the one put now wins, of those put together the one that lives longer; without a ttl it lives for ever.
    """
    ok = payloads.where(safe_component("namespace") & ~contains_secret("body"))
    new = ok.select("namespace", F.sha2("body", 256).alias("hash"), "body", "stored_at", "ttl", F.octet_length("body").cast("long").alias("bytes"))
    both = entries.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    # the latest entry by aggregation: one pass, combined before the shuffle
    last = both.groupBy("namespace", "hash").agg(F.max_by(F.struct("body", "stored_at", "ttl", "bytes"), F.struct("stored_at", "__new", F.col("ttl").isNull().alias("n"), "ttl")).alias("e"))
    return last.select("namespace", "hash", "e.body", "e.stored_at", "e.ttl", "e.bytes")


def retrieve(entries: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """asked (namespace, hash) with status found, expired or missing, and the body if found."""
    j = asked.join(dealt(entries.select("namespace", "hash", "body", "stored_at", "ttl")), ["namespace", "hash"], "left")
    gone = is_expired("stored_at", "ttl", now)
    status = F.when(F.col("stored_at").isNull(), "missing").when(gone, "expired").otherwise("found")
    return j.select("namespace", "hash", status.alias("status"), F.when(status == "found", F.col("body")).alias("body"))


def gc(entries: DataFrame, now: int, cap: int, slot: int = 3600, parts: int = 64) -> DataFrame:
    """Entries that stay: expired ones go, then the oldest until all bytes are within the cap.

    Bytes are first summed by slots of time, each cut by hash into parts, so that a burst within a slot is not one task's;
    running sums over entries are made inside their part. Order is by time, hash and namespace, the latest first.
    """
    live = entries.where(~is_expired("stored_at", "ttl", now)).withColumn("__slot", F.floor(F.col("stored_at") / slot))
    order = [F.desc("stored_at"), F.desc("hash"), F.desc("namespace")]
    before = lambda by, b: F.coalesce(F.sum(b).over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = live.groupBy("__slot").agg(F.sum("bytes").alias("b"))
    after = slots.select("__slot", "b", before([F.desc("__slot")], "b").alias("__newer"))
    sure = after.where(F.col("__newer") + F.col("b") <= cap).select("__slot")  # whole slots that fit
    edge = after.where((F.col("__newer") < cap) & (F.col("__newer") + F.col("b") > cap)).select("__slot", "__newer")
    # only the one slot that the cap cuts is ordered: first by moment and part, then inside
    part = live.join(F.broadcast(edge), "__slot").withColumn("__part", F.conv(F.substring("hash", 1, 4), 16, 10).cast("int") * parts / 65536).withColumn("__part", F.floor("__part"))
    sums = part.groupBy("stored_at", "__part").agg(F.sum("bytes").alias("b"))
    sums = sums.select("stored_at", "__part", before([F.desc("stored_at"), F.desc("__part")], "b").alias("__ahead"))
    inside = W.partitionBy("stored_at", "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = part.join(sums, ["stored_at", "__part"]).withColumn("__upto", F.col("__newer") + F.col("__ahead") + F.sum("bytes").over(inside)).where(F.col("__upto") <= cap)
    return live.join(sure, "__slot", "left_semi").select(*entries.columns).union(cut.select(*entries.columns))


def stored_items(dropped: DataFrame, entries: DataFrame) -> DataFrame:
    """Dropped items that the store holds; only these may leave a payload."""
    return dropped.join(dealt(entries.select("namespace", "hash")), ["namespace", "hash"], "left_semi")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a store's folder, of equal keys the one that counts; none where there is no folder yet."""
    empty = spark.createDataFrame([], ENTRY)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return empty
    rows = spark.read.schema(ENTRY).parquet(path)
    last = rows.groupBy("namespace", "hash").agg(F.max_by(F.struct("body", "stored_at", "ttl", "bytes"), F.struct("stored_at", F.col("ttl").isNull().alias("n"), "ttl")).alias("e"))
    return last.select("namespace", "hash", "e.body", "e.stored_at", "e.ttl", "e.bytes")


def write_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("namespace").parquet(path)
