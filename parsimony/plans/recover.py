"""What lossy pruning takes out, kept in the store: nothing leaves a payload that the store does not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsimony.functions.text import tokens
from parsimony.operators import json_columns as J
from parsimony.operators import store
from parsimony.plans.policy import Policy
from parsimony.sources.files import materialised

DROPPED = "array<struct<hash: string, body: string>>"


def proposed(receipts: DataFrame, policy: Policy, now: int) -> DataFrame:
    """namespace, body, stored_at, ttl of every dropped item, once each."""
    items = receipts.select(F.explode("dropped").alias("d")).select("d.body").distinct()
    ttl = store.DEFAULT_TTL if policy.ttl_seconds is None else policy.ttl_seconds
    return items.select(F.lit(policy.namespace).alias("namespace"), "body", F.lit(now).cast("long").alias("stored_at"), F.lit(ttl).cast("long").alias("ttl"))


def settle(receipts: DataFrame, entries: DataFrame, policy: Policy) -> DataFrame:
    """receipts after the store was asked: items that it does not hold go back into their payload.

    If that leaves no gain over the lossless result (column lossless), the payload falls back to it whole. retrieval
    tells how many markers and bytes the store answers for, and how many bytes it refused; null where no item was dropped.
    """
    drops = receipts.select("payload_id", F.explode("dropped").alias("d")).select("payload_id", "d.hash", "d.body").withColumn("namespace", F.lit(policy.namespace))
    held = store.stored_items(drops.select("namespace", "hash").distinct(), entries).select("hash", F.lit(True).alias("held"))
    asked = drops.join(store.dealt(held), "hash", "left")
    size, there = F.octet_length("body").cast("long"), F.coalesce("held", F.lit(False))
    found = asked.groupBy("payload_id").agg(
        F.array_sort(F.collect_list(F.when(~there, F.struct("hash", "body")))).alias("missing"),
        F.count_if(there).alias("marker_count"),
        F.coalesce(F.sum(F.when(there, size)), F.lit(0)).alias("persisted_bytes"),
        F.coalesce(F.sum(F.when(~there, size)), F.lit(0)).alias("skipped_bytes"),
    )
    out, short = receipts.join(store.dealt(found), "payload_id", "left"), F.size("missing") > 0
    out = out.withColumn("back", F.when(short, J.revert(F.when(short, F.col("out")), "missing")).otherwise(F.col("out")))  # Python sees short payloads alone
    lost = F.col("lossless").isNotNull() & (F.size("missing") > 0) & (tokens("back") >= tokens("lossless"))
    out = out.withColumn("lost", F.coalesce(lost, F.lit(False)))
    ttl = store.DEFAULT_TTL if policy.ttl_seconds is None else policy.ttl_seconds
    report = F.struct(F.lit(policy.namespace).alias("namespace"), F.lit(policy.alg).alias("alg"), "marker_count", F.when(F.col("marker_count") > 0, F.lit(ttl).cast("long")).alias("ttl_seconds"), "persisted_bytes", "skipped_bytes")
    rows = F.transform("transforms", lambda t: F.when(F.col("lost") & (t["id"] == "json_prune"), t.withField("status", F.lit("rolled_back"))).otherwise(t))
    out = out.withColumn("retrieval", F.when(F.col("marker_count").isNotNull() & ~F.col("lost"), report)).withColumn("transforms", rows)
    out = out.withColumn("out", F.when(F.col("lost"), F.col("lossless")).otherwise(F.col("back"))).withColumn("quality", F.when(~F.col("lost"), F.col("quality")))
    out = out.withColumn("dropped", F.when(F.col("lost"), F.expr(f"cast(array() as {DROPPED})")).otherwise(F.array_except("dropped", F.coalesce("missing", F.expr(f"cast(array() as {DROPPED})")))))
    out = out.withColumn("compressed_tokens", tokens("out")).withColumn("saved_tokens", F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0)))
    share = F.when(F.col("original_tokens") == 0, 0.0).otherwise(F.col("saved_tokens") / F.col("original_tokens"))
    return out.withColumn("savings_ratio", share).withColumn("savings_pct", share * 100).select(*receipts.columns, "retrieval")


def persist(receipts: DataFrame, entries: DataFrame, policy: Policy, now: int) -> tuple[DataFrame, DataFrame]:
    """The store after the dropped items were put, and the receipts settled against it; the receipts are made once, as both must speak of the same items."""
    receipts = materialised(receipts)
    after = store.put(entries, proposed(receipts, policy, now))
    return after, settle(receipts, after, policy)


def persist_to(receipts: DataFrame, path: str, policy: Policy, now: int) -> DataFrame:
    """Receipts settled against what can be read back from a store's folder after their items were written there."""
    spark, receipts = receipts.sparkSession, materialised(receipts)
    empty = spark.createDataFrame([], store.ENTRY)
    store.write_entries(store.put(empty, proposed(receipts, policy, now)), path)
    return settle(receipts, store.read_entries(spark, path), policy)


def store_originals(payloads: DataFrame, entries: DataFrame, policy: Policy, now: int) -> tuple[DataFrame, DataFrame]:
    """The store after whole payloads (payload_id, body, format) were put, and payload_id with stored, persisted and skipped bytes.

    Asked for by the policy, or owed to lossy runs where pruning can take place, which is plain JSON alone; a preview stores nothing.
    """
    due = F.lit(policy.store_originals) | (F.lit(policy.lossy is not None) & (F.col("format") == "json"))
    rows = payloads.where(due & F.lit(not policy.preview)).select("payload_id", F.coalesce("body", F.lit("")).alias("body"))
    ttl = store.DEFAULT_TTL if policy.ttl_seconds is None else policy.ttl_seconds
    after = store.put(entries, rows.select(F.lit(policy.namespace).alias("namespace"), "body", F.lit(now).cast("long").alias("stored_at"), F.lit(ttl).cast("long").alias("ttl")))
    asked = rows.select("payload_id", F.lit(policy.namespace).alias("namespace"), F.sha2("body", 256).alias("hash"), F.octet_length("body").cast("long").alias("n"))
    held = store.stored_items(asked.select("namespace", "hash").distinct(), after).withColumn("stored", F.lit(True))
    there = F.coalesce("stored", F.lit(False))
    return after, asked.join(store.dealt(held), ["namespace", "hash"], "left").select("payload_id", there.alias("stored"), F.when(there, F.col("n")).otherwise(0).alias("persisted_bytes"), F.when(there, 0).otherwise(F.col("n")).alias("skipped_bytes"))


def restore(payloads: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """payload_id, body, n_markers, n_found: payloads (payload_id, out) with every item put back that the store still holds."""
    marked = payloads.select("payload_id", "out", J.markers("out").alias("marks"))
    asked = marked.select("payload_id", F.explode("marks").alias("m")).select("payload_id", "m.namespace", "m.hash")
    found = store.retrieve(entries, asked.select("namespace", "hash").distinct(), now).where("status = 'found'").select("namespace", "hash", "body")
    bodies = asked.join(store.dealt(found), ["namespace", "hash"]).groupBy("payload_id").agg(F.collect_list(F.struct("hash", "body")).alias("bodies"))
    both = marked.join(store.dealt(bodies), "payload_id", "left")
    return both.select("payload_id", J.revert("out", "bodies").alias("body"), F.greatest(F.size("marks"), F.lit(0)).alias("n_markers"), F.greatest(F.size("bodies"), F.lit(0)).alias("n_found"))
