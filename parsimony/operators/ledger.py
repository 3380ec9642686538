"""Savings ledger: records, their aggregation, framings and policy proposals.

A record: request_id, timestamp (RFC 3339), surface, format, mode, status, original_tokens, compressed_tokens,
saved_tokens, savings_pct, bypass_reason, project_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parsimony.functions.text import format_timestamp, parse_timestamp

RECORD = "request_id string, timestamp string, surface string, format string, mode string, status string, original_tokens long, compressed_tokens long, saved_tokens long, savings_pct double, bypass_reason string, project_hash string"
MIN_SAMPLE = 5


def savings(original: Column, compressed: Column) -> tuple[Column, Column]:
    """Saved tokens, never below 0, and their percentage of the original, 0 without tokens."""
    saved = F.greatest(original - compressed, F.lit(0))
    return saved, F.when(original == 0, 0.0).otherwise(saved / original * 100)


def record_from_report(reports: DataFrame) -> DataFrame:
    """Records of reports (request_id, timestamp, is_wrap, never_worse_applied, bypass, format, mode, status, tokens, project)."""
    saved, pct = savings(F.col("original_tokens"), F.col("compressed_tokens"))
    reason = F.when(F.col("is_wrap") & F.col("never_worse_applied"), "would_increase_tokens").otherwise(F.col("bypass"))
    return reports.select("request_id", "timestamp", F.when(F.col("is_wrap"), "wrap").otherwise("cli").alias("surface"), "format", "mode", "status", "original_tokens", "compressed_tokens", saved.alias("saved_tokens"), pct.alias("savings_pct"), reason.alias("bypass_reason"), F.col("project").alias("project_hash"))


def aggregates() -> list[Column]:
    wrap, free = F.col("surface") == "wrap", F.col("bypass_reason").isNull()
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return [
        F.count("*").alias("requests"),
        F.count_if(wrap).alias("commands"),
        F.count_if(wrap & free).alias("wrapped_commands"),
        F.count_if(wrap & ~free).alias("raw_commands"),
        F.count_if(~free).alias("bypass_count"),
        total("original_tokens", F.lit(True)).alias("raw_tokens"),
        total("compressed_tokens", F.lit(True)).alias("compressed_tokens"),
        total("original_tokens", wrap & free).alias("__wrapped_raw"),
        total("saved_tokens", wrap & free).alias("__wrapped_saved"),
        total("original_tokens", wrap & ~free).alias("__raw_command"),
    ]


def derived(sums: DataFrame) -> DataFrame:
    saved = F.greatest(F.col("raw_tokens") - F.col("compressed_tokens"), F.lit(0))
    out = sums.withColumn("saved_tokens", saved)
    out = out.withColumn("savings_pct", F.when(F.col("raw_tokens") == 0, 0.0).otherwise(F.col("saved_tokens") / F.col("raw_tokens") * 100))
    out = out.withColumn("estimated_lost_tokens", F.when(F.col("__wrapped_raw") == 0, 0).otherwise(F.round(F.col("__raw_command") * (F.col("__wrapped_saved") / F.col("__wrapped_raw")))).cast("long"))
    out = out.withColumn("coverage_pct", F.when(F.col("commands") == 0, 0.0).otherwise(F.col("wrapped_commands") / F.col("commands") * 100))
    for zero in ("untrusted_filter_count", "retrieval_hits", "retrieval_misses", "retrieval_expired", "cache_hits", "cache_misses"):
        out = out.withColumn(zero, F.lit(0).cast("long"))  # nothing records these
    return out.drop("__wrapped_raw", "__wrapped_saved", "__raw_command")


def aggregate(records: DataFrame, *by: str) -> DataFrame:
    """The summary of all records, or one for each group."""
    return derived(records.groupBy(*by).agg(*aggregates()) if by else records.agg(*aggregates()))


def recent(records: DataFrame, n: int) -> DataFrame:
    """The n latest records by timestamp, ties by request_id."""
    return records.orderBy(F.desc("timestamp"), "request_id").limit(n)


def since(records: DataFrame, now: int, window: int) -> DataFrame:
    """Records at most `window` seconds old; those without a readable time go."""
    t = parse_timestamp("timestamp")
    return records.where(t.isNotNull() & (F.greatest(F.lit(now) - t, F.lit(0)) <= window))


def gc(records: DataFrame, now: int, retention_days: int) -> DataFrame:
    """Records within the retention; those without a readable time stay."""
    t = parse_timestamp("timestamp")
    return records.where(t.isNull() | (F.greatest(F.lit(now) - t, F.lit(0)) <= retention_days * 86400))


def gain(records: DataFrame, now: int, window: int) -> DataFrame:
    return aggregate(since(records, now, window)).withColumn("scope", F.lit("gain"))


def stats(records: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The summary of the ledger and of records made from report files."""
    return aggregate(records if more is None else records.unionByName(more)).withColumn("scope", F.lit("stats"))


def session(records: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The summary of a session's records and its latest requests."""
    return aggregate(records).withColumn("scope", F.lit("session")), recent(records, n)


#: What a report file must hold to become a record.
REPORT = "format string, mode string, status string, original_tokens long, compressed_tokens long, saved_tokens long, savings_pct double, command struct<never_worse_applied: boolean>, bypass struct<reason: string>, retrieval struct<marker_count: long>"


def records_of_reports(files: DataFrame) -> DataFrame:
    """Records, with markers, of report files (path, content, modificationTime): ids come from the content, times from the files.

    A file that is no report gives no record.
    """
    r = files.select("modificationTime", F.sha2("content", 256).alias("hash"), F.from_json(F.decode("content", "UTF-8"), REPORT).alias("r"))
    r = r.where("r.format is not null and r.original_tokens is not null and r.compressed_tokens is not null")
    reason = F.when(F.col("r.command.never_worse_applied"), "would_increase_tokens").otherwise(F.col("r.bypass.reason"))
    return r.select(
        F.concat(F.lit("tc-"), F.substring("hash", 1, 8)).alias("request_id"),
        format_timestamp(F.unix_seconds("modificationTime")).alias("timestamp"),
        F.when(F.col("r.command").isNotNull(), "wrap").otherwise("cli").alias("surface"),
        *(F.col(f"r.{c}").alias(c) for c in ("format", "mode", "status", "original_tokens", "compressed_tokens", "saved_tokens", "savings_pct")),
        reason.alias("bypass_reason"),
        F.lit(None).cast("string").alias("project_hash"),
        F.coalesce("r.retrieval.marker_count", F.lit(0).cast("long")).alias("markers"),
    )


def policy_proposals(records: DataFrame) -> DataFrame:
    """A proposal to leave the conservative mode, where enough sessions saved little."""
    g = records.where((F.col("status") == "compressed") & (F.col("mode") == "conservative")).groupBy("mode").agg(F.count("*").alias("sample_size"), F.avg("savings_pct").alias("m"))
    g = g.where((F.col("sample_size") >= MIN_SAMPLE) & (F.col("m") < 15))
    seen = F.format_string("%d conservative-mode sessions averaged %.1f%% savings", "sample_size", "m")
    advice = F.lit("make balanced the default mode, which would have saved more on these sessions")
    return g.select(F.col("mode").alias("scope"), seen.alias("observation"), advice.alias("suggestion"), F.least(F.col("sample_size") / 50.0, F.lit(1.0)).alias("confidence"), "sample_size")


def output_savings_measured(baseline_tokens: Column, shaped_tokens: Column) -> Column:
    return F.greatest(baseline_tokens - shaped_tokens, F.lit(0))


def output_savings_estimated(hint: Column, ratio: Column) -> Column:
    return F.round(hint * ratio).cast("long")


def csv_field(c: Column) -> Column:
    """Quoted only where needed."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def to_csv(df: DataFrame, columns: list[str]) -> DataFrame:
    """One column, line: the rows as CSV."""
    return df.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in columns)).alias("line"))


#: Columns of the two sections of an exported summary.
SUMMARY = ("schema_version", "scope", "window", "project", "requests", "commands", "wrapped_commands", "raw_commands", "bypass_count", "raw_tokens", "compressed_tokens", "saved_tokens", "savings_pct", "estimated_lost_tokens", "coverage_pct", "untrusted_filter_count", "retrieval_markers", "retrieval_hits", "retrieval_misses", "retrieval_expired", "cache_hits", "cache_misses", "latency_p50_ms", "latency_p95_ms")
REQUESTS = ("request_id", "timestamp", "surface", "format", "mode", "status", "original_tokens", "compressed_tokens", "saved_tokens", "savings_pct", "bypass_reason", "project_hash")


def summary_csv(summary: DataFrame, latest: DataFrame) -> DataFrame:
    """pos, line: a header and the summary's row, an empty line, a header and the latest requests, newest first. Columns that the summary lacks are empty; both tables are a few rows."""
    have = [F.col(c) if c in summary.columns else F.lit("") for c in SUMMARY]
    first = summary.limit(1).select(F.lit(1).cast("long").alias("pos"), F.concat_ws(",", *map(csv_field, have)).alias("line"))
    rows = latest.select(F.row_number().over(W.orderBy(F.desc("timestamp"), "request_id")).cast("long").alias("n"), F.concat_ws(",", *(csv_field(F.col(c)) for c in REQUESTS)).alias("line"))
    heads = summary.sparkSession.createDataFrame([(0, ",".join(SUMMARY)), (2, ""), (3, ",".join(REQUESTS))], "pos long, line string")
    return heads.unionByName(first).unionByName(rows.select((F.col("n") + 3).alias("pos"), "line"))


def pipeline_report(stages: DataFrame) -> DataFrame:
    """Arithmetic of a staged receipt (raw, external filter, core), from byte and token counts and flags."""
    c = F.col
    less = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a - b, F.lit(0)))
    ext_bytes, ext_tokens = F.when(c("external_ran"), c("core_in_bytes")), F.when(c("external_ran"), c("original_tokens"))
    return stages.select(
        "request_id",
        less(c("raw_bytes"), ext_bytes).alias("external_saved_bytes"),
        less(c("raw_tokens"), ext_tokens).alias("external_saved_tokens"),
        F.when(c("raw_stored"), "full").when(c("external_ran") & c("capture_raw"), "none").otherwise("not_applicable").alias("external_recoverability"),
        F.greatest(c("core_in_bytes") - c("out_bytes"), F.lit(0)).alias("core_saved_bytes"),
        F.when(c("compressed_tokens") < c("original_tokens"), "applied").otherwise("passthrough").alias("core_status"),
        F.when(c("store_originals"), "full").otherwise("none").alias("core_recoverability"),
        F.when(~c("external_ran") | ~c("capture_raw"), "not_applicable").otherwise(F.coalesce(c("completeness"), F.lit("unavailable"))).alias("raw_capture"),
        F.when(~c("external_ran"), "not_applicable").when(c("raw_stored"), "full").when(c("store_originals"), "core_only").otherwise("none").alias("upstream_recoverability"),
        less(c("raw_tokens"), c("compressed_tokens")).alias("total_saved_tokens"),
    )
