"""compress: payloads through redaction, the transforms of their policy with all gates, and a receipt for each row.

Text formats (logs, diffs, plain text) stay Catalyst expressions. JSON formats go through one Arrow function, as their
rewrites must keep spelling and order to the byte. Payloads are split by format before, so that Python sees JSON rows alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsimony.functions import json_tree as jt
from parsimony.functions.batches import bounded, by_pieces
from parsimony.functions.text import SECRETS, detect_format, redact, redaction_count, tokens
from parsimony.operators import lines as L
from parsimony.operators.prune import estimate, prune

from .policy import Policy

TRANSFORMS = "array<struct<id: string, version: string, tokens_before: bigint, tokens_after: bigint, status: string, skipped_reason: string>>"
JSON_FORMATS = ("openai_json", "anthropic_json", "json")


def _receipt(e_id: str, version: str, before, after, status, reason=None) -> tuple:
    return (e_id, version, before, after, status, reason)


# --- JSON -------------------------------------------------------------------------------------


def _rewrite(e_id: str, text: str) -> str:
    if e_id == "json_minify":
        return jt.minify(text)
    v = jt.loads(text)
    if e_id == "json_field_fold":
        return jt.dumps(jt.fold(v))
    if e_id == "json_value_dict":
        d = jt.value_dictionary(v)
        return text if d is None else jt.dumps(d)
    return jt.dumps(jt.shorten_examples(v))


def _safe(e_id: str, before: str, after: str, protected: list[str]) -> bool:
    try:
        b, a = jt.loads(before), jt.loads(after)
    except jt.JsonError:
        return False
    if e_id == "json_field_fold":
        ok = jt.equal(jt.unfold(a), b)
    elif e_id == "json_value_dict":
        ok = jt.equal(jt.undictionary(a), b)
    else:
        ok = jt.key_order(a) == jt.key_order(b)
    return ok and all(p in after for p in protected)


def _run(entries, policy: Policy, text: str, protected: list[str]) -> tuple[str, list]:
    """The gates, in their order: target met, not applicable, larger, equal, over the cap, unsafe, applied."""
    rows = []
    for e in entries:
        before = estimate(text)
        note = lambda after, status, reason=None: rows.append(_receipt(e.id, e.version, before, after, status, reason))  # noqa: B023, E731
        if policy.target_tokens is not None and before <= policy.target_tokens:
            note(before, "skipped", "target_already_met")
            continue
        try:
            made = _rewrite(e.id, text)
        except jt.JsonError:
            note(before, "skipped", "not_applicable_to_format")
            continue
        after = estimate(made)
        if after > before:
            note(before, "skipped", "would_increase_tokens")
        elif after == before:
            note(before, "no_op")
        elif 1 - after / max(before, 1) > policy.cap(e):
            note(before, "skipped", "not_enabled_in_mode")
        elif not _safe(e.id, text, made, protected):
            note(before, "rolled_back")
        else:
            text = made
            note(after, "applied")
    return text, rows


_PY_SECRETS = [(re.compile(p), put.replace("$1", r"\1")) for p, put in SECRETS]


def _has_secret(text: str) -> bool:
    return any(p.search(text) for p, _ in _PY_SECRETS)


def compress_json(text: str, fmt: str, policy: Policy) -> tuple[str, str, list, list, str | None]:
    """Output, status, receipts, dropped items of one redacted payload, and where items were dropped what it is without that.

    What pruning gives with every item dropped is the best it can give; where that doesn't beat the lossless result nothing is dropped, so nothing gets stored.
    """
    target = policy.target_tokens
    protected = jt.protected_segments(text, fmt)
    if target is not None and target < estimate("".join(protected)):
        return text, "unreachable_target", [], [], None
    plan = policy.plan(fmt)
    later = [e for e in plan if policy.lossy and e.id in ("json_field_fold", "json_value_dict")]
    text, rows = _run([e for e in plan if e not in later], policy, text, protected)
    dropped, instead = [], None
    if policy.lossy:
        lossless, more = _run(later, policy, text, protected)
        now, bar = estimate(text), estimate(lossless)
        status, reason, got = "skipped", None, None
        if target is not None and bar <= target:
            reason = "target_already_met"
        elif fmt != "json":
            reason = "not_applicable_to_format"
        else:
            try:
                got = prune(text, policy.lossy_ratio, policy.preserve_paths, policy.namespace, refuse=_has_secret)
            except jt.JsonError:
                reason = "not_applicable_to_format"
            else:
                status = "no_op" if got is None else "applied" if estimate(got.text) < bar and all(p in got.text for p in protected) else "rolled_back"
        if status == "applied":
            rows.append(_receipt("json_prune", "1.0.0", now, estimate(got.text), status))
            rows += [_receipt(e.id, e.version, estimate(got.text), estimate(got.text), "skipped", "incompatible_with_lossy") for e in later]
            text, dropped, instead = got.text, list(got.dropped), lossless
        else:
            rows.append(_receipt("json_prune", "1.0.0", now, now, status, reason))
            text, rows = lossless, rows + more
    return text, "compressed" if target is not None and estimate(text) <= target else "best_effort", rows, dropped, instead


_JSON = f"out string, status string, transforms {TRANSFORMS}, dropped array<struct<hash: string, body: string>>, lossless string"
_RECEIPT = pa.struct([("id", pa.string()), ("version", pa.string()), ("tokens_before", pa.int64()), ("tokens_after", pa.int64()), ("status", pa.string()), ("skipped_reason", pa.string())])
_JSON_TYPE = pa.struct([("out", pa.string()), ("status", pa.string()), ("transforms", pa.list_(_RECEIPT)), ("dropped", pa.list_(pa.struct([("hash", pa.string()), ("body", pa.string())]))), ("lossless", pa.string())])


def _json_result(policy: Policy):
    """An Arrow function of clean text and format; null for rows of text formats."""
    names = [f.name for f in _RECEIPT]

    def piece(texts: list[str | None], formats: list[str]) -> list[dict | None]:
        rows: list[dict | None] = []
        for t, f in zip(texts, formats, strict=True):
            if t is None:
                rows.append(None)
                continue
            out, status, receipts, dropped, lossless = compress_json(t, f, policy)
            rows.append({"out": out, "status": status, "transforms": [dict(zip(names, r, strict=True)) for r in receipts], "dropped": [{"hash": h, "body": x} for h, x in dropped], "lossless": lossless})
        return rows

    @F.arrow_udf(_JSON)
    def run(texts: pa.Array, formats: pa.Array) -> pa.Array:
        return by_pieces(piece, _JSON_TYPE, texts, formats)

    return run


# --- text -------------------------------------------------------------------------------------

_TEXT = {"log_field_fold": lambda t, p: L.fold_log(t), "log_compaction": lambda t, p: L.compact_log(t), "diff_compaction": lambda t, p: L.compact_diff(t, p.scope != "change_summary")}


TEXT_FORMATS = ("plain_text", "command_output", "git_diff")


def _text_result(df: DataFrame, policy: Policy) -> DataFrame:
    """df (clean, format, met) with out, transforms and status of rows in text formats, all formats in one chain of columns; a transform that a format's plan lacks costs its rows nothing."""
    target = policy.target_tokens
    plans = {f: policy.plan(f) for f in TEXT_FORMATS}
    heads = F.filter(F.split("clean", "\n", -1), lambda x: x.startswith("diff --git") | x.startswith("--- ") | x.startswith("+++ ") | x.startswith("@@"))
    heads = F.when(F.col("format") == "git_diff", F.transform(heads, lambda x: F.concat(x, F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("protected", heads).withColumn("out", F.col("clean")).withColumn("transforms", F.expr(f"cast(array() as {TRANSFORMS})"))
    stuck = tokens(F.array_join("protected", "")) > target if target is not None else F.lit(False)
    out = out.withColumn("stuck", stuck)
    for e in dict.fromkeys(e for f in TEXT_FORMATS for e in plans[f]):
        runs = F.col("format").isin([f for f in TEXT_FORMATS if e in plans[f]]) & ~F.col("stuck") & ~F.col("met")
        out = out.withColumn("made", F.when(runs, _TEXT[e.id](F.col("out"), policy))).withColumn("before", tokens("out")).withColumn("after", tokens("made"))
        lost = F.exists("protected", lambda x: ~F.col("made").contains(x))
        gate = F.when(~runs, "none").when(F.lit(False) if target is None else F.col("before") <= target, "skipped:target_already_met")
        gate = gate.when(F.col("made").isNull(), "skipped:not_applicable_to_format").when(F.col("after") > F.col("before"), "skipped:would_increase_tokens").when(F.col("after") == F.col("before"), "no_op")
        gate = gate.when(1 - F.col("after") / F.greatest("before", F.lit(1)) > policy.cap(e), "skipped:not_enabled_in_mode").when(lost, "rolled_back").otherwise("applied")
        out = out.withColumn("gate", gate)
        now = F.when(F.col("gate") == "applied", F.col("after")).otherwise(F.col("before"))
        row = F.struct(F.lit(e.id).alias("id"), F.lit(e.version).alias("version"), F.col("before").alias("tokens_before"), now.alias("tokens_after"), F.substring_index("gate", ":", 1).alias("status"), F.when(F.col("gate").contains(":"), F.substring_index("gate", ":", -1)).alias("skipped_reason"))
        out = out.withColumn("transforms", F.when(F.col("gate") == "none", F.col("transforms")).otherwise(F.concat("transforms", F.array(row)))).withColumn("out", F.when(F.col("gate") == "applied", F.col("made")).otherwise(F.col("out")))
    done = F.lit("best_effort") if target is None else F.when(F.col("stuck"), "unreachable_target").when(tokens("out") <= target, "compressed").otherwise("best_effort")
    return out.withColumn("status", done).drop("protected", "stuck", "made", "before", "after", "gate")


def compress(payloads: DataFrame, policy: Policy = Policy(), fmt: Column | None = None) -> DataFrame:
    """A receipt for each of payloads (payload_id, body): format, tokens before and after, savings, status, transforms, dropped items and out.

    The source is read once: text formats are one chain of columns, JSON rows are what the Arrow function works on (others
    reach it as nulls). A payload that meets the target as it is passes through unchanged, unredacted too. Null bodies
    count as empty. Where items were dropped, lossless is what the payload is without that, and quality is unvalidated.
    """
    rows = payloads.select("payload_id", F.coalesce("body", F.lit("")).alias("body"))
    rows = rows.withColumn("format", detect_format("body") if fmt is None else fmt).withColumn("original_tokens", tokens("body"))
    rows = rows.withColumn("met", F.lit(False) if policy.target_tokens is None else F.col("original_tokens") <= policy.target_tokens)
    rows = rows.withColumn("clean", F.when(F.col("met"), F.col("body")).otherwise(redact("body"))).withColumn("redacted", F.when(F.col("met"), F.lit(0).cast("long")).otherwise(redaction_count("body"))).drop("body")
    is_json = F.col("format").isin(*JSON_FORMATS) & ~F.col("met")
    work = rows.withColumn("json", bounded(_json_result(policy), F.when(is_json, F.col("clean")), F.col("format")))
    work = _text_result(work, policy)
    pick = lambda c: F.when(is_json, F.col("json")[c]).otherwise(F.col(c))
    out = work.withColumn("out", pick("out")).withColumn("transforms", pick("transforms"))
    out = out.withColumn("status", F.when(F.col("met"), "passthrough").otherwise(pick("status"))).withColumn("compressed_tokens", tokens("out"))
    none = F.expr("cast(array() as array<struct<hash: string, body: string>>)")
    out = out.withColumn("dropped", F.coalesce(F.col("json.dropped"), none)).withColumn("lossless", F.col("json.lossless"))
    saved = F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0))
    share = F.when(F.col("original_tokens") == 0, 0.0).otherwise(saved / F.col("original_tokens"))
    out = out.withColumn("saved_tokens", saved).withColumn("savings_ratio", share).withColumn("savings_pct", share * 100).withColumn("mode", F.lit(policy.mode)).withColumn("scope", F.lit(policy.scope))
    quality = F.when(F.exists("transforms", lambda t: (t["id"] == "json_prune") & (t["status"] == "applied")), "unvalidated")
    return out.withColumn("quality", quality).select("payload_id", "format", "original_tokens", "out", "compressed_tokens", "redacted", "status", "transforms", "dropped", "lossless", "quality", "saved_tokens", "savings_ratio", "savings_pct", "mode", "scope")
