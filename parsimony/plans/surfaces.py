"""Ways in: provider payloads, chat tables, previews, retrieval by marker, and SQL names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsimony.functions.text import SECRETS, retrieval_reference
from parsimony.operators import json_columns as J
from parsimony.operators import store
from parsimony.plans.compress import compress
from parsimony.plans.policy import Policy

#: Adapters and the wire format of each.
ADAPTERS = {"openai_chat": "openai_json", "anthropic_messages": "anthropic_json", "litellm_proxy": "openai_json", "vercel_ai_sdk": "openai_json"}


def compress_for(payloads: DataFrame, adapter: str, policy: Policy = Policy()) -> DataFrame:
    """Receipts of provider payloads (payload_id, body) with shape_kept: messages' number, roles and calls are as they were."""
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter}; known are {', '.join(ADAPTERS)}")
    fmt = ADAPTERS[adapter]
    got = compress(payloads, policy, F.lit(fmt))
    return got.join(payloads.select("payload_id", "body"), "payload_id").withColumn("shape_kept", J.shape_kept("body", "out", fmt)).drop("body")


def compress_openai_payload(payloads: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return compress_for(payloads, "openai_chat", policy)


def compress_anthropic_payload(payloads: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return compress_for(payloads, "anthropic_messages", policy)


def compress_messages(turns: DataFrame, adapter: str = "openai_chat", policy: Policy = Policy(), conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """Receipts of conversations given as a table of turns; a provider that takes the system apart gets it apart."""
    fmt = ADAPTERS[adapter]
    rows = turns.groupBy(F.col(conv).alias("payload_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.coalesce(F.col(content), F.lit("")).alias("content")))).alias("a"))
    message = lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))
    if fmt == "anthropic_json":
        system = F.array_join(F.transform(F.filter("a", lambda x: x["role"] == "system"), lambda x: x["content"]), "\n")
        body = F.to_json(F.struct(system.alias("system"), F.transform(F.filter("a", lambda x: x["role"] != "system"), message).alias("messages")))
    else:
        body = F.to_json(F.struct(F.transform("a", message).alias("messages")))
    return compress_for(rows.select("payload_id", body.alias("body")), adapter, policy)


def inspect(payloads: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Receipts as compress would give them, without the payloads; nothing is stored."""
    return compress(payloads, replace(policy, preview=True)).drop("out", "dropped", "lossless")


def retrieve(asked: DataFrame, entries: DataFrame, now: int, namespace: str = "default") -> DataFrame:
    """asked (marker, hash) with the hash meant, its status and, if found, the body."""
    ref = asked.select("*", F.lit(namespace).alias("namespace"), retrieval_reference("marker", "hash").alias("__asked"))
    got = store.retrieve(entries, ref.select("namespace", F.col("__asked").alias("hash")).where("hash is not null").distinct(), now)
    got = got.select(F.col("hash").alias("__asked"), "status", "body")
    return ref.join(got, "__asked", "left").select(*asked.columns, F.col("__asked").alias("asked"), F.coalesce("status", F.lit("invalid")).alias("status"), "body")


def register(spark: SparkSession, prefix: str = "parsimony_") -> list[str]:
    """SQL functions over single payloads, in this session; gives their names."""
    clean = "x"
    for pattern, put in SECRETS:
        clean = f"regexp_replace({clean}, r'{pattern}', '{put}')"
    bodies = {"tokens": ("BIGINT", "CAST(ceil(octet_length(x) / 4) AS BIGINT)"), "redact": ("STRING", clean), "contains_secret": ("BOOLEAN", " OR ".join(f"x RLIKE r'{p}'" for p, _ in SECRETS))}
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS {kind} RETURN {body}")
    names = ("minify", "field_fold", "field_unfold", "value_dict", "value_undict", "schema_compact")
    for name in names:
        spark.udf.register(prefix + name, getattr(J, name).udf)
    return [prefix + n for n in (*bodies, *names)]
