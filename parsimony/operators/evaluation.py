"""Selectors and compressors over task fixtures under token ceilings, and the invariants that they must keep.

Fixtures: id, source, query, gold_answer, critical_atoms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsimony.functions.text import tokens
from parsimony.operators import ranking
from parsimony.plans.compress import compress
from parsimony.plans.policy import Policy

ROW = ("id", "selector", "ratio", "budget_tokens", "achieved_tokens", "forced_floor_tokens", "task_success", "survival", "achieved_ratio", "over_budget")


def _with_budgets(fixtures: DataFrame, ratios: Sequence[float]) -> DataFrame:
    rows = fixtures.select("id", "source", "gold_answer", "critical_atoms", F.explode(F.array(*(F.lit(float(r)) for r in ratios))).alias("ratio"))
    return rows.withColumn("raw_tokens", tokens("source")).withColumn("budget_tokens", F.floor(F.col("raw_tokens") * F.col("ratio")).cast("long"))


def _scored(rows: DataFrame) -> DataFrame:
    """rows with kept (the text that is left) and forced_floor_tokens, as ROW."""
    s = ranking.task_score(F.col("kept"), F.coalesce("critical_atoms", F.array().cast("array<string>")), F.col("gold_answer"))
    out = rows.withColumn("achieved_tokens", tokens("kept")).withColumn("s", s)
    out = out.withColumn("achieved_ratio", F.when(F.col("raw_tokens") == 0, 1.0).otherwise(F.col("achieved_tokens") / F.col("raw_tokens")))
    return out.select("id", "selector", "ratio", "budget_tokens", "achieved_tokens", "forced_floor_tokens", "s.task_success", "s.survival", "achieved_ratio", (F.col("achieved_tokens") > F.col("budget_tokens")).alias("over_budget"))


def selector_rows(fixtures: DataFrame, ratios: Sequence[float], selector: str, learned: dict | None = None) -> DataFrame:
    """Units with a critical atom stay; others by falling score (ties by place) while they fit. keep_all knows no ceiling."""
    units = fixtures.select(F.col("id").alias("doc_id"), F.filter(F.split("source", "(?<=\n)", -1), lambda x: x != "").alias("units"), F.coalesce("critical_atoms", F.array().cast("array<string>")).alias("atoms"), "query")
    if selector == "bm25":
        # the query's words that a fixture's own query has count, so each fixture is scored by its own: one Arrow pass with the query in front
        scored = ranking.unit_scores(units.select("doc_id", F.concat(F.array("query"), "units").alias("units")), "own_query", (), {"own_query": lambda us, _: [0.0, *ranking.bm25_units(us[1:], ranking.words(us[0]))]} | (learned or {}))
        scored = scored.where("pos > 0").withColumn("pos", F.col("pos") - 1)
    else:
        scored = ranking.unit_scores(units, selector, (), learned)
    scored = scored.join(units.select("doc_id", "atoms"), "doc_id")
    must = F.exists("atoms", lambda a: (a != "") & F.col("unit").contains(a))
    scored = scored.withColumn("must", must).withColumn("b", F.octet_length("unit").cast("long"))
    docs = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "unit", "must", "b", F.round("score", 9).alias("score")))).alias("us"))
    rows = _with_budgets(fixtures, ratios).join(docs, F.col("id") == F.col("doc_id"), "left")
    rows = rows.withColumn("us", F.coalesce("us", F.expr("cast(array() as array<struct<pos: int, unit: string, must: boolean, b: bigint, score: double>>)")))
    floor = F.aggregate("us", F.lit(0).cast("long"), lambda n, u: n + F.when(u["must"], u["b"]).otherwise(0))
    rows = rows.withColumn("floor", floor).withColumn("forced_floor_tokens", F.ceil(F.col("floor") / 4).cast("long"))
    if selector == "keep_all":
        chosen = F.transform("us", lambda u: u["pos"])
    else:
        rest = F.sort_array(F.transform(F.filter("us", lambda u: ~u["must"] & (u["score"] > F.lit(float("-inf")))), lambda u: F.struct((-u["score"]).alias("s"), u["pos"].alias("pos"), u["b"].alias("b"))))
        rows = rows.withColumn("rest", rest)
        start = F.struct(F.col("floor").alias("bytes"), F.transform(F.filter("us", lambda u: u["must"]), lambda u: u["pos"]).alias("kept"))
        fold = F.aggregate("rest", start, lambda a, x: F.when(F.ceil((a["bytes"] + x["b"]) / 4) <= F.col("budget_tokens"), F.struct((a["bytes"] + x["b"]).alias("bytes"), F.concat(a["kept"], F.array(x["pos"])).alias("kept"))).otherwise(a))
        chosen = fold["kept"]
    rows = rows.withColumn("chosen", chosen)
    kept = F.array_join(F.transform(F.filter("us", lambda u: F.array_contains("chosen", u["pos"])), lambda u: u["unit"]), "")
    return _scored(rows.withColumn("kept", kept).withColumn("selector", F.lit(selector)))


def compressor_rows(fixtures: DataFrame, ratios: Sequence[float], lossy: bool = False) -> DataFrame:
    """The engine itself as a baseline: lossless under a target of the budget, or lossy with the ratio as the share that is kept."""
    parts = []
    for r in ratios:
        rows = _with_budgets(fixtures, [r])
        policy = Policy(lossy="json_prune", lossy_ratio=min(0.99, r)) if lossy else Policy()
        got = compress(rows.select(F.col("id").alias("payload_id"), F.col("source").alias("body")), policy).select(F.col("payload_id").alias("id"), F.col("out").alias("kept"))
        parts.append(_scored(rows.join(got, "id").withColumn("selector", F.lit("lossy" if lossy else "lossless")).withColumn("forced_floor_tokens", F.lit(0).cast("long"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def baseline_gate(selectors: DataFrame, compressors: DataFrame) -> DataFrame:
    """check, selector, id, ratio of every broken invariant: atoms survive, ceilings hold where the forced floor allows it, keeping all succeeds, compressors lose no atom, and lossy is never larger than lossless."""
    bad = lambda df, cond, name: df.where(cond).select(F.lit(name).alias("check"), "selector", "id", "ratio")
    out = bad(selectors, F.col("survival") < 1, "atoms_survive")
    over = (F.col("selector") != "keep_all") & (F.col("achieved_tokens") > F.col("budget_tokens")) & (F.col("forced_floor_tokens") <= F.col("budget_tokens"))
    out = out.union(bad(selectors, over, "ceiling_holds"))
    out = out.union(bad(selectors, (F.col("selector") == "keep_all") & (F.col("task_success") < 1), "keep_all_succeeds"))
    out = out.union(bad(compressors, F.col("survival") < 1, "compressor_atoms_survive"))
    sizes = compressors.groupBy("id", "ratio").pivot("selector", ["lossless", "lossy"]).agg(F.first("achieved_tokens"))
    return out.union(bad(sizes.withColumn("selector", F.lit("lossy")), F.col("lossy") > F.col("lossless"), "lossy_not_larger"))
