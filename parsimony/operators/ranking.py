"""Ranking of units (lines) or chunks, and greedy allocation under a token ceiling."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsimony.functions.batches import bound_batches, give_back, pieces


def tokenize_alnum(c: Column) -> Column:
    """Lower-cased runs of letters and digits, Unicode-wide."""
    return F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+", -1), lambda x: x != "")


def tokenize_words(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)


def _times(term: str) -> Column:
    return F.size(F.filter("__t", lambda x: x == F.lit(term)))


def bm25(chunks: DataFrame, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, text and score of every chunk. query: its terms; one that is given twice counts twice; chunks without any score 0.

    Term counts are higher-order functions within the row, so text is not exploded; only the few totals are aggregated.
    """
    terms = list(query)
    distinct = list(dict.fromkeys(terms))
    toks = chunks.withColumn("__t", tokenize_alnum(F.col("text"))).withColumn("__dl", F.size("__t"))
    # the tokens are read once; what is left for each term are the few that the query names
    named = F.filter("__t", lambda x: x.isin(distinct)) if distinct else F.array().cast("array<string>")
    tf = toks.withColumn("__t", named)
    tf = tf.select("*", *(_times(t).alias(f"__tf{i}") for i, t in enumerate(distinct)))
    totals = tf.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *(F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(distinct))))
    both = tf.crossJoin(F.broadcast(totals))  # totals is one row
    score = F.lit(0.0)
    for t in terms:
        i = distinct.index(t)
        df, f = F.col(f"__df{i}"), F.col(f"__tf{i}")
        idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__dl") / F.col("__avg")))).otherwise(0.0)
    return both.select("id", "text", score.alias("score"))


def bm25_topk(chunks: DataFrame, query: Sequence[str], k: int) -> DataFrame:
    """The k best chunks, ties by id; a top-k, no full sort."""
    return bm25(chunks, query).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, units: the text's lines with their ends kept."""
    return docs.select("doc_id", F.filter(F.split(F.col(text), "(?<=\n)", -1), lambda x: x != "").alias("units"))


def forced(unit: Column, atoms: Sequence[str]) -> Column:
    """Whether a unit holds any of the critical atoms."""
    out = F.lit(False)
    for a in atoms:
        if a:
            out = out | unit.contains(a)
    return out


#: Selectors that need no learning.
BASELINES = ("keep_all", "forced_only", "recency", "frequency", "surprisal", "bm25")
Scorer = Callable[[list[str], Sequence[str]], list[float]]
_WORD = re.compile("[A-Za-z0-9_]+")


def _frequency(units: list[list[str]]) -> list[float]:
    """Each unit's distinct words, weighted by how few units hold them."""
    df = Counter(t for w in units for t in set(w))
    return [math.fsum(1.0 / df[t] for t in set(w)) for w in units]


def _surprisal(units: list[list[str]]) -> list[float]:
    """Mean information of a unit's words under their shares of the document."""
    n = Counter(t for w in units for t in w)
    total = sum(n.values())
    return [math.fsum(-math.log2(n[t] / total) for t in w) / len(w) if w else 0.0 for w in units]


def _bm25(units: list[list[str]], query: Sequence[str], k1: float = 1.5, b: float = 0.75) -> list[float]:
    """Units as the documents of a small corpus of their own."""
    q = {t.lower() for t in query}
    counts = [Counter(t for t in w if t in q) for w in units]
    df = Counter(t for c in counts for t in c)
    average = sum(map(len, units)) / len(units) if units else 0.0
    idf = {t: math.log(1 + (len(units) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    return [math.fsum(idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(w) / average)) for t, n in c.items()) for w, c in zip(units, counts, strict=True)]


def words(text: str) -> list[str]:
    return [t.lower() for t in _WORD.findall(text)]


def bm25_units(units: list[str], query: Sequence[str]) -> list[float]:
    return _bm25(list(map(words, units)), query)


def unit_scores(per_doc: DataFrame, selector: str, query: Sequence[str] = (), learned: dict[str, Scorer] | None = None) -> DataFrame:
    """doc_id, pos, unit, score. selector: one of BASELINES, or of `learned`: functions of a document's units and the query.

    What needs counts needs only those of one document, so they are made where its row is, in one Arrow pass without a shuffle.
    A learned selector may not take a baseline's name, and gives scores only: forcing and allocation stay as they are.
    """
    learned = learned or {}
    if clash := sorted(set(learned) & set(BASELINES)):
        raise ValueError(f"learned selectors may not be named like baselines: {', '.join(clash)}")
    if selector in ("recency", "keep_all", "forced_only"):
        score = {"recency": F.col("pos").cast("double"), "keep_all": F.lit(math.inf), "forced_only": F.lit(-math.inf)}[selector]
        return per_doc.select("doc_id", F.posexplode("units").alias("pos", "unit")).withColumn("score", score)
    if selector not in BASELINES and selector not in learned:
        raise ValueError(f"unknown selector {selector}")
    terms = list(query)

    def scores(units: list[str]) -> list[float]:
        if selector in learned:
            got = [float(x) for x in learned[selector](units, terms)]
            if len(got) != len(units):
                raise ValueError(f"{selector} gave {len(got)} scores for {len(units)} units")
            return got
        found = list(map(words, units))
        return _frequency(found) if selector == "frequency" else _surprisal(found) if selector == "surprisal" else _bm25(found, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("units")
            for ids, units in pieces([b.column(1 - at), b.column(at)]):
                got = [scores(u) if u else [] for u in units.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, units, pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "units", "scores"])
        give_back()

    bound_batches(per_doc.sparkSession)
    kind = per_doc.schema["doc_id"].dataType.simpleString()
    rows = per_doc.select("doc_id", "units").mapInArrow(run, f"doc_id {kind}, units array<string>, scores array<double>")
    return rows.select("doc_id", F.posexplode(F.arrays_zip("units", "scores")).alias("pos", "x")).select("doc_id", "pos", F.col("x.units").alias("unit"), F.col("x.scores").alias("score"))


def allocate(scored: DataFrame, ceiling: Column, atoms: Sequence[str] = ()) -> DataFrame:
    """doc_id and kept: forced units, then by falling score (ties by place) whatever still fits under the ceiling of tokens; one that does not fit is left out, later ones may fit.

    Tokens are a quarter of the bytes, rounded up, of what is kept as a whole. ceiling: a column over total_bytes.
    """
    rows = scored.withColumn("b", F.octet_length("unit")).withColumn("f", forced(F.col("unit"), atoms))
    docs = rows.groupBy("doc_id").agg(
        F.sum("b").alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("f"), F.col("b"))), F.lit(0)).alias("at"),
        F.array_sort(F.collect_list(F.when(F.col("f"), F.col("pos")))).alias("must"),
        F.sort_array(F.collect_list(F.when(~F.col("f"), F.struct((-F.round("score", 9)).alias("s"), "pos", "b")))).alias("rest"),
    )
    docs = docs.withColumn("ceiling", ceiling.cast("long"))
    fold = F.aggregate(
        "rest",
        F.struct(F.col("at").cast("long").alias("bytes"), F.col("must").alias("kept")),
        lambda a, x: F.when((x["s"] < F.lit(math.inf)) & (F.ceil((a["bytes"] + x["b"]) / 4) <= F.col("ceiling")), F.struct((a["bytes"] + x["b"]).cast("long").alias("bytes"), F.concat(a["kept"], F.array(x["pos"])).alias("kept"))).otherwise(a),
    )
    out = docs.withColumn("got", fold)
    return out.select("doc_id", F.array_sort("got.kept").alias("kept"), F.col("got.bytes").alias("kept_bytes"), "total_bytes", "ceiling")


def task_score(kept_text: Column, atoms: Column, gold: Column) -> Column:
    """Whether gold, and which share of the atoms, stand in the text, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    text = bare(kept_text)
    n = F.size(atoms)
    hit = F.size(F.filter(atoms, lambda a: text.contains(bare(a))))
    return F.struct(F.when(text.contains(bare(gold)), 1.0).otherwise(0.0).alias("task_success"), F.when(n == 0, 1.0).otherwise(hit / n).alias("survival"))


def baseline_report(rows: DataFrame) -> DataFrame:
    """Means by selector and ratio, to four places."""
    m = lambda c: F.round(F.avg(c), 4)
    return rows.groupBy("selector", "ratio").agg(m("task_success").alias("mean_task_success"), m("survival").alias("mean_survival"), m("achieved_ratio").alias("mean_achieved_ratio"), F.sum(F.col("over_budget").cast("long")).alias("over_budget_count"))
