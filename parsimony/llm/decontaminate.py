"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores token postings of the training texts: the corpus is cut into segments of a few MB, and each
stored row is one segment's inverted index (terms, where each term's positions begin, ascending positions in the
segment's own token space, with gaps so that no phrase spans two documents). Only terms that some item uses get
postings, as no other list is ever read. `search` intersects offset-adjusted position lists for each window,
starting from its rarest term in the segment, and gives exact phrase and proximity matches. Nothing is shuffled.

The benchmark is the stated query set. It goes to the tasks in blocks of at most BLOCK_WORDS words, one pass over
the corpus for each block, so what is broadcast has a bound at any size.

Defined results: a null or empty text has no words and no hits; an item without words matches nothing; repeated
document rows each get a row; repeated item rows count as one item_id; null item_ids take no part; a text longer than
a segment is a segment of its own; empty tables give no rows or no hits; other columns are not read, whatever their
names, and pass through drop_contaminated.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, column, free_name, id_and_text, stored, text_buffer

#: Window length in words; a shorter item is one window.
WINDOW = 8
#: Words of benchmark items that one pass takes.
BLOCK_WORDS = 2_000_000
#: How far each word of a proximity match may be off its place.
SLOP = 2

#: Word bytes become lower case, all others a space. Every byte of a non-ASCII character is a word byte.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


class Phrases:
    """Distinct windows of one block of items: term ids, the items that hold each window, and the windows filed under their rarest term."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int = WINDOW):
        found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, w in items:
            for i in range(max(1, len(w) - n + 1) if w else 0):
                found[tuple(w[i : i + n])].add(item)
        self.terms = {t: k for k, t in enumerate(sorted({t for p in found for t in p}))}
        self.lens = np.fromiter((len(p) for p in found), np.int64, len(found))
        #: Term ids of each window; a shorter one repeats its last term.
        self.windows = np.array([[self.terms[t] for t in (*p, *[p[-1]] * (n - len(p)))] for p in found], np.int64).reshape(-1, n)
        self.items = [sorted(x) for x in found.values()]
        self.n = n
        uses = np.bincount(self.windows.ravel(), minlength=len(self.terms))
        key = self.windows[np.arange(len(self.windows)), uses[self.windows].argmin(1)] if len(found) else np.empty(0, np.int64)
        self.filed = np.argsort(key, kind="stable")
        self.file_begins = np.searchsorted(key[self.filed], np.arange(len(self.terms) + 1))

    def within(self, there: np.ndarray) -> np.ndarray:
        """Windows all of whose terms are among `there`; only windows filed under one of them are looked at."""
        has = np.zeros(len(self.terms), bool)
        has[there] = True
        begins, ends = self.file_begins[there], self.file_begins[there + 1]
        at = self.filed[np.repeat(begins - (np.cumsum(ends - begins) - (ends - begins)), ends - begins) + np.arange((ends - begins).sum())]
        return at[has[self.windows[at]].all(1)]


def item_blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (item_id as text, words), row by row from the cluster, in bounded blocks."""
    block: list = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text"), F.lit(""))).where("item_id is not null")
    for item, text in rows.toLocalIterator():
        block.append((item, words(text)))
        size += len(block[-1][1])
        if size >= most:
            yield block
            block, size = [], 0
    yield block


SEGMENT = "doc_ids array<long>, starts binary, n_words binary, terms binary, begins binary, positions binary"


class Segment:
    """Inverted index of a few MB of documents, in one token space with a gap behind each document."""

    def __init__(self, starts: np.ndarray, n_words: np.ndarray, terms: np.ndarray, begins: np.ndarray, positions: np.ndarray):
        self.starts, self.n_words, self.terms, self.begins, self.positions = starts, n_words, terms, begins, positions

    @classmethod
    def of(cls, texts: pa.Array, phrases: Phrases) -> Segment:
        raw, off = text_buffer(texts)
        raw, get = raw.tobytes().translate(_TABLE), phrases.terms.get
        ids, n_words = [np.empty(0, np.int32)], np.empty(len(texts), np.int64)
        for i in range(len(texts)):
            w = raw[off[i] : off[i + 1]].split()
            n_words[i] = len(w)
            ids.append(np.fromiter((get(x, -1) for x in w), np.int32, len(w)))
        starts = np.concatenate([[0], np.cumsum(n_words + phrases.n + SLOP)])[:-1]
        term = np.concatenate(ids)
        place = np.repeat(starts - (np.cumsum(n_words) - n_words), n_words) + np.arange(len(term))
        keep = term >= 0
        term, place = term[keep], place[keep]
        order = np.argsort(term, kind="stable")
        used, begins = np.unique(term[order], return_index=True)
        return cls(starts, n_words, used.astype(np.int32), np.append(begins, len(term)).astype(np.int64), place[order].astype(np.int32))

    def search(self, phrases: Phrases, slop: int = 0) -> tuple[list[list[tuple[int, int]]], list[set[str]], list[set[str]], list[bool]]:
        """For each document: disjoint spans of words in exact matches, items that match exactly, items that match within slop, and whether a window of full length matches exactly."""
        lists = {int(t): self.positions[self.begins[k] : self.begins[k + 1]].astype(np.int64) for k, t in enumerate(self.terms)}
        n = len(self.starts)
        spans: list[list] = [[] for _ in range(n)]
        hit: list[set] = [set() for _ in range(n)]
        near: list[set] = [set() for _ in range(n)]
        whole = [False] * n
        for k in phrases.within(self.terms.astype(np.int64)).tolist():
            w, of = phrases.windows[k, : phrases.lens[k]].tolist(), phrases.items[k]
            at = phrase_places(lists, w)
            for p, d in zip(at.tolist(), (np.searchsorted(self.starts, at, "right") - 1).tolist(), strict=True):
                spans[d].append((p - int(self.starts[d]), p - int(self.starts[d]) + len(w)))
                hit[d].update(of)
                whole[d] |= len(w) == phrases.n
            if slop and len(w) > 1:
                at = phrase_places(lists, w, slop)
                for d in (np.searchsorted(self.starts, at + slop, "right") - 1).tolist():
                    near[d].update(of)
        return [merged(x) for x in spans], hit, near, whole


def build_index(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """One row for each segment: its documents and the postings of the phrases' terms."""

    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = Segment.of(column(b, "text"), shared.value)
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (s.starts, s.n_words, s.terms, s.begins, s.positions)]
            yield pa.RecordBatch.from_arrays([pa.array([column(b, "doc_id").to_pylist()], pa.list_(pa.int64())), *blobs], names=["doc_ids", "starts", "n_words", "terms", "begins", "positions"])

    return id_and_text(docs).mapInArrow(run, SEGMENT)


def phrase_places(lists: dict[int, np.ndarray], window: list[int], slop: int = 0) -> np.ndarray:
    """Where the window begins: lists adjusted by offset are intersected, from the rarest term to the commonest.

    With slop, each word may stand up to `slop` places off its place behind the window's first word.
    """
    order = sorted(range(len(window)), key=lambda i: (len(lists[window[i]]), i))
    at = lists[window[order[0]]] - order[0]
    if slop and order[0]:
        at = np.intersect1d(at[:, None] + np.arange(-slop, slop + 1), lists[window[0]])
    for i in order[1:]:
        if not len(at):
            break
        there = lists[window[i]]
        k = np.searchsorted(there, at + i - slop)
        at = at[(k < len(there)) & (there[np.minimum(k, len(there) - 1)] <= at + i + slop)]
    return at


def search(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """doc_id, n_words, spans (first word and the one behind the last, flattened), items and near of every document; ord: its place in its segment."""
    if slop > SLOP:
        raise ValueError(f"the index keeps documents apart by the window and {SLOP} words")
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ints = lambda c, kind=np.int64: np.frombuffer(column(b, c)[r].as_py(), kind)
                s = Segment(ints("starts"), ints("n_words"), ints("terms", np.int32), ints("begins"), ints("positions", np.int32))
                spans, hit, near, _ = s.search(shared.value, slop)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column(b, "doc_ids")[r].as_py(), pa.int64()),
                        pa.array(s.n_words, pa.int64()),
                        pa.array([[x for y in m for x in y] for m in spans], pa.list_(pa.int64())),
                        pa.array([sorted(x) for x in hit], pa.list_(pa.string())),
                        pa.array([sorted(x) for x in near], pa.list_(pa.string())),
                        pa.array(range(len(spans)), pa.int64()),
                    ],
                    names=["doc_id", "n_words", "spans", "items", "near", "ord"],
                )

    return index.mapInArrow(run, "doc_id long, n_words long, spans array<long>, items array<string>, near array<string>, ord long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same places, in order."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _summed(matches: DataFrame) -> DataFrame:
    ends = F.aggregate(F.filter("spans", lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda n, x: n + x)
    begins = F.aggregate(F.filter("spans", lambda x, i: i % 2 == 0), F.lit(0).cast("long"), lambda n, x: n + x)
    return matches.select(
        "doc_id",
        "n_words",
        (ends - begins).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, spans, items and near for every row of docs, from stored postings."""
    parts = []
    for block in item_blocks(benchmark):
        if block or not parts:
            phrases = Phrases(block, n)
            parts.append(search(stored(build_index(docs, phrases), "postings"), phrases, slop))
    return parts[0] if len(parts) == 1 else _joined_blocks(parts)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    return _summed(matches(docs, benchmark, n))


def _joined_blocks(parts: list[DataFrame]) -> DataFrame:
    """Spans and items of several item blocks for the same document; a document's repeated rows match alike and stay apart by count."""
    many = parts[0]
    for p in parts[1:]:
        many = many.unionByName(p)
    grouped = many.groupBy("doc_id", "n_words").agg(F.collect_set("spans").alias("s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"), (F.count("*") / len(parts)).cast("int").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [merged([(x[i], x[i + 1]) for x in s for i in range(0, len(x), 2)]) for s in column(b, "s").to_pylist()]
            spans = pa.array([[x for s in r for x in s] for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "n_words"), spans, column(b, "items"), column(b, "near"), column(b, "copies")], names=["doc_id", "n_words", "spans", "items", "near", "copies"])

    done = grouped.mapInArrow(run, "doc_id long, n_words long, spans array<long>, items array<string>, near array<string>, copies int")
    return done.select("doc_id", "n_words", "spans", "items", "near", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("ord"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without rows that hold a whole window of WINDOW words of any item, or windows of two items or more.

    One window is enough, as a leaked passage comes from one item as a rule; an item of fewer words than a window is
    too weak a sign alone. Every other row stays, ids null or repeated too. Each segment's postings are searched where
    they are built, so whole rows pass by without a shuffle; a further block of items is a further pass, which carries
    the items found so far.
    """
    names, found = docs.columns, free_name(docs.columns, "items")
    bound_batches(docs.sparkSession)
    out = docs.withColumn(found, F.array().cast("array<string>"))
    for block in item_blocks(benchmark):
        if block:
            out = out.mapInArrow(_marker(docs.sparkSession, Phrases(block), names, found), out.schema)
    return out.where((F.size(found) < 2) & ~F.array_contains(found, _WHOLE)).drop(found)


#: Stands in the list of items for a match of WINDOW words; no item_id holds a NUL twice.
_WHOLE = "\0\0"


def _marker(spark: SparkSession, phrases: Phrases, names: list[str], found: str):
    shared = spark.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            _, hit, _, whole = Segment.of(column(b, "text"), shared.value).search(shared.value)
            items = [sorted(h.union(old, [_WHOLE] if w else [])) for h, old, w in zip(hit, column(b, found).to_pylist(), whole, strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(items, pa.list_(pa.string()))], names=[*names, found])

    return run


ORACLE = r"""
WITH w AS (
  SELECT doc_id, rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents)
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, array_to_string(w[i:least(i + 7, len(w))], ' ') AS phrase, least(8, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win
), grams AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, lens WHERE len(w) >= n)
), hits AS (
  SELECT g.rid, g.i, g.n, win.item FROM grams g JOIN win ON g.phrase = win.phrase AND g.n = win.n
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN covered USING (rid) LEFT JOIN its USING (rid)
"""
