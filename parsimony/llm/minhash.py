"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (a shorter text with words is one shingle), in lower case, hashed to 64 bits. A
shingle's weight in a text is its count times log(1 + documents / document frequency). Document frequencies are counted
over all documents in DIMENSIONS hashed dimensions, with the mean of collisions taken off, so the table that goes to
the tasks has a fixed size. Each distinct text draws BANDS * ROWS consistent weighted samples under TF-IDF weights and
as many under counts alone; texts with equal samples in a band meet. So a pair that either similarity below accepts
is missed with probability (1 - 0.8^ROWS)^BANDS at most, below 0.001, however large its group. Equal texts are one from
the start (by digest), so copies cost nothing further.

In a band's group each text is compared with the smallest and the largest digest only; links that hold join texts to
components. Groups with texts in different components are then compared whole, in tiles of a bounded number of
texts by matrix products that give a spanning set of the links between components, so no pair that meets in a band is
left out and no table of pairs is made. A link needs a weighted Jaccard similarity of 0.8
or more, under TF-IDF weights or under counts alone (large groups of near copies make their own shingles common, which
TF-IDF weights would hold against them).

Texts without words are copies of equal texts only; null counts as empty. class_id is the smallest doc_id of the
class (null if all are null); repeated rows get the same class. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, column, drop_stored, free_name, mix, text_buffer
from .common import written as stored
from .decontaminate import _TABLE

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
DIMENSIONS, SLICES = 1 << 22, 64
_PARAMETERS = 1 << 14


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_hashes = _Hashes()


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle of each text, in order of document and hash."""
    raw, off = text_buffer(texts)
    raw = raw.tobytes().translate(_TABLE)
    docs, parts, lens = [], [], []
    for i in range(len(texts)):
        w = raw[off[i] : off[i + 1]].split()
        if w:
            h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
            m = max(1, len(h) - n + 1)
            s = np.zeros(m, np.uint64)
            for j in range(min(n, len(h))):
                s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
            docs.append(i)
            parts.append(mix(s))
            lens.append(m)
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    doc, h = np.repeat(np.array(docs, np.int64), lens), np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def dimension(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each hashed dimension, over all documents."""
    bound_batches(docs.sparkSession)
    width = DIMENSIONS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, z = np.zeros(DIMENSIONS, np.uint32), 0, zstandard.ZstdCompressor(level=1)
        for b in blocks(batches, 1 << 20):
            _, h, _ = shingles(column(b, "text"))
            dims, k = np.unique(dimension(h), return_counts=True)
            counts[dims] += k.astype(np.uint32)
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array([z.compress(counts[i * width : (i + 1) * width].tobytes()) for i in range(SLICES)], pa.binary())], names=["slice", "n", "counts"])

    def added(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a slice's counts, one table a time
        total, n, z = np.zeros(width, np.uint64), 0, zstandard.ZstdDecompressor()
        for b in group:
            for c, k in zip(column(b, "counts"), column(b, "n").to_pylist(), strict=True):
                total += np.frombuffer(z.decompress(c.as_buffer(), max_output_size=4 * width), np.uint32)
                n += k
        blob = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["slice", "n", "counts"])

    part = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "slice int, n long, counts binary")
    rows = sorted(part.groupBy("slice").applyInArrow(added, "slice int, n long, counts binary").collect(), key=lambda r: r["slice"])
    if not rows:
        return np.ones(DIMENSIONS, np.float32)
    opened = lambda r: np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts, max_output_size=8 * width), np.uint64)
    n, total, out = rows[0].n, sum(int(opened(r).sum()) for r in rows), np.empty(DIMENSIONS, np.float32)
    for i, r in enumerate(rows):  # a slice at a time, so that the driver holds one table
        counts = opened(r).astype(np.float64)
        out[i * width : (i + 1) * width] = np.log1p(n / np.clip(counts - (total - counts) / (DIMENSIONS - 1), 1, max(n, 1)))
    return out


class Sampler:
    """Improved consistent weighted sampling: for each sample, tables of r and c from Gamma(2, 1) and of b from U(0, 1)."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, (samples, _PARAMETERS)).astype(np.float32).clip(1e-4)
        self.log_c = np.log(rng.gamma(2, 1, (samples, _PARAMETERS)).clip(1e-12)).astype(np.float32)
        self.b = rng.random((samples, _PARAMETERS), np.float32)

    def draw(self, h: np.ndarray, log_w: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Samples as hashes, a row for each set; begins: where each set's elements begin."""
        lens = np.diff(np.append(begins, len(h)))
        out = np.empty((len(begins), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            at = ((h * odd) >> np.uint64(64 - 14)).astype(np.int32)
            r, b = self.r[k][at], self.b[k][at]
            t = np.floor(log_w / r + b)
            a = self.log_c[k][at] - r * (t - b + 1)
            least = np.minimum.reduceat(a, begins)
            hit = np.flatnonzero(a == np.repeat(least, lens))
            hit = hit[np.searchsorted(hit, begins)]  # the first of each set
            out[:, k] = mix(h[hit] ^ mix(t[hit].astype(np.int64).view(np.uint64) + np.uint64(k)))
        return out

    def draw_counts(self, h: np.ndarray, n: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """draw() under weights that are counts: most are 1, whose terms are looked up."""
        lens = np.diff(np.append(begins, len(h)))
        out = np.empty((len(begins), len(self.odd)), np.uint64)
        more = np.flatnonzero(n > 1)
        log_w, t = np.log(n[more]).astype(np.float32), np.zeros(len(h), np.int64)
        for k, odd in enumerate(self.odd):
            at = ((h * odd) >> np.uint64(64 - 14)).astype(np.int32)
            a = (self.log_c[k] - self.r[k] * (1 - self.b[k]))[at]
            some = at[more]
            r, b = self.r[k][some], self.b[k][some]
            steps = np.floor(log_w / r + b)
            a[more] = self.log_c[k][some] - r * (steps - b + 1)
            t[more] = steps
            least = np.minimum.reduceat(a, begins)
            hit = np.flatnonzero(a == np.repeat(least, lens))
            hit = hit[np.searchsorted(hit, begins)]
            out[:, k] = mix(h[hit] ^ mix(t[hit].view(np.uint64) + np.uint64(k)))
        return out


def band_hashes(samples: np.ndarray, first: int = 0) -> np.ndarray:
    """Bands `first` and after."""
    out = np.empty((len(samples), BANDS), np.uint64)
    for j in range(BANDS):
        x = np.full(len(samples), first + j, np.uint64)
        for k in range(ROWS):
            x = mix(x * np.uint64(31) + samples[:, j * ROWS + k])
        out[:, j] = x
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Stored doc_id, key (digest of the text) and bands (none without words) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, plain, table = Sampler(), Sampler(seed=12), shared.value
        for b in blocks(batches, 1 << 20):
            doc, h, n = shingles(column(b, "text"))
            bands: list = [[] for _ in range(b.num_rows)]
            if len(doc):
                begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                log_w = np.log(n * table[dimension(h)]).astype(np.float32)
                drawn = np.hstack([band_hashes(sampler.draw(h, log_w, begins)), band_hashes(plain.draw_counts(h, n, begins), BANDS)])
                for i, x in zip(doc[begins].tolist(), drawn.view(np.int64).tolist(), strict=True):
                    bands[i] = x
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "key"), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    return stored(rows, "signatures", run, "doc_id long, key string, bands array<long>")


def vectors(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, the shingles (hash, count) and the number m of all of each text whose key is asked for, once."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text")).join(keys, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1 << 20):
            doc, h, n = shingles(column(b, "text"))
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            hs = [h[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
            ns = [n[at[i] : at[i + 1]].astype(np.uint16 if not len(n) or n.max() < 65536 else np.uint32).astype(np.uint32).tobytes() for i in range(b.num_rows)]
            ms = np.diff(np.concatenate([[0], np.cumsum(n)])[at])
            yield pa.RecordBatch.from_arrays([column(b, "key"), pa.array(hs, pa.binary()), pa.array(ns, pa.binary()), pa.array(ms, pa.int64())], names=["key", "h", "n", "m"])

    return rows.mapInArrow(run, "key string, h binary, n binary, m long").groupBy("key").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.first("m").alias("m"))


def similarity(h1: np.ndarray, n1: np.ndarray, h2: np.ndarray, n2: np.ndarray, table: np.ndarray) -> float:
    """The larger of the weighted Jaccard similarities under TF-IDF weights and under counts."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    w = table[dimension(h1)], table[dimension(h2)]
    both = np.minimum(n1[i], n2[j]).astype(np.float64)
    plain = both.sum() / (n1.sum() + n2.sum() - both.sum())
    shared = (both * w[0][i]).sum()
    return float(max(plain, shared / ((n1 * w[0]).sum() + (n2 * w[1]).sum() - shared)))


def verified(pairs: DataFrame, vecs: DataFrame, idf: np.ndarray, least: float = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b) of keys that are similar enough, stored."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    va, vb = (vecs.select(F.col("key").alias(x), F.col("h").alias(f"h{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    joined = pairs.join(va, "a").join(vb, "b").select("a", "b", "ha", "na", "hb", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            cols = [column(b, c) for c in ("ha", "na", "hb", "nb")]
            keep = []
            for i in range(b.num_rows):
                x = [np.frombuffer(c[i].as_buffer(), k) for c, k in zip(cols, (np.uint64, np.uint32, np.uint64, np.uint32), strict=True)]
                keep.append(similarity(x[0], x[1].astype(np.int64), x[2], x[3].astype(np.int64), table) >= least)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(b, "a").filter(mask), column(b, "b").filter(mask)], names=["a", "b"])

    return stored(joined, "links", run, "a string, b string")


def linked(members: list[tuple[np.ndarray, np.ndarray]], comps: list[str], table: np.ndarray, least: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs of members that are similar enough, as many as join what belongs together and is not one component yet. members: hashes and counts.

    The k-th copy of a shingle is a feature of its own, so shared counts are products of 0/1 matrices, a few thousand
    features at a time.
    """
    m, feats, owner = len(members), [], []
    plain, weighted = np.zeros(m), np.zeros(m)
    for i, (h, n) in enumerate(members):
        plain[i], weighted[i] = n.sum(), (n * table[dimension(h)]).sum()
        at = np.repeat(np.arange(len(h)), n)
        feats.append(np.stack([h[at], (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)]))
        owner.append(np.full(len(at), i))
    f, who = np.concatenate(feats, axis=1), np.concatenate(owner)
    _, first, col, df = np.unique(mix(f[0] + mix(f[1])), return_index=True, return_inverse=True, return_counts=True)
    common = np.flatnonzero(df > 1)
    place = np.full(len(df), -1)
    place[common] = np.arange(len(common))
    idf = table[dimension(f[0][first[common]])]
    keep = place[col] >= 0
    who, col = who[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    shared, shared_w = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for c in range(0, len(common), 4096):
        lo, hi = np.searchsorted(col, [c, c + 4096])
        x = np.zeros((m, min(4096, len(common) - c)), np.float32)
        x[who[lo:hi], col[lo:hi] - c] = 1
        shared += x @ x.T
        shared_w += (x * idf[c : c + 4096]) @ x.T
    sim = np.maximum(shared / (plain[:, None] + plain - shared), shared_w / (weighted[:, None] + weighted - shared_w))
    first_of: dict[str, int] = {}
    root = [first_of.setdefault(c, i) for i, c in enumerate(comps)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(sim >= least - 1e-4, 1)), strict=True):
        if find(i) != find(j) and similarity(*members[i], *members[j], table) >= least:  # in double precision
            root[find(i)] = find(j)
            out.append((int(i), int(j)))
    return out


#: Members of a group, and shingles in all of them, that one task compares with as many others.
TILE, TILE_SHINGLES = 400, 400_000


def links_between(rest: DataFrame, vecs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links (a, b) between components of members (band, hash, key, comp, size, shingles) of the same groups, in tiles of at most about 2 * TILE members and 2 * TILE_SHINGLES shingles.

    A tile gives a spanning set of its links, so no pairs are written out; a group of any size is spread over its tiles.
    """
    shared = rest.sparkSession.sparkContext.broadcast(idf)
    parts = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    dealt = rest.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.select("band", "hash", "key", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("band", "hash", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "key", "comp").join(vecs.select("key", "h", "n"), "key")

    def run(group_key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comps, members = [], []
        for b in group:
            comps += column(b, "comp").to_pylist()
            for h, n in zip(column(b, "h"), column(b, "n"), strict=True):
                members.append((np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64)))
        got = linked(members, comps, shared.value) if len(set(comps)) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([comps[i] for i, _ in got], pa.string()), pa.array([comps[j] for _, j in got], pa.string())], names=["a", "b"])

    return dealt.groupBy("band", "hash", "lo", "hi").applyInArrow(run, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """key and comp (one key of its component) of every key in links.

    In each round every key goes over to that one of its neighbours and itself that has most neighbours, ties by a hash of
    the round; links between the keys that are left are the next round's. So links are read once in the first round and
    grow fewer from there.
    """
    left = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels, turn = None, 0
    while labels is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = F.struct((-F.col("n")).alias("n"), F.xxhash64(F.lit(turn), "key").alias("h"), F.col("key"))
        ranks = stored(both.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n")).select("key", rank.alias("rank")), "ranks")
        best = both.join(ranks.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("rank").alias("near"))
        goes = stored(ranks.join(best, "key").select("key", F.least("rank", "near")["key"].alias("to")), "labels")
        ends = left
        for x in "ab":
            ends = ends.join(goes.select(F.col("key").alias(x), F.col("to").alias(f"to_{x}")), x)
        ends = stored(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(), "links")
        if labels is None:
            step = goes.withColumnRenamed("to", "comp")
        else:
            step = stored(labels.join(goes.withColumnRenamed("key", "comp"), "comp", "left").select("key", F.coalesce("to", "comp").alias("comp")), "labels")
            drop_stored(labels, goes)
        drop_stored(left, ranks)
        left, labels, turn = ends, step, turn + 1
    drop_stored(left)
    return labels


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored signatures (doc_id, key, bands) and key, comp of the keys that have near duplicates."""
    idf = idf_table(docs)
    rows = signatures(docs, idf)
    texts = rows.where(F.size("bands") > 0).groupBy("key").agg(F.first("bands").alias("bands"))
    met = texts.select("key", F.posexplode("bands").alias("band", "hash"))
    groups = met.groupBy("band", "hash").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    met = stored(met.join(groups, ["band", "hash"]), "met")  # only texts that share a band
    pairs = met.select(F.col("key").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "pairs")
    vecs = stored(vectors(docs, met.select("key").distinct()), "vectors")
    links = verified(pairs, vecs, idf)
    comps = components(links)
    # groups whose members are still in different components are compared whole, tile by tile
    member = stored(met.join(comps, "key", "left").select("band", "hash", "key", F.coalesce("comp", "key").alias("comp")), "members")
    split = member.groupBy("band", "hash").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 <> c1 AND size > 2").select("band", "hash", "size")
    rest = stored(member.select("band", "hash", "key", "comp").join(split, ["band", "hash"]).join(vecs.select("key", "m"), "key"), "rest")
    rest = rest.join(rest.groupBy("band", "hash").agg(F.sum("m").alias("shingles")), ["band", "hash"])
    more = stored(links_between(rest, vecs, idf).distinct(), "links")
    if not more.isEmpty():
        joined = components(more).select(F.col("key").alias("old"), F.col("comp").alias("new"))
        comps = comps.join(joined, comps["comp"] == joined["old"], "full_outer").select(F.coalesce("key", "old").alias("key"), F.coalesce("new", "comp").alias("comp"))
        comps = stored(comps, "labels")
    return rows, comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size for every row."""
    rows, comps = text_classes(docs)
    labelled = rows.select("doc_id", "key").join(comps, "key", "left").select("doc_id", F.coalesce("comp", "key").alias("comp"))
    classes = labelled.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return labelled.join(classes, "comp").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: that of its smallest doc_id (one of those rows, if repeated; null ids only if there is no other)."""
    names = docs.columns
    rows, comps = text_classes(docs)
    labelled = stored(rows.select("doc_id", "key").join(comps, "key", "left").select("doc_id", "key", F.coalesce("comp", "key").alias("comp")), "classes")
    best = stored(labelled.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")).select(F.col("m.doc_id").alias("__id"), F.col("m.key").alias("__key")), "kept")
    key = free_name(names, "text_key")
    best = best.select(F.col("__id").alias(free_name([*names, key], "kept_id")), F.col("__key").alias(free_name([*names, key], "kept_key")))
    kept = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    kept = kept.join(best, kept[key].eqNullSafe(best[best.columns[1]]) & kept["doc_id"].cast("long").eqNullSafe(best[best.columns[0]]), "left_semi")
    same = labelled.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = same.join(best, same["key"].eqNullSafe(best[best.columns[1]]) & same["doc_id"].eqNullSafe(best[best.columns[0]]), "left_semi")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
