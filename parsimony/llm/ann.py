"""Approximate nearest neighbours by multi-index hashing.

A rotation is learned on a bounded sample (SAMPLE vectors: principal axes, then iterative quantisation), and every
vector gets a 64-bit code, cut into TABLES substrings. Each stored row is the index of some thousand vectors: ids,
vectors, codes and, for each substring, the rows in order of its value. A code within radius r of a query's has a
substring within r // TABLES of the query's, so probing these buckets retrieves every code within the radius; what
they hold is filtered by Hamming distance and reranked by cosine on the original vectors in double precision.

The radius is learned on the same sample, so that a share RECALL of true neighbours lies within it; a query that
finds fewer neighbours than asked for gets a second search with the full radius. Queries are the stated set. They are
stored in blocks of QUERY_BLOCK, which each task reads one after the other for the index rows that it holds: one pass
over the index, whatever their number. Every row is indexed; no list is cut, so copies of one vector cost no more
than other rows.

Vectors that are null, zero, hold null or non-finite components, or have another length than the sample's first take
no part. Rows with the query's own vec_id are not its candidates; repeated query rows count once. Ties in score go to
the smaller vec_id. Null vec_ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, stored, stored_at, stored_rows

BITS, TABLES = 64, 8
#: Vectors from which rotation and radius are learned, and how many of them act as queries.
SAMPLE, SAMPLE_QUERIES = 8_000, 400
RECALL = 0.985
QUERY_BLOCK = 4_096
#: Vectors in one stored index row.
CHUNK = 16_384


def valid(vectors: DataFrame) -> DataFrame:
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok)


class Coder:
    """Learned rotation and radius."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = 30):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.dim = x.shape[1]
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :BITS]
        rng = np.random.default_rng(7)
        if self.dim < BITS:  # more bits than axes: random directions in the same space
            axes = np.concatenate([axes, axes @ np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0][:, np.arange(BITS - self.dim) % self.dim]], axis=1)
        p = x @ axes
        turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
            turn = (u @ vt).T
        self.rotation = axes @ turn
        self.radius = self._radius(x, k)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotation > 0, axis=1).view(np.uint64).ravel() if len(x) else np.empty(0, np.uint64)

    def _radius(self, x: np.ndarray, k: int) -> int:
        q, codes = x[:SAMPLE_QUERIES], self.codes(x)
        near = q @ x.T
        near[np.arange(len(q)), np.arange(len(q))] = -2
        top = np.argsort(-near, axis=1)[:, :k]
        far = np.bitwise_count(codes[top] ^ codes[: len(q), None])
        return int(min(BITS, np.quantile(far, RECALL) + 1)) if far.size else BITS


def learn(vectors: DataFrame, k: int) -> Coder | None:
    """From at most SAMPLE valid vectors, those with the smallest hash of vec_id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    rows = [r.embedding for r in rows if len(r.embedding) == len(rows[0].embedding)]
    return Coder(np.array(rows, np.float64), k) if rows else None


INDEX = "ids binary, vectors binary, codes binary, orders binary, begins binary"


def build_index(vectors: DataFrame, coder: Coder) -> DataFrame:
    def chunk(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        codes = coder.codes(x)
        sub = codes.view(np.uint8).reshape(-1, TABLES)
        orders = np.argsort(sub, axis=0, kind="stable").T.astype(np.int32)
        begins = np.array([np.searchsorted(sub[o, j], np.arange(257)) for j, o in enumerate(orders)], np.int32)
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (ids, x, codes, orders, begins)], names=["ids", "vectors", "codes", "orders", "begins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, n = [], [], 0
        for b in batches:
            emb = column(b, "embedding")
            fits = np.asarray(emb.value_lengths()) == coder.dim
            if not fits.all():
                b = b.filter(pa.array(fits))
                emb = column(b, "embedding")
            ids.append(np.asarray(column(b, "vec_id")))
            xs.append(np.asarray(emb.flatten()).reshape(-1, coder.dim))
            n += len(ids[-1])
            if n >= CHUNK:
                yield chunk(np.concatenate(ids), np.concatenate(xs))
                ids, xs, n = [], [], 0
        if n:
            yield chunk(np.concatenate(ids), np.concatenate(xs))

    return vectors.mapInArrow(run, INDEX)


def query_blocks(queries: DataFrame) -> str:
    """Folder of the stored blocks: ids, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                blobs = np.asarray(column(part, "vec_id")).tobytes(), np.asarray(column(part, "embedding").flatten()).astype(np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], names=["ids", "vectors"])

    return stored_at(queries.select("vec_id", "embedding").mapInArrow(run, "ids binary, vectors binary"), "ann-queries")


def search(index: DataFrame, blocks: str, coder: Coder, k: int, radius: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest for each query of the stored blocks among the codes within the radius."""
    spark = index.sparkSession
    values, read = np.arange(256, dtype=np.uint8), stored_rows(spark, blocks, ["ids", "vectors"])
    probes = [np.flatnonzero(np.bitwise_count(values ^ np.uint8(v)) <= radius // TABLES) for v in range(256)]
    shared = spark.sparkContext.broadcast(coder)
    blob = lambda b, c, kind: np.frombuffer(column(b, c)[0].as_buffer(), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for row in (b.slice(r, 1) for b in batches for r in range(b.num_rows)):
            vid, own = blob(row, "ids", np.int64), blob(row, "codes", np.uint64)
            x = blob(row, "vectors", np.float64).reshape(len(vid), -1)
            length = np.sqrt((x * x).sum(1))
            orders, begins = blob(row, "orders", np.int32).reshape(TABLES, -1), blob(row, "begins", np.int32).reshape(TABLES, 257)
            for asked in read():
                ids = blob(asked, "ids", np.int64)
                queries = blob(asked, "vectors", np.float64).reshape(len(ids), -1)
                codes, norms = coder.codes(queries), np.sqrt((queries * queries).sum(1))
                out: list[list] = [[], [], []]
                for q in range(len(ids)):
                    found = np.zeros(len(vid), bool)
                    for j, v in enumerate(codes[q : q + 1].view(np.uint8)):
                        for p in probes[v]:
                            found[orders[j, begins[j, p] : begins[j, p + 1]]] = True
                    near = np.flatnonzero(found)
                    near = near[(np.bitwise_count(own[near] ^ codes[q]) <= radius) & (vid[near] != ids[q])]
                    if not len(near):
                        continue
                    rough = (x[near] @ queries[q]) / (length[near] * norms[q])
                    if len(near) > k:
                        near = near[rough >= np.partition(rough, -k)[-k] - 1e-9]
                    score = (x[near] * queries[q]).sum(1) / (length[near] * norms[q])
                    best = np.lexsort((vid[near], -score))[:k]
                    out[0] += [ids[q]] * len(best)
                    out[1] += vid[near[best]].tolist()
                    out[2] += score[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = index.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query vector."""
    spark, ok = vectors.sparkSession, valid(vectors)
    coder = learn(ok, k)
    if coder is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = stored(build_index(ok, coder), "ann-index")
    asked = valid(queries).where(F.size("embedding") == coder.dim).dropDuplicates(["vec_id"])
    got = stored(search(index, query_blocks(asked), coder, k, coder.radius), "ann-found")
    full = got.groupBy("query_id").count().where(f"count >= {k}").select(F.col("query_id").alias("vec_id"))
    rest = stored(asked.join(full, "vec_id", "left_anti"), "ann-rest")
    if coder.radius >= BITS or rest.isEmpty():
        return got
    again = search(index, query_blocks(rest), coder, k, BITS)
    return got.join(rest.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*again.columns).unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
