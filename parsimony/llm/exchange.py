"""Corpus-wide totals and first holders of hashed keys, brought back to the blocks that asked.

Each block of documents gives its distinct 64-bit keys in ascending order with counts. They are dealt out by their
leading bits as one binary row for each block and bucket, added up in each bucket, and go back the same way. A key that
every document holds is one entry for each block, so no bucket grows hot; Spark moves a few large rows, not one for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: Keys that a bucket should hold about.
BUCKET_KEYS = 1 << 18


def bucket_bits(keys: float) -> int:
    return max(4, int(np.ceil(np.log2(max(1.0, keys / BUCKET_KEYS)))))


def totals(blocks: DataFrame, bits: int) -> DataFrame:
    """blocks: block_id, keys, counts (uint64 ascending and uint32, as binary). Gives block_id, bucket, totals (uint64, in order of the keys), and one row a bucket with block_id null and n, v: sum and number of keys with a total."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for b in batches:
            for r in range(b.num_rows):
                keys, counts = (np.frombuffer(column(b, c)[r].as_buffer(), k) for c, k in (("keys", np.uint64), ("counts", np.uint32)))
                at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                used = np.flatnonzero(at[1:] > at[:-1])
                block = column(b, "block_id")[r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array([keys[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()), pa.array([counts[at[i] : at[i + 1]].tobytes() for i in used], pa.binary())],
                    names=["bucket", "block_id", "keys", "counts"],
                )

    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, counts = [], [], []
        for b in group:
            for i, k, c in zip(column(b, "block_id").to_pylist(), column(b, "keys"), column(b, "counts"), strict=True):
                ids.append(i)
                parts.append(np.frombuffer(k.as_buffer(), np.uint64))
                counts.append(np.frombuffer(c.as_buffer(), np.uint32))
        keys = np.concatenate(parts)
        order = np.argsort(keys)
        keys = keys[order]
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.uint64), begins)
        out = np.empty(len(keys), np.uint64)
        out[order] = np.repeat(sums, np.diff(np.append(begins, len(keys))))
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        blobs = [x.tobytes() for x in np.split(out, cuts)]
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*ids, None], pa.int64()), pa.array([key[0].as_py()] * (n + 1), pa.int32()), pa.array([*blobs, None], pa.binary()), pa.array([None] * n + [int(sums.sum())], pa.int64()), pa.array([None] * n + [int((sums > 0).sum())], pa.int64())],
            names=["block_id", "bucket", "totals", "n", "v"],
        )

    dealt = blocks.select("block_id", "keys", "counts").mapInArrow(deal, "bucket int, block_id long, keys binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(add, "block_id long, bucket int, totals binary, n long, v long")


def by_block(found: DataFrame) -> DataFrame:
    """block_id and parts: the totals of its keys in order of the buckets."""
    parts = found.where("block_id is not null").groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias("p"))
    return parts.select("block_id", F.col("p.totals").alias("parts"))


def joined(parts: pa.Scalar) -> np.ndarray:
    got = [np.frombuffer(p, np.uint64) for p in parts.as_py() or []]
    return np.concatenate(got) if got else np.empty(0, np.uint64)


FIRSTS = "block_id long, k1 binary, k2 binary, doc_ids binary, rows binary, starts binary"


def firsts(blocks: DataFrame, bits: int) -> DataFrame:
    """blocks (FIRSTS): each block's distinct keys of 128 bits (k1 ascending), and the least place of each in the block:
    doc_id, row, start (int64, int32, int32). Gives block_id, bucket and totals (uint64, in order of the keys): 1 where
    the block holds the key's first place in the corpus, by doc_id, block, row and start, and else 0.
    """
    names, kinds = ("k1", "k2", "doc_ids", "rows", "starts"), (np.uint64, np.uint64, np.int64, np.int32, np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for b in batches:
            for r in range(b.num_rows):
                cols = [np.frombuffer(column(b, c)[r].as_buffer(), k) for c, k in zip(names, kinds, strict=True)]
                at = np.concatenate([[0], np.searchsorted(cols[0], edges), [len(cols[0])]])
                used = np.flatnonzero(at[1:] > at[:-1])
                block = column(b, "block_id")[r].as_py()
                blobs = [pa.array([c[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), *blobs], names=["bucket", "block_id", *names])

    def first(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], [[] for _ in names]
        for b in group:
            ids += column(b, "block_id").to_pylist()
            for part, c, k in zip(parts, names, kinds, strict=True):
                part += [np.frombuffer(x.as_buffer(), k) for x in column(b, c)]
        lens = [len(p) for p in parts[0]]
        k1, k2, doc, row, start = (np.concatenate(p) for p in parts)
        block = np.repeat(np.array(ids, np.int64), lens)
        order = np.lexsort((start, row, block, doc, k2, k1))
        same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
        out = np.zeros(len(order), np.uint64)
        out[order[np.flatnonzero(np.append(True, ~same))]] = 1
        blobs = [x.tobytes() for x in np.split(out, np.cumsum(lens)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([key[0].as_py()] * len(ids), pa.int32()), pa.array(blobs, pa.binary())], names=["block_id", "bucket", "totals"])

    dealt = blocks.mapInArrow(deal, "bucket int, block_id long, k1 binary, k2 binary, doc_ids binary, rows binary, starts binary")
    return dealt.groupBy("bucket").applyInArrow(first, "block_id long, bucket int, totals binary")
