"""Best-fit packing into bins of several permitted lengths.

Documents are measured in tokens; one longer than the largest length is cut into pieces of it and a rest, so that
every token is packed exactly once. Each partition packs its own pieces, longest first: a piece goes into the open bin that
it leaves with the least room; where none has room, the bin size is opened whose cost (its length and BIN_COST) is
least for the tokens that it can hold, given how many tokens in smaller pieces are still to come; at the end each bin
is downsized to the smallest permitted length that holds its contents. Nothing is shuffled; a partition is packed in
groups of at most GROUP pieces, which bounds memory and wastes at most one part-filled bin of each length a group.

`pack_documents` and `pack_texts` give each piece its place; `pack_sequences` gives the bins themselves, with their
token ids and the places where documents begin. How full the bins are depends on how the input is split: a partition of
a few documents leaves part-filled bins (0.89 of the tokens' room for 3 pieces, 0.98 for 20 and more), so small
partitions should be merged before packing.

Documents without tokens (null and empty texts) get one row, of 0 tokens in some bin. Repeated rows are packed one by
one. Pieces of equal size go in the order in which they come, and into the bin that was opened last among equally good
ones. Null doc_ids stay null. An empty table gives no bins. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, column, id_and_text
from .token_counts import counter, with_token_counts

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a bin costs besides its length, in tokens.
BIN_COST = 64
GROUP = 200_000
SCHEMA = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_length long, bin_offset long"


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the final length of each bin. No piece may be longer than the largest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = [0] * (lengths[-1] + 1)  # pieces still to come, by size
    for s in sizes:
        left[s] += 1
    to_come = _Sums(left)
    where, offset = [0] * len(sizes), [0] * len(sizes)
    room: list[int] = []  # of each bin
    length: list[int] = []
    open_bins: dict[int, list[int]] = {}  # by room
    rooms = 0  # bit r: some bin has room r
    for i in order:
        s = sizes[i]
        to_come.take(s)
        if above := rooms >> s:
            r = s + (above & -above).bit_length() - 1
            bins = open_bins[r]
            b = bins.pop()
            if not bins:
                rooms &= ~(1 << r)
        else:
            best = None
            for c in lengths:
                if c >= s:
                    held = s + min(c - s, to_come.upto(c - s))
                    price = (c + bin_cost) / max(held, 1)
                    if best is None or price < best[0]:
                        best = (price, c)
            b = len(room)
            length.append(best[1])
            room.append(best[1])
        where[i], offset[i] = b, length[b] - room[b]
        room[b] -= s
        open_bins.setdefault(room[b], []).append(b)
        rooms |= 1 << room[b]
    final = [next(c for c in lengths if c >= length[b] - room[b]) for b in range(len(room))]
    return where, offset, final


class _Sums:
    """Tokens in pieces up to a size, under removals: a Fenwick tree."""

    def __init__(self, counts: list[int]):
        self.n = len(counts)
        self.tree = [0] * (self.n + 1)
        for s, k in enumerate(counts):
            self._add(s, s * k)

    def _add(self, s: int, x: int) -> None:
        i = s + 1
        while i <= self.n:
            self.tree[i] += x
            i += i & -i

    def take(self, s: int) -> None:
        self._add(s, -s)

    def upto(self, s: int) -> int:
        i, x = s + 1, 0
        while i:
            x += self.tree[i]
            i &= i - 1
        return x


def pack_documents(counted: DataFrame, lengths: Sequence[int] = LENGTHS, bin_cost: int = BIN_COST) -> DataFrame:
    """A row for each piece of each document of counted (doc_id, n_tokens): its bin, place there and the bin's length."""
    lengths = tuple(sorted(lengths))
    most = lengths[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []

        def done() -> pa.RecordBatch:
            nonlocal base
            where, offset, final = pack([p[3] for p in pieces], lengths, bin_cost)
            cols = [[p[j] for p in pieces] for j in range(4)] + [[base + b for b in where], [final[b] for b in where], offset]
            base += len(final)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_offset"])

        for b in batches:
            for doc_id, n in zip(column(b, "doc_id").to_pylist(), column(b, "n_tokens").to_pylist(), strict=True):
                n = n or 0
                for k, at in enumerate(range(0, max(n, 1), most)):
                    pieces.append((doc_id, k, at, min(most, n - at)))
                    if len(pieces) == GROUP:
                        yield done()
                        pieces = []
        if pieces:
            yield done()

    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens")).mapInArrow(run, SCHEMA)


def pack_texts(docs: DataFrame, lengths: Sequence[int] = LENGTHS, path: str | None = None) -> DataFrame:
    return pack_documents(with_token_counts(id_and_text(docs), path=path).select("doc_id", "n_tokens"), lengths)


SEQUENCES = "bin_id long, bin_length long, n_tokens long, doc_ids array<long>, starts array<int>, tokens array<int>"
#: Tokens that a task packs at once into sequences.
GROUP_TOKENS = 2_000_000


def pack_sequences(docs: DataFrame, lengths: Sequence[int] = LENGTHS, bin_cost: int = BIN_COST, path: str | None = None) -> DataFrame:
    """A row for each bin: its length, token ids end to end, and for each piece in it the document and where it begins. Documents without tokens are in no bin."""
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    rows = id_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = counter(path).sp
        base = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []
        held = 0

        def done() -> pa.RecordBatch:
            nonlocal base, held
            where, offset, final = pack([len(p[1]) for p in pieces], lengths, bin_cost)
            bins: list[list] = [[] for _ in final]
            for (doc_id, ids), b, at in zip(pieces, where, offset, strict=True):
                bins[b].append((at, doc_id, ids))
            for b in bins:
                b.sort(key=lambda p: p[0])
            cols = [[base + k for k in range(len(bins))], final, [sum(len(p[2]) for p in b) for b in bins], [[p[1] for p in b] for b in bins], [[p[0] for p in b] for b in bins], [[t for p in b for t in p[2]] for b in bins]]
            base, held = base + len(bins), 0
            pieces.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bin_id", "bin_length", "n_tokens", "doc_ids", "starts", "tokens"])

        for b in blocks(batches):
            for doc_id, ids in zip(column(b, "doc_id").to_pylist(), sp.encode(column(b, "text").to_pylist(), num_threads=1), strict=True):
                pieces += [(doc_id, ids[a : a + most]) for a in range(0, len(ids), most)]
                held += len(ids)
            if held >= GROUP_TOKENS:
                yield done()
        if pieces:
            yield done()

    return rows.mapInArrow(run, SEQUENCES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
