"""Exact removal of repeated 100-byte strings by suffix arrays.

Every byte goes that is covered by a string of LENGTH bytes which also starts earlier (in a smaller doc_id, or before
it in the same document). Documents are stored in compressed blocks. Each LENGTH-byte window is filed under the least
hash of the GRAM-byte strings in it; windows in a row under one hash make a segment, so equal windows always meet under
one hash. Hashes that occur once in the corpus are dropped by an exchange of their counts. Of equal segments (by 128-bit
digests) an exchange finds the first in the corpus; all windows of the others start earlier there, so they are
removed whole and travel no further, however many copies there are.

The different segments that are left are dealt out by their hash. Each bucket takes them some hashes at a time, builds
their suffix array by two-stage sorting (suffixes smaller than their successors are sorted directly, the others
induced by scanning the buckets of first bytes), computes adjacent common prefixes, and marks every window but
the earliest of each run that shares LENGTH bytes. A hash under which more than HOT different segments lie (a passage in
ever new surroundings) would make one bucket grow with the corpus: its segments are split into their windows, which are
dealt out by digests of the whole window, where nothing but the first place in the corpus is left to be found.

Null texts are empty. Order among rows with equal doc_id (repeated rows) is that of their blocks; a null doc_id comes
first. Other columns are not read, whatever their names. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, column, drop_stored, id_and_text, mix, text_buffer
from .common import written as stored
from .exchange import FIRSTS, bucket_bits, by_block, firsts, joined, totals

LENGTH, GRAM = 100, 40
#: Text bytes of a stored block, and of different segments that a bucket should hold and that are sorted at once.
BLOCK, BUCKET, AT_ONCE = 1 << 20, 4 << 20, 1 << 20
#: Different segments of one hash up to which they are sorted together; beyond it they go window by window.
HOT = 4096
_B = 0x9E3779B97F4A7C15


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    power = lambda k: np.uint64(pow(_B, k, 1 << 64))
    h = {1: raw.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8, 16):
        h[2 * k] = h[k][: len(h[k]) - k] * power(k) + h[k][k:]
        if k != 8:
            del h[k]
    return mix(h[32][: len(raw) - GRAM + 1] * power(8) + h[8][32 : 32 + len(raw) - GRAM + 1])


def _sliding(x: np.ndarray, best) -> np.ndarray:
    """best over each LENGTH - GRAM + 1 values in a row."""
    span, k, n = LENGTH - GRAM + 1, 1, len(x) - LENGTH + GRAM
    while 2 * k <= span:
        x = best(x[: len(x) - k], x[k:])
        k *= 2
    return best(x[:n], x[span - k : span - k + n])


def _spread(least: np.ndarray) -> np.ndarray:
    """Least hashes, which are all small numbers, spread over all numbers, as they are dealt out by leading bits."""
    return mix(least ^ np.uint64(_B))


def window_hashes(raw: np.ndarray) -> np.ndarray:
    """For each start of LENGTH bytes, the least hash of the GRAM-byte strings in it."""
    return _spread(_sliding(_gram_hashes(raw), np.minimum)) if len(raw) >= LENGTH else np.empty(0, np.uint64)


def chosen_grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings that are least in some window, one for each place; a string that repeats inside a window counts twice."""
    if len(raw) < LENGTH:
        return np.empty(0, np.uint64)
    g, edge = _gram_hashes(raw), np.zeros(LENGTH - GRAM, np.uint64)
    return _spread(g[g == _sliding(np.concatenate([edge, _sliding(g, np.minimum), edge]), np.maximum)])


def segments(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first start (in the row) and number of starts of each segment of the texts in a block."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i in range(len(off) - 1):
        m = window_hashes(raw[off[i] : off[i + 1]])
        if len(m):
            at = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            for o, x in zip(out, (m[at], np.full(len(at), i), at, np.diff(np.append(at, len(m)))), strict=True):
                o.append(x)
    return tuple(np.concatenate(o) if o else np.empty(0, t) for o, t in zip(out, (np.uint64, np.int64, np.int64, np.int64), strict=True))


def block_table(docs: DataFrame) -> DataFrame:
    """Stored blocks: block_id, doc_ids, offsets, text (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, z = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=3)
        for b in blocks(batches, BLOCK):
            raw, off = text_buffer(column(b, "text"))
            yield pa.RecordBatch.from_arrays([pa.array([part + k], pa.int64()), pa.array([column(b, "doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([off.tobytes()], pa.binary()), pa.array([z.compress(raw.tobytes())], pa.binary()), pa.array([len(raw)], pa.int64())], names=["block_id", "doc_ids", "offsets", "text", "n_bytes"])
            k += 1

    return stored(id_and_text(docs), "blocks", run, "block_id long, doc_ids array<long>, offsets binary, text binary, n_bytes long")


def _opened(b: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column(b, "offsets")[r].as_buffer(), np.int64)
    raw = zstandard.ZstdDecompressor().decompress(column(b, "text")[r].as_buffer(), max_output_size=int(off[-1]) + 1) if off[-1] else b""
    return np.frombuffer(raw, np.uint8), off


def hash_counts(table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                raw, off = _opened(b, r)
                keys, counts = np.unique(np.concatenate([chosen_grams(raw[off[i] : off[i + 1]]) for i in range(len(off) - 1)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([column(b, "block_id").slice(r, 1), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary())], names=["block_id", "keys", "counts"])

    return table.select("block_id", "offsets", "text").mapInArrow(run, "block_id long, keys binary, counts binary")


CUT = "block_id long, doc_ids array<long>, offsets binary, text binary, hashes binary, places binary, k1 binary, k2 binary, firsts binary, n_keys long"


def _digests(raw: bytes, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of slices, as two numbers each."""
    got = b"".join(xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(at.tolist(), end.tolist(), strict=True))
    both = np.frombuffer(got, ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _firsts_of(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least place of each distinct key, in order of the keys, and each entry's key as a number."""
    order = np.lexsort((start, row, doc, k2, k1))
    new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])) if len(order) else np.empty(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _ids(b: pa.RecordBatch, r: int) -> np.ndarray:
    return np.array([-(2**63) if x is None else x for x in column(b, "doc_ids")[r].as_py()], np.int64)


def cut_blocks(table: DataFrame, found: DataFrame) -> DataFrame:
    """Stored blocks with their segments under hashes that occur more than once (hash, places, number of the distinct segment) and the digests of the distinct ones, with the first place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for r in range(b.num_rows):
                raw, off = _opened(b, r)
                h, row, start, n = segments(raw, off)
                many = joined(column(b, "parts")[r]) > 1
                keep = many[np.searchsorted(np.unique(h), h)] if len(h) else np.empty(0, bool)
                h, row, start, n = h[keep], row[keep], start[keep], n[keep]
                at = off[row] + start
                k1, k2 = _digests(raw.tobytes(), at, at + n + LENGTH - 1)
                first, of = _firsts_of(k1, k2, _ids(b, r)[row], row, start)
                places = z.compress(np.stack([row, start, n, of]).astype(np.int32).tobytes())
                least = z.compress(first.astype(np.int32).tobytes())
                blobs = (h.tobytes(), places, k1[first].tobytes(), k2[first].tobytes(), least)
                yield pa.RecordBatch.from_arrays(
                    [column(b, c).slice(r, 1) for c in ("block_id", "doc_ids", "offsets", "text")] + [pa.array([x], pa.binary()) for x in blobs] + [pa.array([len(first)], pa.int64())],
                    names=["block_id", "doc_ids", "offsets", "text", "hashes", "places", "k1", "k2", "firsts", "n_keys"],
                )

    return stored(table.join(by_block(found), "block_id", "left"), "cut", run, CUT)


class _Cut:
    """A block's segments: hash, row, start, windows, number of the distinct segment; of the distinct ones the first place."""

    def __init__(self, b: pa.RecordBatch, r: int):
        unpack = lambda c: np.frombuffer(zstandard.ZstdDecompressor().decompress(column(b, c)[r].as_buffer(), max_output_size=1 << 31), np.int32)
        self.h = np.frombuffer(column(b, "hashes")[r].as_buffer(), np.uint64)
        self.row, self.start, self.n, self.of = unpack("places").reshape(4, -1).astype(np.int64)
        self.first = unpack("firsts").astype(np.int64)
        self.own = joined(column(b, "flags")[r]) > 0 if "flags" in b.schema.names else None


def key_places(cut: DataFrame) -> DataFrame:
    """The distinct segments of each block for the exchange of first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                s = _Cut(b, r)
                blobs = (_ids(b, r)[s.row[s.first]], s.row[s.first].astype(np.int32), s.start[s.first].astype(np.int32))
                yield pa.RecordBatch.from_arrays([column(b, c).slice(r, 1) for c in ("block_id", "k1", "k2")] + [pa.array([x.tobytes()], pa.binary()) for x in blobs], names=["block_id", "k1", "k2", "doc_ids", "rows", "starts"])

    return cut.select("block_id", "doc_ids", "hashes", "places", "firsts", "k1", "k2").mapInArrow(run, FIRSTS)


def flagged(cut: DataFrame, own: DataFrame, *names: str) -> DataFrame:
    """Columns of the cut blocks, with flags: which of a block's distinct segments are the first in the corpus."""
    return cut.select("block_id", "hashes", "places", "firsts", *names).join(by_block(own).withColumnRenamed("parts", "flags"), "block_id", "left")


def different_counts(cut: DataFrame, own: DataFrame) -> DataFrame:
    """Each block's hashes with the number of different segments under them that come first there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                s = _Cut(b, r)
                keys, counts = np.unique(s.h[s.first[s.own]], return_counts=True)
                yield pa.RecordBatch.from_arrays([column(b, "block_id").slice(r, 1), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary())], names=["block_id", "keys", "counts"])

    return flagged(cut, own).mapInArrow(run, "block_id long, keys binary, counts binary")


SEGMENTS = "bucket int, block_id long, hashes binary, lens binary, doc_ids binary, rows binary, starts binary, data binary"


def dealt_segments(cut: DataFrame, own: DataFrame, different: DataFrame, n_buckets: int) -> DataFrame:
    """Stored different segments to be sorted, by bucket of their hash; those under a hash with more than HOT of them in bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                s = _Cut(b, r)
                mine = s.first[s.own]
                if not len(mine):
                    continue
                raw, off = _opened(b, r)
                h, row, start, n, ids = s.h[mine], s.row[mine], s.start[mine], s.n[mine], _ids(b, r)
                others = joined(column(b, "parts")[r])[np.searchsorted(np.unique(h), h)]
                # a segment alone under its hash matters only if its hash stands in it more than once
                more = others > 1
                alone = np.flatnonzero(~more)
                more[alone] = [_twice(raw[a : a + k], x) for a, k, x in zip((off[row[alone]] + start[alone]).tolist(), (n[alone] + LENGTH - 1).tolist(), h[alone], strict=True)]
                bucket = np.where(others > HOT, -1, (h % np.uint64(n_buckets)).astype(np.int64))
                order = np.flatnonzero(more)
                order = order[np.argsort(bucket[order], kind="stable")]
                if not len(order):
                    continue
                cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
                text, at, lens = raw.tobytes(), off[row] + start, n + LENGTH - 1
                groups = np.split(order, cuts[1:])
                data = [b"".join(text[a : a + k] for a, k in zip(at[g].tolist(), lens[g].tolist(), strict=True)) for g in groups]
                blob = lambda x, t: pa.array([x[g].astype(t).tobytes() for g in groups], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order[cuts]], pa.int32()), pa.array([column(b, "block_id")[r].as_py()] * len(groups), pa.int64()), blob(h, np.uint64), blob(lens, np.int32), blob(ids[row], np.int64), blob(row, np.int32), blob(start, np.int32), pa.array(data, pa.binary())],
                    names=["bucket", "block_id", "hashes", "lens", "doc_ids", "rows", "starts", "data"],
                )

    return stored(flagged(cut, own, "doc_ids", "offsets", "text").join(by_block(different), "block_id"), "segments", run, SEGMENTS)


def _twice(raw: np.ndarray, h: np.uint64) -> bool:
    """Whether a GRAM-byte string with this hash stands more than once in raw."""
    return len(raw) > LENGTH and int((_spread(_gram_hashes(raw)) == h).sum()) > 1


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions in order of their suffixes' first `depth` symbols. text: small integers, the last one the least of all.

    Two stages: suffixes smaller than their successors are sorted directly; then, scanning the buckets of first
    symbols upwards, each entry puts the suffix one place before it, if that is larger than its successor, next in its own bucket.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    differs = np.append(text[1:] != text[:-1], True)
    nxt = np.flatnonzero(differs)[np.cumsum(np.append(0, differs[:-1]))]  # where the run of equal symbols ends
    small = np.append(text[1:], -1)[nxt] > text  # smaller than the successor
    small[-1] = True
    direct = _sorted_directly(text, np.flatnonzero(small), depth)
    first = text[direct]
    size = int(text.max()) + 1
    b_end = np.searchsorted(first, np.arange(size), "right")
    b_at = np.searchsorted(first, np.arange(size), "left")
    coming: list[list[np.ndarray]] = [[] for _ in range(size)]  # induced entries, in order
    out = []
    for c in range(size):
        level = np.concatenate(coming[c]) if coming[c] else np.empty(0, np.int64)
        larger = [level]
        while len(level):  # runs of c: each induces the suffix one place earlier in the same bucket
            prev = level[level > 0] - 1
            level = prev[(text[prev] == c) & ~small[prev]]
            larger.append(level)
        bucket = np.concatenate([*larger, direct[b_at[c] : b_end[c]]])
        out.append(bucket)
        prev = bucket[bucket > 0] - 1
        prev = prev[(text[prev] > c) & ~small[prev]]
        if len(prev):
            by = text[prev]
            order = np.argsort(by, kind="stable")
            prev, by = prev[order], by[order]
            at = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
            for k, part in zip(by[at].tolist(), np.split(prev, at[1:]), strict=True):
                coming[k].append(part)
    return np.concatenate(out)


def _words(text: np.ndarray) -> np.ndarray:
    """At each position the next 7 symbols (of 9 bits) as one number, in their order."""
    pad = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    out = np.zeros(len(text), np.uint64)
    for j in range(7):
        out = (out << np.uint64(9)) | pad[j : j + len(text)]
    return out


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    words = _words(text)
    word = lambda p: words[np.minimum(p, len(words) - 1)] * (p < len(words))
    key = word(at)
    order = np.argsort(key)
    at, key = at[order], key[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1]))  # ties share a number
    for d in range(7, depth, 7):
        tied = np.flatnonzero(np.append(group[1:] == group[:-1], False) | np.append(False, group[1:] == group[:-1]))
        if not len(tied):
            break
        g, key = group[tied], word(at[tied] + d)
        order = np.lexsort((key, g))
        at[tied], key = at[tied][order], key[order]
        fresh = np.append(False, (g[1:] == g[:-1]) & (key[1:] != key[:-1]))
        # groups get numbers anew: each place where a key differs inside a group begins another one
        starts = np.append(True, group[1:] != group[:-1])
        starts[tied] |= fresh
        group = np.cumsum(starts)
    return at


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, at most `most`, of each suffix and the one before it; 0 for the first."""
    words, lcp = _words(text), np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    d = 0
    while len(live) and d < most:
        a, b = sa[live] + d, sa[live - 1] + d
        inside = (a < len(text)) & (b < len(text))
        x = words[np.minimum(a, len(text) - 1)] ^ words[np.minimum(b, len(text) - 1)]
        high = x >> np.uint64(32)
        bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
        same = (63 - bits) // 9
        lcp[live] += np.where(inside, same, 0)
        live = live[inside & (same == 7)]
        d += 7
    return np.minimum(lcp, most)


def marked_windows(data: np.ndarray, lens: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of each window of `length` bytes that also starts earlier. data: the strings end to end; rank: their order, of different numbers."""
    begins = np.concatenate([[0], np.cumsum(lens + 1)])
    text = np.zeros(int(begins[-1]), np.int16)
    within = np.ones(len(text), bool)
    within[begins[1:] - 1] = False
    text[within] = data
    text[within] += 1
    sa = suffix_array(text, length)
    of = np.repeat(np.arange(len(lens)), lens + 1)[sa]
    # only suffixes that hold a whole window matter; shorter ones differ from these within it, so equal windows stay adjacent
    whole = begins[of] + lens[of] - sa >= length
    sa, of = sa[whole], of[whole]
    lcp = common_prefixes(text, sa, length)
    run = np.flatnonzero(np.append(True, lcp[1:] < length)) if len(sa) else np.empty(0, np.int64)
    order = rank[of] * (int(lens.max(initial=0)) + 1) + sa - begins[of]
    if len(sa):
        least = np.repeat(np.minimum.reduceat(order, run), np.diff(np.append(run, len(sa))))
        sa, of = sa[order != least], of[order != least]
    by = np.lexsort((sa, of))
    return of[by], sa[by] - begins[of[by]]


def _triples(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Starts of windows, ascending by row and start, as (row, first, last + 1) of those in a row."""
    if not len(row):
        return np.empty((0, 3), np.int64)
    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
    return np.stack([row[at], start[at], start[np.append(at[1:], len(row)) - 1] + 1], axis=1)


def marks(dealt: DataFrame) -> DataFrame:
    """block_id and triples (row, first and last start + 1) of windows that start earlier in another segment or in the same one."""

    def run(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("hashes", "lens", "doc_ids", "rows", "starts", "data"), (np.uint64, np.int32, np.int64, np.int32, np.int32, np.uint8)
        parts: list[list[np.ndarray]] = [[] for _ in names]
        ids = []
        for b in group:
            ids += column(b, "block_id").to_pylist()
            for part, c, k in zip(parts, names, kinds, strict=True):
                part += [np.frombuffer(x.as_buffer(), k) for x in column(b, c)]
        block = np.repeat(np.array(ids, np.int64), [len(p) for p in parts[0]])
        h, lens, doc, row, start, data = (np.concatenate(p) for p in parts)
        del parts
        begins = np.cumsum(lens, dtype=np.int64) - lens
        order = np.lexsort((start, row, block, doc))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        by = np.argsort(h, kind="stable")
        size = np.cumsum(lens[by], dtype=np.int64)
        edges = np.append(np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1])), len(h))  # a hash is sorted whole
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(size[edges[1:] - 1], (size[edges[at] - 1] if edges[at] else 0) + AT_ONCE, "right")))
            some = by[edges[at] : edges[to]]
            at = to
            n = lens[some].astype(np.int64)
            take = np.repeat(begins[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of, offset = marked_windows(data[take], n, rank[some])
            if not len(of):
                continue
            of = some[of]
            found = np.stack([block[of], row[of], start[of] + offset])
            found = found[:, np.lexsort(found[::-1])]
            cuts = np.flatnonzero(np.append(True, found[0, 1:] != found[0, :-1]))
            blobs = [_triples(x[1], x[2]).astype(np.int32).tobytes() for x in np.split(found, cuts[1:], axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(found[0, cuts], pa.int64()), pa.array(blobs, pa.binary())], names=["block_id", "marks"])

    return dealt.groupBy("bucket").applyInArrow(run, "block_id long, marks binary")


class _Windows:
    """All windows of the segments in a dealt row: digests, places, and the least place of each different window."""

    def __init__(self, b: pa.RecordBatch, r: int):
        get = lambda c, k: np.frombuffer(column(b, c)[r].as_buffer(), k)
        lens = get("lens", np.int32).astype(np.int64)
        n = lens - LENGTH + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(lens) - lens, n) + step
        self.doc, self.row = np.repeat(get("doc_ids", np.int64), n), np.repeat(get("rows", np.int32), n)
        self.start = np.repeat(get("starts", np.int32), n) + step.astype(np.int32)
        self.k1, self.k2 = _digests(column(b, "data")[r].as_py(), at, at + LENGTH)
        self.first, self.of = _firsts_of(self.k1, self.k2, self.doc, self.row, self.start)


def window_marks(hot: DataFrame) -> DataFrame:
    """As marks, of stored segments under hashes with very many different ones: each window against its first place."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                w = _Windows(b, r)
                blobs = (w.k1[w.first], w.k2[w.first], w.doc[w.first], w.row[w.first], w.start[w.first])
                yield pa.RecordBatch.from_arrays([column(b, "block_id").slice(r, 1), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["block_id", "k1", "k2", "doc_ids", "rows", "starts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                w = _Windows(b, r)
                own = joined(column(b, "flags")[r]) > 0
                gone = ~own[w.of]
                gone[np.setdiff1d(np.arange(len(w.of)), w.first)] = True
                row, start = w.row[gone].astype(np.int64), w.start[gone].astype(np.int64)
                order = np.lexsort((start, row))
                yield pa.RecordBatch.from_arrays([column(b, "block_id").slice(r, 1), pa.array([_triples(row[order], start[order]).astype(np.int32).tobytes()], pa.binary())], names=["block_id", "marks"])

    n = hot.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    own = stored(firsts(hot.mapInArrow(ask, FIRSTS), bucket_bits(n / 2)), "window-firsts")
    return hot.join(by_block(own).withColumnRenamed("parts", "flags"), "block_id").mapInArrow(answer, "block_id long, marks binary")


def removed(cut: DataFrame, own: DataFrame, found: DataFrame) -> DataFrame:
    by = found.groupBy("block_id").agg(F.collect_list("marks").alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                s = _Cut(b, r)
                raw, off = _opened(b, r)
                whole = np.ones(len(s.h), bool)
                whole[s.first[s.own]] = False  # the first of its kind in the corpus stays but for its marks
                m = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x, np.int32) for x in column(b, "marks")[r].as_py() or [])]).astype(np.int64).reshape(-1, 3)
                m = np.concatenate([m, np.stack([s.row, s.start, s.start + s.n], axis=1)[whole]])
                edge = np.zeros(int(off[-1]) + 1, np.int32)
                np.add.at(edge, off[m[:, 0]] + m[:, 1], 1)
                np.add.at(edge, off[m[:, 0]] + m[:, 2] + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                rows: list[list] = [[], [], [], []]
                for i in range(len(off) - 1):
                    g, x = gone[off[i] : off[i + 1]], raw[off[i] : off[i + 1]]
                    spans = int((g & ~np.append(False, g[:-1])).sum()) if len(g) else 0
                    for o, v in zip(rows, (len(x), int(g.sum()), spans, hashlib.sha256((x[~g] if spans else x).tobytes()).hexdigest()), strict=True):
                        o.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_ids")[r].as_py(), pa.int64()), *(pa.array(o, t) for o, t in zip(rows, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return flagged(cut, own, "doc_ids", "offsets", "text").join(by, "block_id", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    table = block_table(docs)
    size = table.agg(F.sum("n_bytes")).first()[0] or 0
    found = stored(totals(hash_counts(table), bucket_bits(size / 30)), "hash-totals")
    cut = cut_blocks(table, found)
    drop_stored(table, found)
    keys = cut.agg(F.sum("n_keys")).first()[0] or 0
    own = stored(firsts(key_places(cut), bucket_bits(2 * keys)), "firsts")
    different = stored(totals(different_counts(cut, own), bucket_bits(keys)), "different")
    dealt = dealt_segments(cut, own, different, max(16, int(150 * keys / BUCKET)))
    drop_stored(different)
    found = stored(marks(dealt.where("bucket >= 0")), "marks")
    hot = dealt.where("bucket < 0")
    if not hot.isEmpty():
        found = found.union(stored(window_marks(hot), "marks"))
    drop_stored(dealt)
    return removed(cut, own, found)


#: Windows as 200 hexadecimal digits, cut from chunks of 1000 bytes so that no window is sought from a long text's beginning.
ORACLE = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), c AS (SELECT doc_id, k * 1000 AS base, substr(x, CAST(k * 2000 + 1 AS BIGINT), 2198) AS x FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) // 2000 + 1 AS BIGINT))) AS k FROM t)
), w AS (SELECT doc_id, base + i AS pos, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 200)) AS h FROM (SELECT doc_id, base, x, unnest(range(0, least(1000, length(x) // 2 - 99))) AS i FROM c WHERE length(x) >= 200)
), firsts AS (SELECT h, min({'d': doc_id, 'p': pos}) AS f FROM w GROUP BY h HAVING count(*) > 1
), gone AS (SELECT doc_id, pos, CASE WHEN pos > (lag(pos) OVER o) + 100 THEN 1 ELSE 0 END AS new FROM w JOIN firsts USING (h) WHERE f.d <> doc_id OR f.p <> pos WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), runs AS (SELECT doc_id, n, min(pos) AS a, max(pos) + 100 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM gone) GROUP BY doc_id, n
), held AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, list({'a': a, 'z': z} ORDER BY a) AS r FROM runs GROUP BY doc_id)
SELECT t.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN r IS NULL THEN x ELSE array_to_string(list_transform(r, lambda q, i: substr(x, CAST(2 * CASE WHEN i = 1 THEN 0 ELSE r[i - 1].z END + 1 AS BIGINT), CAST(2 * (q.a - CASE WHEN i = 1 THEN 0 ELSE r[i - 1].z END) AS BIGINT))), '') || substr(x, CAST(2 * r[-1].z + 1 AS BIGINT)) END)) AS kept_sha256
FROM t LEFT JOIN held USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
