"""WARC archives: a writer with one gzip member per record, and a splittable reader.

The writer gives each distinct payload one response record (that of the largest page_id) and a revisit record to
every other page with an equal payload. The reader's tasks each take a byte range of an archive: they scan it for
the gzip magic, take a place for a member only if it decodes to a WARC header, own the records that start inside
their range and read beyond its end to finish the last one. Headers may have any length. Payload digests are computed
anew when read.

A payload may itself hold WARC members, which a task that begins inside that record would take for the archive's own.
So a range keeps only members that follow each other without a gap up to its end, and reports where its first one
begins and its last one ends; an archive counts as read if every range begins where the one before it ended and the
records are as many as the manifest says. Any other archive is read once more from its beginning, member by member,
where no such mistake can happen; if the number still differs, the job fails instead of losing records.

Archives lie in the shared folder; only those in the manifest count, so a task that runs twice leaves no records
behind. Null html is an empty payload; null page_ids sort before all others and give null refers_to; of repeated
rows with equal payload and the largest page_id one is the response. Other columns than page_id, url and html are
not read. Control characters of a url are left out of its record. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, new_folder, stored

#: Rows of the table of repeated payloads up to which it is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """A row for each record: page_id, url, html (null for revisits), n_bytes, digest (hex), revisit, refers_to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("key", F.struct("page_id", "url"))
    tops = stored(p.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("key").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top"), "payloads")
    tops = F.broadcast(tops) if tops.count() <= BROADCAST_ROWS else tops
    j = p.join(tops, "digest", "left")
    is_top = F.col("key") == F.col("top")
    # row by row: pages alone in their payload, and revisits, which need no payload
    plain = j.where(F.col("top").isNull() | ~is_top).select("page_id", "url", F.when(F.col("top").isNull(), F.col("html")).alias("html"), "n_bytes", "digest", F.col("top").isNotNull().alias("revisit"), F.col("top.page_id").alias("refers_to"))
    first = j.where(is_top).groupBy("digest", "page_id", "url").agg(F.first("html").alias("html"), F.first("n_bytes").alias("n_bytes"), F.count("*").cast("int").alias("n"))
    first = first.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    first = first.select("page_id", "url", F.when(F.col("i") == 1, F.col("html")).alias("html"), "n_bytes", "digest", (F.col("i") > 1).alias("revisit"), F.when(F.col("i") > 1, F.col("page_id")).alias("refers_to"))
    return plain.unionByName(first)


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def _clean(url: str) -> str:
    return "".join(c for c in url if c >= " " and c != "\x7f")


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, html: bytes | None, n_bytes: int, digest_hex: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member; html None makes it a revisit."""
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    head = [("WARC-Type", "response" if html is not None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(n_bytes))]
    if html is None:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _member([*head, ("Content-Type", "application/http; msgtype=response")], _HTTP + (html or b""))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records into archives of about ARCHIVE_BYTES and gives the stored manifest: path, n_bytes, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        made, out, name, size, n = [], None, "", 0, 0
        for b in batches:
            cols = [column(b, c).to_pylist() for c in ("page_id", "url", "html", "n_bytes", "digest", "refers_to")]
            for page_id, url, html, n_bytes, digest, refers_to in zip(*cols, strict=True):
                if out is None:
                    name, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                    size += out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(record(page_id, url, None if html is None else html.encode(), n_bytes, digest, refers_to))
                n += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            made.append((name, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_bytes", "n_records"])

    return stored(records.mapInArrow(run, "path string, n_bytes long, n_records long"), "manifest")


class _Source:
    """Pieces of an opened file; the last one read is kept."""

    def __init__(self, file, piece: int = 1 << 20):
        self.file, self.piece, self.size, self.at, self.buf = file, piece, file.size(), 0, b""

    def ahead(self, pos: int, most: int | None = None) -> memoryview:
        """Bytes from pos on: at least one, unless the file ends there, and at most `most`."""
        if not self.at <= pos < self.at + len(self.buf):
            self.at, self.buf = pos, self.file.read_at(min(self.piece, max(0, self.size - pos)), pos)
        got = memoryview(self.buf)[pos - self.at :]
        return got if most is None else got[:most]

    def find_magic(self, pos: int, end: int) -> int:
        """The first place of the gzip magic in [pos, end), or -1."""
        while pos < end:
            got = len(self.ahead(pos))
            if got < len(MAGIC) and pos + got < self.size:  # a piece ends within what may be the magic
                self.at, self.buf = pos, self.file.read_at(min(self.piece, self.size - pos), pos)
                got = len(self.buf)
            at = self.buf.find(MAGIC, pos - self.at)
            if at >= 0:
                return self.at + at if self.at + at < end else -1
            pos += max(1, got - len(MAGIC) + 1)
        return -1


def _header(raw: bytes) -> dict[str, str] | None:
    """Fields of a whole WARC header."""
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines)}
    return head if head.get("content-length", "").isdigit() and "warc-type" in head else None


def _member_at(source: _Source, at: int) -> tuple[int, dict[str, str], bytes] | None:
    """End, header and block of the WARC record whose gzip member begins at `at`, or None if there is none."""
    z, raw, pos, head, n = zlib.decompressobj(31), bytearray(), at, None, 0
    step = 4096
    try:
        while not z.eof:
            got = source.ahead(pos, step)
            if not len(got):
                return None  # cut off
            pos += len(got)
            step = 1 << 18
            seen = max(0, len(raw) - 3)
            raw += z.decompress(got)
            if head is None:
                if not raw.startswith(_VERSION[: len(raw)]):
                    return None
                if (n := raw.find(b"\r\n\r\n", seen)) >= 0:
                    if (head := _header(bytes(raw[:n]))) is None:
                        return None
                    n += 4
    except zlib.error:
        return None
    if head is None or len(raw) < n + int(head["content-length"]):
        return None
    return pos - len(z.unused_data), head, bytes(memoryview(raw)[n : n + int(head["content-length"])])


def members(source: _Source, start: int, end: int, sure: bool = False) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Beginning, end, header and block of members that begin in [start, end), found by the magic; each is looked for where the one before it ended."""
    pos, end = start, min(end, source.size)
    while pos < end:
        at = pos if sure else source.find_magic(pos, end)
        if at < 0:
            return
        if (got := _member_at(source, at)) is None:
            pos, sure = at + 1, False
            continue
        yield at, *got
        pos, sure = got[0], False


ROWS = "path string, start long, first long, last long, n_records long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last in ("", "none") else int(last)


def _row(path: str, head: dict[str, str], block: bytes) -> tuple | None:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of a response or revisit record."""
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    digest, n = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
    if kind == "response":
        payload = memoryview(block)[block.find(b"\r\n\r\n") + 4 :]
        n, got = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if got != digest:
            raise ValueError(f"{path}: payload of {head['warc-record-id']} has digest {got}, not {digest}")
    return _page(head["warc-record-id"]), head.get("warc-target-uri", ""), n, digest, kind, _page(head["warc-refers-to"]) if kind == "revisit" else None


def read_ranges(ranges: DataFrame, folder: str) -> DataFrame:
    """ranges: path, start, end, whole (number of records if it is the whole archive, else null). A row for each record, and one for each range (page_id and record_type null) with where its members begin and end and how many records it has."""
    kinds = (pa.string(), *[pa.int64()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in ROWS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for b in batches:
            for path, start, end, whole in zip(*(column(b, c).to_pylist() for c in ("path", "start", "end", "whole")), strict=True):
                rows, first, last = [], None, None
                with fs.open_input_file(path) as file:
                    source = _Source(file)
                    for at, to, head, block in members(source, start, end, whole is not None):
                        if whole is None and at != last:  # a gap: what came before lay inside a payload
                            rows, first = [], at
                        last = to
                        if (row := _row(path, head, block)) is not None:
                            rows.append((path, start, None, None, None, *row))
                    if whole is None and last is not None and last < end and last < source.size:
                        rows, first, last = [], None, None  # so did all of it
                if whole is not None and len(rows) != whole:
                    raise ValueError(f"{path} holds {len(rows)} records, not {whole}")
                yield batch([*rows, (path, start, first, last, len(rows), *[None] * 6)])

    return ranges.select("path", "start", "end", "whole").mapInArrow(run, ROWS)


def read_archives(manifest: DataFrame, folder: str, split: int = SPLIT_BYTES) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every response and revisit record."""
    spark = manifest.sparkSession
    total = manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split))).first()[0] or 0
    ranges = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, min(int(total), 4 * spark.sparkContext.defaultParallelism)) if total < 40_000 else int(total // 10))
    got = stored(read_ranges(ranges.withColumn("end", F.col("start") + split).withColumn("whole", F.lit(None).cast("long")), folder), "records")
    # every range must begin where the members before it ended, unless these reach beyond it
    before = F.coalesce(F.max("last").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    joint = F.when(F.col("first").isNull(), before >= F.col("start") + split).otherwise(F.col("first") == before)
    seen = got.where("record_type is null").withColumn("joint", joint).groupBy("path").agg(F.min("joint").alias("joint"), F.sum("n_records").alias("n"), F.max("last").alias("last"))
    again = manifest.join(seen, "path", "left").where(~F.coalesce(F.col("joint") & (F.col("n") == F.col("n_records")) & (F.col("last") == F.col("n_bytes")), F.lit(False)))
    again = stored(again.select("path", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"), F.col("n_records").alias("whole")), "again")
    records = got.where("record_type is not null")
    if not again.isEmpty():
        records = records.join(again.select("path"), "path", "left_anti").select(*records.columns).union(read_ranges(again.repartition("path"), folder).where("record_type is not null"))
    return records.drop("path", "start", "first", "last", "n_records")


def round_trip(pages: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(record_plan(pages), folder), folder, split)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC) AS k FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM r
"""
