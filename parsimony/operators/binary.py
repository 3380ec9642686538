"""Image payloads without their metadata, and line diffs; kernels for Arrow functions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
# What is dropped.
PNG_CHUNKS = (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME")
JPEG_SEGMENTS = (0xE1, 0xFE)


def strip_png(data: bytes) -> bytes:
    """Without text, EXIF and time chunks; other chunks keep their checksums."""
    if not data.startswith(PNG):
        raise ValueError("no PNG signature")
    out, at = [PNG], len(PNG)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut off in a chunk")
        (n,) = struct.unpack_from(">I", data, at)
        end = at + 12 + n
        if end > len(data):
            raise ValueError("cut off in a chunk")
        if data[at + 4 : at + 8] not in PNG_CHUNKS:
            out.append(data[at:end])
        at = end
    return b"".join(out)


def strip_jpeg(data: bytes) -> bytes:
    """Without EXIF (APP1) and comment segments; from the scan on nothing changes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG signature")
    out, at = [data[:2]], 2
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError("no marker where one is due")
        kind = data[at + 1]
        if kind in (0xDA, 0xD9):  # scan or end: the rest is copied
            out.append(data[at:])
            return b"".join(out)
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            end = at + 2
        else:
            if at + 4 > len(data):
                raise ValueError("cut off in a segment")
            end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
            if end < at + 4 or end > len(data):
                raise ValueError("bad segment length")
        if kind not in JPEG_SEGMENTS:
            out.append(data[at:end])
        at = end
    raise ValueError("no scan")


def strip_image(data: bytes) -> bytes:
    if data.startswith(PNG):
        return strip_png(data)
    if data.startswith(b"\xff\xd8"):
        return strip_jpeg(data)
    raise ValueError("neither JPEG nor PNG")


def strip_images(df: DataFrame, content: str = "content") -> DataFrame:
    """df with stripped (binary, null on failure) and error."""

    @F.pandas_udf("stripped binary, error string")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            try:
                rows.append((strip_image(bytes(d)) if d is not None else None, None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["stripped", "error"])

    return df.withColumn("__r", run(content)).select(*df.columns, "__r.stripped", "__r.error")


def split_lines(text: str) -> list[str]:
    """Lines without their ends, which are newlines with or without a carriage return in front."""
    *ended, last = text.split("\n")
    return [x.removesuffix("\r") for x in ended] + ([last] if last else [])


def line_diff(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """equal, delete and insert lines by a longest common subsequence; deletions come first where both are as good.

    Equal lines in front are taken off. Of the table of common lengths only every k-th row is kept, k about the square
    root of the rows; those between are made again when the way leads through them.
    """
    out: list[tuple[str, str]] = []
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out.append(("equal", a[head]))
        head += 1
    a, b = a[head:], b[head:]
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(s, len(ids)) for s in a], np.int64)
    y = np.array([ids.setdefault(s, len(ids)) for s in b], np.int64)
    n, m = len(a), len(b)

    def above(i: int, below: np.ndarray) -> np.ndarray:
        """Common lengths of a[i:] with each rest of b, from those of a[i + 1:]."""
        row = np.where(y == x[i], below[1:] + 1, below[:-1])
        return np.append(np.maximum.accumulate(row[::-1])[::-1], 0)

    step = max(1, int(n**0.5))
    kept, row = {n: np.zeros(m + 1, np.int32)}, np.zeros(m + 1, np.int32)
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    i = j = 0
    while i < n and j < m:
        if i % step == 0 or i == 0:
            top = min(n, i + step)
            rows = {top: kept[top]}
            for k in range(top - 1, i - 1, -1):
                rows[k] = above(k, rows[k + 1])
        now = i
        while i == now and j < m:
            if x[i] == y[j]:
                out.append(("equal", a[i]))
                i, j = i + 1, j + 1
            elif rows[i + 1][j] >= rows[i][j + 1]:
                out.append(("delete", a[i]))
                i += 1
            else:
                out.append(("insert", b[j]))
                j += 1
    return out + [("delete", s) for s in a[i:]] + [("insert", s) for s in b[j:]]


def line_diffs(df: DataFrame, *keys: str) -> DataFrame:
    """The keys (long), pos, tag, line for each row of df (keys, before, after)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = zip(*(b[k] for k in keys), strict=True)
            rows = [(*i, k, t, x) for i, p, q in zip(ids, b["before"], b["after"], strict=True) for k, (t, x) in enumerate(line_diff(split_lines(p), split_lines(q)))]
            yield pd.DataFrame(rows, columns=[*keys, "pos", "tag", "line"])

    return df.select(*(F.col(k).cast("long").alias(k) for k in keys), "before", "after").mapInPandas(run, ", ".join(f"{k} bigint" for k in keys) + ", pos int, tag string, line string")
