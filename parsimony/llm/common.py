"""Shared plumbing of the training-data operators: shared folder, Arrow text blocks, hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsimony.functions.batches import BATCH_BYTES, bound_batches, give_back  # noqa: F401

#: Text bytes handled at once in a Python worker; a single longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only where driver and executors are one process may it be unset; then it is a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parsimony-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed by the driver's file system client at exit."""
    path = f"{shared_dir(spark)}/parsimony-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes and rows of a row group in tables that workers write; Spark reads a group at a time, so large blobs never lie in the JVM by the file.
GROUP_BYTES, GROUP_ROWS = 2 << 20, 50_000


def written(df: DataFrame, tag: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """As stored(), of df or of df.mapInArrow(run, schema), but in a local folder the Python workers write the files.

    Hadoop's local file system starts a process for each file and folder that it makes, which shares the JVM's memory for
    a moment and is counted with all of it; besides, rows of a run need not pass through the JVM. A task writes under a
    hidden name and returns it; the driver gives the files of successful tasks their names, so nothing of a failed or
    repeated attempt is ever read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    if not shared_dir(spark).startswith(("file:", "/")):
        return stored(df.mapInArrow(run, schema) if run else df, tag)
    bound_batches(spark)
    path = new_folder(spark, tag)
    folder = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(folder)
    kind = StructType.fromDDL(schema) if run else df.schema
    arrow = to_arrow_schema(kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet as pq

        name, writer, some, size, rows = f".{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", None, [], 0, 0
        try:
            for b in chain(run(batches) if run else batches, [None]):
                if b is not None and b.num_rows:
                    some.append(pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for f, c in ((f, column(b, f.name)) for f in arrow)], schema=arrow))
                    size, rows = size + some[-1].nbytes, rows + b.num_rows
                if some and (b is None or size >= GROUP_BYTES or rows >= GROUP_ROWS):
                    writer = writer or pq.ParquetWriter(f"{folder}/{name}", arrow, use_dictionary=False)
                    writer.write_table(pa.Table.from_batches(some), row_group_size=max(rows, 1))
                    some, size, rows = [], 0, 0
        finally:
            if writer:
                writer.close()
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # nothing reads this query's shuffles again
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        names = df.mapInArrow(write, "name string").collect()
    finally:
        spark.conf.set(tidy, before)
    for r in names:
        os.rename(f"{folder}/{r.name}", f"{folder}/part-{r.name[1:]}.parquet")
    return spark.read.schema(kind).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0].replace("file:///", "file:/") for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("parsimony-"):
                drop_folder(df.sparkSession, folder)


def stored_rows(spark: SparkSession, folder: str, columns: list[str]):
    """A function that reads rows of a stored table wherever it is called, one row group at a time, as Arrow batches; driver and executors see the same folder."""
    bound = folder

    def read() -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        files, root = fs.FileSystem.from_uri(bound)
        for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
            if info.path.endswith(".parquet") and info.size:
                with files.open_input_file(info.path) as f:
                    yield from pq.ParquetFile(f).iter_batches(batch_size=1, columns=columns)

    return read


def stored_at(df: DataFrame, tag: str) -> str:
    """Folder in which df was written as Parquet."""
    bound_batches(df.sparkSession)
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return path


def id_and_text(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(names: list[str], name: str) -> str:
    """A column name like `name` that none of names equals, in any case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without copying, and the offsets of its rows."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` text bytes each, or with one row."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_buffer(column(b, text))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
        del b
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
