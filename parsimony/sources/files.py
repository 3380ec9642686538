"""Sources and sinks: payload files, JSONL ledgers, report files by pattern, CSV."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsimony.operators.ledger import RECORD, records_of_reports


def materialised(df: DataFrame) -> DataFrame:
    """df cut off from what made it, by a checkpoint in the folder that the cluster names; only where driver and executors are one process may that be a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="parsimony-")
            atexit.register(shutil.rmtree, base, True)
        sc.setCheckpointDir(base)
    return df.checkpoint()


def read_payloads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, body of each file; `*` and `?` in the pattern match names in one folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("body"), "content")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL ledger without the lines that don't parse; a missing file is an empty ledger."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path).where("request_id is not null")


def append_ledger(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_reports(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Ledger records, with markers, of the report files whose names match."""
    return records_of_reports(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def write_payloads(df: DataFrame, path: str, column: str = "out") -> None:
    df.select(column).write.mode("overwrite").text(path)
