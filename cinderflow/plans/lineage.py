"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and all runs on this machine (tests), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cinderflow-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written once as a Parquet table in the shared folder and read back: its lineage ends there, so a lost
    executor costs a re-read and not a recomputation of everything before."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many bytes of compressed files are a task's share.
SHARE = 2 << 20


def dealt(scan: DataFrame) -> DataFrame:
    """A scan of fewer files than there are cores, or shares of SHARE bytes, is dealt out in as many parts; any other is left as it is. How many
    partitions Spark plans doesn't count: it cuts a file by bytes, but a row group, often a million rows, is read whole by one of them, and what is computed from
    it stays in that task."""
    files = scan.inputFiles()
    path, conf = scan.sparkSession._jvm.org.apache.hadoop.fs.Path, scan.sparkSession._jsc.hadoopConfiguration()
    stored = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, files))
    parts = max(scan.sparkSession.sparkContext.defaultParallelism, -(-stored // SHARE))
    return scan.repartition(parts) if len(files) < parts else scan


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that sorts both sides. Sizes are estimated from those of compressed files, and rows that an explode makes of one
    row aren't counted: by them Spark would send to the driver, and from there to all executors, what is a hundred times as large."""
    return df.hint("merge")
