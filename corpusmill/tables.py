"""Reading tables, the folder that driver and executors share, and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> SparkSession:
    """Gives executors this package, once for each context: their Python workers import it wherever the driver was started."""
    context = spark.sparkContext
    if not getattr(context, "_corpusmill_shipped", False):
        top = Path(__file__).resolve().parent
        if top.is_dir():
            target = os.path.join(tempfile.mkdtemp(prefix="corpusmill-"), "corpusmill.zip")
            with zipfile.ZipFile(target, "w") as z:
                for f in sorted(top.rglob("*.py")):
                    z.write(f, f.relative_to(top.parent))
            context.addPyFile(target)
        context._corpusmill_shipped = True
    return spark


def settle(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches by bytes as well as by rows, so that long texts can't fill a Python worker, and gives workers this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer: a small file of one row group would keep one core busy. Larger inputs aren't exchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that has none gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, so a lost executor costs nothing computed before."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def forget(*stashed: DataFrame) -> None:
    """Deletes tables that stash() wrote, once nothing reads them any more. Other DataFrames are left alone."""
    for df in stashed:
        if path := getattr(df, "_stashed_at", None):
            delete(df.sparkSession, path)


#: A table of at most so many rows may be broadcast, if its rows are narrow; a larger one is joined by exchange.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """df (narrow, best a written table), marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def file_size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file, None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getLen() if fs.exists(p) else None


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
