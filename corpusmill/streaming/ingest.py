"""Incremental ingestion: new files in, lines judged once, duplicates of all earlier runs rejected. Restarts go on from the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import Profile, normalized_lines, passes, verdicts
from ..functions import text as X

#: Without space reserved ahead, which is some MB for each partition of the state.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def distinct_lines(stream: DataFrame, profile: Profile, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stream of accepted lines, the first of each digest. Digests stay in the state store for good, since a line may come again at any time; so the store is RocksDB, which keeps
    them on disk instead of the executors' heaps, and writes what a batch changes. A checkpoint of another store goes on only with that store (PROVIDER set back after this call)."""
    for key, value in PROVIDER.items():
        stream.sparkSession.conf.set(key, value)
    lines = normalized_lines(stream, profile, id, text)
    rule = passes(profile, F.col("raw") if profile.on_raw else F.col("line"))
    return lines.where(rule).withColumn("digest", X.digest(F.col("line"))).dropDuplicates(["digest"])


def ingest(spark: SparkSession, source: str, schema: T.StructType | str, out: str, checkpoint: str, profile: Profile, *, blocked: DataFrame | None = None, order: list[str], files_per_trigger: int = 1) -> None:
    """Runs over the files that are new since the last run, batch by batch: judges lines, and writes those not written before to out/batch=n.

    A batch that is run again after a failure replaces its own folder, so out never has a line twice.
    """

    def put(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        judged = verdicts(normalized_lines(batch, profile), blocked, profile, order=order).where("verdict = 'accepted'")
        p = session._jvm.org.apache.hadoop.fs.Path(out)
        if p.getFileSystem(session._jsc.hadoopConfiguration()).exists(p):
            before = session.read.parquet(out).where(F.col("batch") < n).select("digest")
            judged = judged.join(before, "digest", "left_anti")
        judged.select(*order, "line", "digest").write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
