"""Sinks. Directories are committed by Spark: a job that fails leaves nothing that looks whole."""

from __future__ import annotations

import contextlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import file_size
from .readers import numbered_lines


def write_shards(rows: DataFrame, line: str, path: str, order: list[str], shard: str = "shard") -> None:
    """A folder shard=n of one text file for each shard, lines in order."""
    rows.repartition(F.col(shard)).sortWithinPartitions(shard, *order).select(shard, F.col(line).alias("value")).write.partitionBy(shard).text(path)


def write_groups(rows: DataFrame, line: str, by: str, path: str, order: list[str]) -> None:
    """A folder for each group (category, language); line feeds inside a line become spaces."""
    rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(by, *order).select(by, X.flattened(F.col(line)).alias("value")).write.partitionBy(by).text(path)


def write_in_order(rows: DataFrame, line: str, path: str, order: list[str], files: int = 1) -> None:
    """Text files whose concatenation, by name, is the lines in order."""
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select(F.col(line).alias("value")).write.text(path)


def concatenated(parts: list[tuple[str, DataFrame]], line: str, order: list[str]) -> DataFrame:
    """All parts as one table to be written in order: part (its place), lang, and the line."""
    out = None
    for k, (name, df) in enumerate(parts):
        one = df.select(F.lit(k).alias("part"), F.lit(name).alias("lang"), *order, line)
        out = one if out is None else out.unionByName(one)
    return out


def write_ids(stream: DataFrame, path: str) -> None:
    """A token stream (pos, token_id) as parquet, ordered by pos."""
    stream.repartitionByRange(F.col("pos")).sortWithinPartitions("pos").write.parquet(path)


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text file, replaced as a whole: written beside its place, then put over it by one rename, so that there is the old or the new one at any time."""
    jvm = spark._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    fs.setWriteChecksum(False)  # a local file that is edited by hand later should still be read
    out = fs.create(beside, True)
    fs.setWriteChecksum(True)
    out.write(bytearray("".join(x + "\n" for x in lines).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    files.rename(fs.makeQualified(beside), fs.makeQualified(target), how)


def write_json(spark: SparkSession, path: str, content: DataFrame | dict) -> None:
    """A manifest or report as one JSON file, replaced as a whole."""
    if isinstance(content, DataFrame):
        row = content.select(F.to_json(F.struct("*"))).first()
        content = json.loads(row[0]) if row else {}
    write_lines(spark, path, [json.dumps(content, ensure_ascii=False, indent=2)])


def upsert_lines(spark: SparkSession, path: str, records: list[dict], key: str) -> None:
    """Records put into a file of JSON lines: one of a key that is there takes its place, others are added at the end. Every other line stays as it is, byte for byte."""
    new = {r[key]: json.dumps(r, ensure_ascii=False) for r in records}
    out = []
    for row in numbered_lines(spark, path).orderBy("line_no").collect() if file_size(spark, path) is not None else []:
        try:
            old = json.loads(row["value"]).get(key)
        except (ValueError, AttributeError):
            old = None
        if row["value"] or old is not None:
            out.append(new.pop(old) if old in new else row["value"])
    write_lines(spark, path, [*out, *new.values()])


@contextlib.contextmanager
def single_writer(spark: SparkSession, path: str):
    """Holds a lock file in the store that all writers share; a second holder fails."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        fs.create(p, False).close()
    except Py4JJavaError as e:
        raise FileExistsError(path) from e
    try:
        yield
    finally:
        fs.delete(p, False)


def replace_folder(spark: SparkSession, df: DataFrame, path: str, format: str = "parquet") -> None:
    """df in place of the folder's content: written beside it, then the old one is moved aside, the new one into its place, and the old one deleted. If a run stops between the two
    moves, the next one begins by moving the old one back, so the content is never lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    target, beside, aside = p(path), p(f"{path}.new"), p(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(target):
        fs.rename(aside, target)
    fs.delete(aside, True)
    fs.delete(beside, True)
    df.write.format(format).save(f"{path}.new")
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(beside, target):
        raise OSError(f"could not put {path} in place")
    fs.delete(aside, True)
