"""Sources. Every reader gives columns that later steps can order by, since files have an order and tables don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..tables import sized

TEXT_COLUMNS = ["text", "content", "document"]


def text_column(df: DataFrame) -> str:
    """The first of the usual names that df has."""
    found = next((c for c in TEXT_COLUMNS if c in df.columns), None)
    if found is None:
        raise ValueError(f"no text column among {df.columns}")
    return found


def parquet_texts(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """src_file and text of all parquet files under paths, schemas united by name. A text that isn't a string is null."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", recursive).parquet(*paths)
    name = text_column(df)
    kept = F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.lit(None).cast("string")
    return df.select(F.col("_metadata.file_path").alias("src_file"), kept.alias("text"))


def stream_texts(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def text_lines(spark: SparkSession, *paths: str, blank: bool = False, recursive: bool = False, ends: str | None = None) -> DataFrame:
    """src_file and value: lines of text files. ends: "\\n" for LF alone; else LF, CR and CRLF end lines."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if recursive:
        reader = reader.option("pathGlobFilter", "*.txt")
    if ends:
        reader = reader.option("lineSep", ends)
    df = reader.text(list(paths)).select(F.col("_metadata.file_path").alias("src_file"), "value")
    return df if blank else df.where(X.strip(F.col("value")) != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """src_file, line_no (from 1) and value of files that each fit a cell; for small ones, where numbers matter more than size."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("src_file"), "value")
    return whole.select("src_file", F.posexplode(X.lines(F.col("value"))).alias("at", "value")).select("src_file", (F.col("at") + 1).cast("long").alias("line_no"), "value")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records with line_no, problems): blank lines are skipped; a line that isn't an object of this form is a problem (label, problem)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = numbered_lines(spark, path).where(X.strip(F.col("value")) != "").withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    problems = parsed.where(bad).select(F.concat(F.lit("line "), F.col("line_no")).alias("label"), F.lit("invalid JSON").alias("problem"))
    return parsed.where(~bad).select("line_no", *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), problems


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """The document as a row, or None if there is no such file or it isn't JSON of this form."""
    from pyspark.errors import PySparkException

    try:
        df = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
        return df if df.limit(1).count() else None
    except PySparkException:
        return None


def binary_ids(spark: SparkSession, path: str) -> DataFrame:
    """pos and token_id of files of unsigned little-endian 32-bit numbers that each fit a cell, in the order of their names."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    n = (F.octet_length("content") / 4).cast("int")
    placed = raw.select("path", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("at"), "content")
    byte = lambda k: F.conv(F.hex(F.substring("content", F.col("at") * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    ids = placed.select("path", "at", (byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216).alias("token_id"))
    sizes = raw.select("path", n.cast("long").alias("n"))
    from pyspark.sql import Window

    before = sizes.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))  # a row for each file
    return ids.join(sized(before), "path").select((F.col("before") + F.col("at")).alias("pos"), "token_id")


def line_digests(lines: DataFrame, column: str = "value", limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Distinct digests of raw lines; with limit those of the first so many distinct ones in the order."""
    hashed = lines.select(X.digest(F.col(column)).alias("digest"), *(order or []))
    if not limit:
        return hashed.select("digest").distinct()
    first = hashed.groupBy("digest").agg(F.min(F.struct(*order)).alias("at"))
    return first.orderBy("at").limit(limit).select("digest")
