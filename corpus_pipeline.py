"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, packing. Each stage's result is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh_path, table
from corpusmill.llm.components import without
from corpusmill.llm.decontaminate import decontaminate
from corpusmill.llm.minhash import near_duplicates
from corpusmill.llm.packing import pack
from corpusmill.llm.pii import find_personal, redacted
from corpusmill.llm.quality import resample
from corpusmill.llm.queries import byte_bpe

#: SQL can't express the stages; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that importance resampling rejects.

    A null or empty text weighs 0 (log) and is judged by that; rows of one id get the same noise; rows of a null id too. Without labels of both sorts, and in an empty table, all rows
    stay. Columns and repeated rows are as they were.
    """
    cols = docs.columns
    scored = resample(docs, table(spark, sf_dir, "labels"), keep=cols)
    return scored.where("kept").select(*cols)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id; of rows that share an id the one of the least values, column by column.

    A null or empty text, and one without words, is no copy of another. Rows without an id stay. An empty table stays empty.
    """
    classes = near_duplicates(docs)
    return without(docs, classes, "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a passage of a benchmark item occurs: 8 words in a row, or a shorter item whole.

    A null or empty text has no passage and stays; repeated rows stay or go together; with an empty benchmark all rows stay. Items without an id count for nothing.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars, if there is such a column, follows.

    A null or empty text stays as it is; repeated rows are redacted each; an empty table stays empty. Other columns are as they were, save one named spans, which is null.
    """
    cols = docs.columns
    found = find_personal(docs, keep=cols).withColumn("text", redacted("text", F.col("spans")))
    if "n_chars" in cols:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == "spans" else F.col(f"`{c}`") for c in cols])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens.

    A null or empty text is one piece of one token, the end id; repeated rows are packed each; an empty table gives no rows. Only doc_id is carried.
    """
    packed = pack(docs, byte_bpe(), keep=["doc_id"], size=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("pii", personal_data), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what lies between is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
