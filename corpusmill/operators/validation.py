"""Files against what a manifest says of them, and what must hold before a tokenizer may be trained. Both give a table of problems; no row means clean."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import text_lines
from ..tables import file_size
from .reports import compared, not_idempotent

# What a manifest must have, the languages of a corpus in order, and what a builder that was stopped leaves behind.
MANIFEST_KEYS = ["version", "normalizer", "counts", "corpus"]
LANGUAGES = ["ar", "arz", "en"]
LEFTOVERS = [".build_arz_v10.lock", "corpus.txt.tmp", "tokenizer_train_v10.json.tmp"]
LEAST_BYTES = 1_000_000
#: A file of at most so many bytes is read as one cell; a larger one is read through once, in order, since its digest can't be put together from parts.
CELL_BYTES = 1 << 30
FACTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("sha256", T.StringType())])


def file_facts(spark: SparkSession, paths: list[str], cell_bytes: int = CELL_BYTES) -> DataFrame:
    """path, bytes, lines (line feeds) and the SHA-256 of each of paths; a path without a file has null facts."""
    sizes = {p: file_size(spark, p) for p in paths}
    rows = []
    for p, n in sizes.items():
        if n is None:
            rows.append((p, None, None, None))
        elif not n:  # file sources pass over empty files
            rows.append((p, 0, 0, hashlib.sha256(b"").hexdigest()))
        elif n > cell_bytes:
            sha, lines = streamed(spark, p)
            rows.append((p, n, lines, sha))
        else:
            text = F.col("content").cast("string")
            lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
            rows.append((p, n, *spark.read.format("binaryFile").load(p).select(lines.cast("long"), F.sha2("content", 256)).first()))
    return spark.createDataFrame(rows, FACTS)


def streamed(spark: SparkSession, path: str) -> tuple[str, int]:
    """Digest and line feeds of a file of any size: the digest in one pass of the JVM, the lines by tasks."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        sha = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(source)
        size = file_size(spark, path)
        source.seek(max(0, size - 1))
        ended = size == 0 or source.read() == 10
    finally:
        source.close()
    return sha, spark.read.option("lineSep", "\n").text(path).count() - (not ended)


def manifest_problems(spark: SparkSession, manifest: dict, corpus: str, texts: str, leftovers: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """label, problem, expected and actual: keys that the manifest lacks, files that are missing or differ from it in bytes, digest or lines, and leftovers of a builder.

    corpus: the path of the whole corpus; texts: the folder of a file for each language. A language whose target is 0 may lack its file; if there is one, it must be as the manifest says.
    """
    languages = LANGUAGES if languages is None else languages
    counts, whole = manifest.get("counts") or {}, manifest.get("corpus") or {}
    said = {"corpus": (corpus, whole.get("bytes"), None, whole.get("sha256"))}
    for one in languages:
        c = counts.get(one) or {}
        said[one] = (f"{texts}/{one}.txt", c.get("bytes"), c.get("accepted"), c.get("sha256"))
    absent = {one for one in languages if not (counts.get(one) or {}).get("target", 0)}
    facts = {r["path"]: r for r in file_facts(spark, [path for path, *_ in said.values()]).collect()}
    found = [(k, "missing key", k, None) for k in MANIFEST_KEYS if k not in manifest]
    found += [(name, "missing file", path, None) for name, (path, *_) in said.items() if facts[path]["bytes"] is None and name not in absent]
    found += [(path, "leftover", None, path) for path in (leftovers or []) if file_size(spark, path) is not None]
    there = {name: x for name, x in said.items() if facts[x[0]]["bytes"] is not None}
    schema = "label string, bytes long, lines long, sha256 string"
    expected = spark.createDataFrame([(name, n, lines if name != "corpus" else facts[p]["lines"], sha) for name, (p, n, lines, sha) in there.items()], schema)
    actual = spark.createDataFrame([(name, facts[p]["bytes"], facts[p]["lines"], facts[p]["sha256"]) for name, (p, *_) in there.items()], schema)
    differ = compared(expected, actual, "label", ["bytes", "lines", "sha256"]).select("label", F.concat(F.col("column"), F.lit(" differ")).alias("problem"), "expected", "actual")
    return spark.createDataFrame(found, "label string, problem string, expected string, actual string").unionByName(differ)


def training_problems(spark: SparkSession, corpus: str, artifacts: list[str], *, protected: list[str] | None = None, force: bool = False, least_bytes: int = LEAST_BYTES, first: int = 2_000) -> DataFrame:
    """label and problem: no corpus, one of too few bytes, artifacts that would be written over (unless force; protected ones never may), and lines among the first so many that
    normalizing alters."""
    n = file_size(spark, corpus)
    found = [(corpus, "missing file")] if n is None else [(corpus, f"{n} bytes, fewer than {least_bytes}")] if n < least_bytes else []
    found += [(a, "would be written over") for a in artifacts if not force and file_size(spark, a) is not None]
    found += [(a, "is protected") for a in artifacts if a in (protected or [])]
    if n is not None:
        lines = text_lines(spark, corpus, ends="\n").select("value", F.monotonically_increasing_id().alias("at"))
        r = not_idempotent(lines, "value", ["at"], first).first()
        found += [(corpus, f"{r['mismatches']} of {r['checked']} lines aren't normal, first: {r['example']}")] if r["mismatches"] else []
    return spark.createDataFrame(found, "label string, problem string")
