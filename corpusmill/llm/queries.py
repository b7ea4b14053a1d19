"""One query opN_<name> for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .common import fresh_path, stash, table
from .decontaminate import find_matches, summary
from .minhash import near_duplicates
from .packing import pack
from .pii import KINDS, find_personal, joined
from .quality import resample
from .sharding import histogram_sort
from .token_counts import count_tokens
from .urls import Rule, judge
from .warc import catalogue, classify, quarantine, read_warc, write_warc


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The rules of the query, as host, path and verdict.
URL_RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), byte_bpe(), keep=["doc_id"], size=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, (lambda name: lambda k: k == name)(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), byte_bpe(), keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], window=8))
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated")
    )


def text_group_key(text: str, row: str) -> Column:
    """Equal texts side by side in the order of keys (the upper 40 bits; null is an empty text), each row apart (the lower 24)."""
    low = F.lit((1 << 24) - 1)
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.xxhash64(F.col(row)).bitwiseAND(low))


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = stash(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            text_group_key("text", "doc_id").alias("key"),
        ),
        "shard-input",
    )
    sharded = histogram_sort(narrow, F.col("key"), F.col("size"), shards=24)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, log = fresh_path(spark, "warc"), fresh_path(spark, "quarantine")
    write_warc(classify(table(spark, sf_dir, "pages"), url="url", least=0), path)
    read = stash(read_warc(spark, path, "part-*").drop("payload"), "archive")
    if n := quarantine(read, log):
        raise ValueError(f"{n} damaged stretches in archives just written; see {log}")
    return catalogue(read).select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Words as the operator takes them, for DuckDB.
WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""WITH d AS (SELECT doc_id, {WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, p.k, i FROM places p JOIN windows USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS spot FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP10_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, array_to_string(list_transform(range(1, 41), lambda k: lpad(bin(strpos('0123456789abcdef', substr(sha1(html), k, 1)) - 1), 4, '0')), '') AS bits FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN (16 >> j) ELSE 0 END))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the rest is compared with brute force in tests/llm."""
    return {"op5_decontaminate": OP5_SQL, "op10_warc": OP10_SQL}
