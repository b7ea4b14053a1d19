"""Registered queries: one or more for each operator, on the driver's tables. plans/oracle.py has the SQL of the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.model_size import parameters
from ..operators import corpus as C
from ..operators import gates as G
from ..operators import ordering as O
from ..operators import pieces as P
from ..operators import reports as R
from ..operators import tokens as K
from ..tables import spread, stash, table

#: The driver's documents have no Arabic.
LINES = C.LATIN_LINES
FLAGS = ["quality", "eval", "duplicate", "accepted"]


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def lines(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return C.normalized_lines(docs(spark, sf), LINES, keep=list(keep))


def eval_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What the verdict queries block: the first line of every hundredth document, and the benchmark's lines."""
    some = lines(spark, sf).where("doc_id % 100 = 0 AND pos = 0").select("line")
    bench = C.normalized_lines(table(spark, sf, "benchmark"), LINES, id="item_id").select("line")
    return C.digests(some.unionByName(bench))


def judged(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return C.verdicts(lines(spark, sf, *keep), eval_lines(spark, sf), LINES, order=["doc_id", "pos"])


def narrow(spark: SparkSession, sf: str) -> DataFrame:
    return stash(judged(spark, sf).select("doc_id", "pos", "verdict"), "verdicts")


def counted(df: DataFrame, names: list[str] = FLAGS) -> DataFrame:
    return df.agg(*[F.count_if(F.col("verdict") == n).alias(n) for n in names])


def long(c) -> F.Column:
    return c.cast("long")


# ---- scalar functions


def normalize_documents(spark, sf):
    return docs(spark, sf).select("doc_id", X.fingerprint(X.normalized(F.col("text"))).alias("sha"), long(F.char_length(X.normalized(F.col("text")))).alias("n"))


def whitespace_functions(spark, sf):
    t = F.concat(F.lit(" \t"), F.col("text"), F.lit("\r\n\n\n x \x0b y \xa0"))
    return docs(spark, sf).select("doc_id", X.tidy_whitespace(t).alias("tidy"), X.strip(t).alias("stripped"), X.odd_whitespace(F.col("text")).alias("odd"), X.flattened(F.col("text")).alias("flat"))


def arabic_marks(spark, sf):
    t = F.concat(F.lit("مُحــمَّد "), F.col("text"))
    return docs(spark, sf).select("doc_id", X.without_tatweel(t).alias("no_tatweel"), X.without_diacritics(t).alias("no_diacritics"), X.script_ratio(t, "arabic").alias("ratio"), X.language(t).alias("lang_id"))


def split_lines_and_words(spark, sf):
    return docs(spark, sf).select("doc_id", long(F.size(F.filter(X.lines(F.col("text")), lambda x: x != ""))).alias("n_lines"), long(F.size(X.words(F.col("text")))).alias("n_words"), long(F.size(F.array_distinct(X.words(F.col("text"))))).alias("n_unique"))


def unique_word_ratio(spark, sf):
    return docs(spark, sf).select("doc_id", X.unique_ratio(X.words(F.col("text"))).alias("ratio"))


def script_ratios(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", X.script_ratio(t, "latin").alias("latin_ratio"), X.script_share(t, "latin").alias("latin_share"), long(F.regexp_count(t, F.lit(X.SCRIPTS["arabic"]))).alias("arabic_chars"))


def text_lengths(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", long(F.char_length(t)).alias("n_chars"), long(F.octet_length(t)).alias("n_bytes"), X.head(t, 70).alias("head"), F.is_valid_utf8(t).alias("valid"))


def fingerprints(spark, sf):
    sha = X.fingerprint(F.col("text"))
    return docs(spark, sf).select("doc_id", sha.alias("sha"), F.substring(sha, 1, 12).alias("short_sha"), X.is_hex_digest(sha).alias("is_digest"), X.is_hex_digest(F.col("source")).alias("source_is_digest"))


def language_id_counts(spark, sf):
    return lines(spark, sf).groupBy(X.language(F.col("line")).alias("lang_id")).agg(F.count("*").alias("n"))


def safe_ratios(spark, sf):
    d = docs(spark, sf).groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars"), F.sum(F.size(X.words(F.col("text")))).alias("words"), F.sum(F.lit(0)).alias("zero"))
    return d.select("lang", X.safe_divide(F.col("chars"), F.col("words")).alias("chars_per_word"), X.safe_divide(F.col("chars"), F.col("zero")).alias("none"), long(X.half_even(F.col("chars").cast("decimal(20,2)") / 8, 0)).alias("rounded"))


def parameter_counts(spark, sf):
    rows = [(768, 12, 4, 64, 2048, 32768, 8, True, True), (512, 8, 8, 64, 1536, 32000, 6, False, False), (1024, 16, 4, 64, 2816, 50257, 24, True, False)]
    return parameters(spark.createDataFrame(rows, "hidden long, heads long, kv_heads long, head_dim long, inner long, vocab long, layers long, qk_norm boolean, tied boolean")).select("hidden", "layers", "attention_per_layer", "mlp_per_layer", "qk_norm_per_layer", "block_per_layer", "transformer_total", "embedding", "output_head", "total")


# ---- filters


def line_quality_counts(spark, sf):
    return lines(spark, sf).groupBy(C.passes(LINES, F.col("line")).alias("passes")).agg(F.count("*").alias("n"))


def raw_line_quality(spark, sf):
    src = C.document_lines(docs(spark, sf))
    return src.where(F.col("raw") != "").groupBy(C.passes(C.ANY_LINES, F.col("raw")).alias("passes")).agg(F.count("*").alias("n"))


def document_length_window(spark, sf):
    kept = docs(spark, sf).select("doc_id", X.normalized(F.col("text")).alias("line")).where(C.passes(C.DOCUMENTS, F.col("line")))
    return kept.select("doc_id", long(F.char_length("line")).alias("n"))


def script_ratio_filter(spark, sf):
    return docs(spark, sf).where(X.script_ratio(F.col("text"), "latin") >= 0.95).groupBy("lang").agg(F.count("*").alias("n"))


def heading_and_fallback(spark, sf):
    c = table(spark, sf, "conversations").withColumn("output", F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.col("text")))
    t = X.first_filled(F.col("output"), F.col("role"))
    return c.where(~F.col("text").startswith("=")).groupBy(t.isin("user", "assistant", "system").alias("fell_back")).agg(F.count("*").alias("n"))


def idempotency_check(spark, sf):
    return R.not_idempotent(docs(spark, sf), "text", ["doc_id"], 500).select("checked", "mismatches")


def normalization_reasons(spark, sf):
    return R.change_report(docs(spark, sf), "text", ["doc_id"])


def normalization_totals(spark, sf):
    return R.change_totals(docs(spark, sf), "text")


# ---- deduplication and decontamination


def exact_dedup_docs(spark, sf):
    return C.first_of_each(docs(spark, sf).select("doc_id", "text"), X.digest(F.col("text")), ["doc_id"]).select("doc_id")


def exact_dedup_lines(spark, sf):
    return C.first_of_each(lines(spark, sf).select("doc_id", "pos", "line"), X.digest(F.col("line")), ["doc_id", "pos"]).select("doc_id", F.col("pos").cast("long").alias("pos"))


def duplicate_rate_by_source(spark, sf):
    d = docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(X.digest(F.col("text"))).alias("distinct_n"))
    return d.select("source", "n", (F.col("n") - F.col("distinct_n")).alias("duplicates"), X.safe_divide(F.col("n") - F.col("distinct_n"), F.col("n")).alias("rate"))


def cross_category_dedup(spark, sf):
    src = lines(spark, sf, "lang")
    place = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "en", 1).otherwise(2)
    kept = C.first_of_each(src.withColumn("place", place), X.digest(F.col("line")), ["place", "doc_id", "pos"])
    return kept.groupBy("lang").agg(F.count("*").alias("n"))


def dedup_across_runs(spark, sf):
    src = docs(spark, sf).select("doc_id", X.digest(F.col("text")).alias("digest"))
    before, now = src.where("doc_id % 2 = 0"), src.where("doc_id % 2 = 1")
    fresh = C.not_in(now, before, "digest")
    return C.first_of_each(fresh, F.col("digest"), ["doc_id"]).select("doc_id")


def duplicate_keys(spark, sf):
    return C.repeated(docs(spark, sf).select("doc_id", "source", "n_chars"), "n_chars", ["doc_id"]).select("doc_id", "n_chars")


def decontaminate_lines(spark, sf):
    marked = lines(spark, sf).withColumn("digest", X.digest(F.col("line")))
    return C.not_in(marked, eval_lines(spark, sf), "digest").groupBy("doc_id").agg(F.count("*").alias("kept"))


def train_overlap(spark, sf):
    hashed = docs(spark, sf).select("doc_id", X.digest(C.stored(F.col("text"))).alias("digest"))
    train, held = hashed.where("doc_id % 10 <> 0"), hashed.where("doc_id % 10 = 0")
    return C.not_in(held, train, "digest").select("doc_id")


def distinct_digests(spark, sf):
    blocked = eval_lines(spark, sf).select("digest")
    seen = C.digests(lines(spark, sf))
    return blocked.union(seen).distinct().agg(F.count("*").alias("n"))


def category_union(spark, sf):
    d = docs(spark, sf)
    both = d.where("lang = 'en'").select("doc_id", "lang").unionByName(d.where("lang = 'fr'").select("lang", "doc_id"))
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


# ---- verdicts and stops


def verdict_counters(spark, sf):
    return counted(judged(spark, sf))


def verdict_counters_by_source(spark, sf):
    return C.counters(judged(spark, sf, "source"), "source")


def accept_until_target_exact(spark, sf):
    return counted(C.until(narrow(spark, sf), 2000, order=["doc_id", "pos"]))


def accept_until_target_row(spark, sf):
    return counted(C.until(narrow(spark, sf), 2000, order=["doc_id", "pos"], document="doc_id"))


def document_build(spark, sf):
    """Whole documents with one counter for duplicates and blocked ones."""
    src = docs(spark, sf).select("doc_id", F.col("text").alias("raw"), X.normalized(F.col("text")).alias("line"))
    blocked = C.digests(src.where("doc_id % 50 = 7"))
    j = C.verdicts(src, blocked, C.DOCUMENTS, order=["doc_id"])
    return j.agg(F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.count_if(F.col("verdict").isin("eval", "duplicate")).alias("duplicates_or_eval"), F.count_if(F.col("verdict") == "quality").alias("invalid_length_or_type"))


def heldout_build(spark, sf):
    """Chunks of held-out documents: duplicate, then blocked, then seen in training."""
    held = docs(spark, sf).where("doc_id % 10 = 0").select("doc_id", F.posexplode(P.chunks(X.normalized(F.col("text")))).alias("pos", "line")).withColumn("raw", F.col("line"))
    train = C.digests(docs(spark, sf).where("doc_id % 10 <> 0").select(F.explode(P.chunks(X.normalized(F.col("text")))).alias("line")))
    j = C.verdicts(held, train, C.DOCUMENTS, order=["doc_id", "pos"], name="train_overlap")
    return counted(j, ["accepted", "duplicate", "train_overlap"])


def heldout_build_limited(spark, sf):
    """As heldout_build, up to the 50th accepted chunk: what comes after it isn't counted."""
    held = docs(spark, sf).where("doc_id % 10 = 0").select("doc_id", F.posexplode(P.chunks(X.normalized(F.col("text")))).alias("pos", "line")).withColumn("raw", F.col("line"))
    train = C.digests(docs(spark, sf).where("doc_id % 10 <> 0").select(F.explode(P.chunks(X.normalized(F.col("text")))).alias("line")))
    j = C.verdicts(held, train, C.DOCUMENTS, order=["doc_id", "pos"], name="train_overlap").select("doc_id", "pos", "verdict")
    return counted(C.until(stash(j, "verdicts"), 50, order=["doc_id", "pos"]), ["accepted", "duplicate", "train_overlap"])


def first_of_category(spark, sf):
    d = docs(spark, sf)
    return d.where("lang = 'de'").select("doc_id", "lang").orderBy("doc_id").limit(25).unionByName(d.where("lang = 'es'").select("doc_id", "lang").orderBy("doc_id").limit(25))


# ---- pieces


def chunk_documents(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(P.chunks(F.col("text"), limit=1000)).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long").alias("pos"), long(F.char_length("chunk")).alias("n"), X.fingerprint(F.col("chunk")).alias("sha"))


def chunk_documents_cumulative(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(P.chunks(F.col("text"), packing="cumulative")).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long").alias("pos"), long(F.char_length("chunk")).alias("n"))


def byte_budget_sample(spark, sf):
    return P.head_by_bytes(lines(spark, sf).select("doc_id", "pos", "line"), 200_000, ["doc_id", "pos"]).agg(F.count("*").alias("n"), F.sum(P.line_bytes(F.col("line"))).alias("bytes"))


def tail_lines(spark, sf):
    return P.tail_by_bytes(lines(spark, sf).select("doc_id", "pos", "line"), 50_000, 40, ["doc_id", "pos"]).select("doc_id", F.col("pos").cast("long").alias("pos"))


def proportional_sample(spark, sf):
    src = lines(spark, sf, "lang")
    return P.sample_by_share(stash(src.select("doc_id", "pos", "lang", "line"), "lines"), 300_000, "lang", ["doc_id", "pos"]).groupBy("lang").agg(F.count("*").alias("n"), F.sum(P.line_bytes(F.col("line"))).alias("bytes"))


def train_val_split(spark, sf):
    return P.split_in_order(docs(spark, sf).select("doc_id", "n_chars"), 0.95, ["doc_id"]).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"))


def shard_manifest(spark, sf):
    return R.shard_manifest(P.in_shards(lines(spark, sf).select("doc_id", "pos", "line"), 1000, ["doc_id", "pos"]), "line", ["doc_id", "pos"])


def running_totals(spark, sf):
    return O.running(docs(spark, sf).select("doc_id", "n_chars"), ["doc_id"], {"chars_so_far": F.col("n_chars")}).select("doc_id", "chars_so_far")


def token_windows(spark, sf):
    stream = docs(spark, sf).select(F.col("doc_id").alias("pos"), F.col("n_chars").alias("token_id"))
    return P.windows(stream, 16, 64).select("window", F.array_join(F.col("x").cast("array<string>"), ",").alias("x"), F.array_join(F.col("y").cast("array<string>"), ",").alias("y"))


def token_stream_windows(spark, sf):
    """Windows of the token stream of whole documents; token_windows, bound to its SQL, takes a number of each document for a token."""
    import public_tokenizers

    stream = K.token_stream(docs(spark, sf).select("doc_id", "text"), "text", public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
    return P.windows(stream, 16, 64).select("window", F.array_join(F.col("x").cast("array<string>"), ",").alias("x"), F.array_join(F.col("y").cast("array<string>"), ",").alias("y"))


# ---- reports


def text_profile_by_lang(spark, sf):
    return R.text_profile(lines(spark, sf, "lang"), "line", ["lang"], "latin")


def profile_status(spark, sf):
    return R.verdict_of(R.text_profile(docs(spark, sf), "text", ["source"], "latin")).select("source", "duplicate_lines", "status")


def length_percentiles(spark, sf):
    n = F.col("n")
    return R.length_ranks(docs(spark, sf), "n_chars", ["lang"], {"p50": F.floor(n / 2), "p90": F.floor(n * 0.9)})


def source_balance(spark, sf):
    return R.shares(docs(spark, sf).groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "source")


def language_ratio(spark, sf):
    return R.ratio_of(docs(spark, sf).groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "lang", "en", "fr")


def category_manifest(spark, sf):
    return R.group_manifest(lines(spark, sf).withColumn("category", X.language(F.col("line"))), "line", "category", ["ar", "en", "mixed", "other"])


def manifest_comparison(spark, sf):
    m = R.group_manifest(docs(spark, sf), "text", "lang", ["de", "en", "es", "fr"])
    other = m.where("lang <> 'es'").withColumn("line_count", F.when(F.col("lang") == "de", F.col("line_count") + 1).otherwise(F.col("line_count")))
    return R.compared(stash(m, "m"), stash(other, "m"), "lang", ["line_count", "bytes"])


def metrics_side_by_side(spark, sf):
    m = docs(spark, sf).groupBy("lang", (F.col("doc_id") % 2).alias("version")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return R.side_by_side(m, "lang", "version", 0, 1, ["docs", "chars"])


def contamination_report(spark, sf):
    stats = C.counters(judged(spark, sf)).agg(F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("m"))
    m = stats.select(F.create_map(F.lit("eval_overlap"), F.col("m")["eval"], F.lit("dup"), F.col("m")["duplicate"], F.lit("accepted"), F.col("m")["accepted"]).alias("stats"), F.lit(None).cast("long").alias("train_hashes_checked"))
    return R.contamination(m)


def worst_lines(spark, sf):
    score = X.safe_divide(F.char_length("line"), F.size(X.words(F.col("line"))))
    return R.worst(lines(spark, sf), score, 5, ["doc_id", "pos"], "line").select("doc_id", F.col("pos").cast("long").alias("pos"), "score", "head")


def pretoken_counts(spark, sf):
    return K.pretoken_counts(docs(spark, sf), "text")


def tokenizer_metrics(spark, sf):
    import public_tokenizers

    return K.measured(docs(spark, sf), "text", public_tokenizers.path("byte_bpe_50k.json"), ["lang"])


def token_stream(spark, sf):
    import public_tokenizers

    stream = K.token_stream(docs(spark, sf).select("doc_id", "text"), "text", public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
    return P.split_stream(stream, 0.95).groupBy("split").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"), F.sum("token_id").alias("ids"))


# ---- gates, on rows given here

REGISTRY = [
    ("web_a", "ar", "web", "ODC-By-1.0", "public dump", "approved"),
    ("wiki_b", "ar", "encyclopedic", "CC-BY-SA-4.0", "public dump", "approved"),
    ("code_c", "code", "code", "CC-BY-NC-4.0", "UNVERIFIED", "approved"),
    ("news_d", "en", "news", "Custom", "publisher", "approved"),
    ("news_d", "en", "news", "MIT", "publisher", "conditional_review"),
    ("old_e", "", "web", "MIT", "somewhere", "retired"),
]
REGISTRY_SCHEMA = "source_id string, language string, role string, license string, provenance string, status string, line_no long"
DOMAINS = [("web", 0.5, [("blogs", ["msa", "en"]), ("forums", ["xx"])]), ("news", 0.4, [("blogs", ["en"]), ("sports", [])]), ("web", -1.0, []), ("books", 0.1, [("novels", ["en"])])]
RECORDS = [
    ("r1", "web", "blogs", "en", "web_a", "ODC-By-1.0", "public dump", "good text", None, True, G.INTENDED_USE),
    ("r1", "web", "blogs", "arz", "web_a", "MIT", "unknown", "good text", None, True, "training"),
    ("r3", "web", "nowhere", "en", "gone", "MIT", "x", "other text", 3, False, G.INTENDED_USE),
    (None, "books", "novels", "en", "code_c", "CC-BY-NC-4.0", "y", "a third", -1, None, G.INTENDED_USE),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, k + 1) for k, r in enumerate(REGISTRY)], REGISTRY_SCHEMA)


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([({"msa": "ar", "en": "en", "arz": "arz"}, DOMAINS)], "languages map<string,string>, domains array<struct<id: string, weight: double, subdomains: array<struct<id: string, languages: array<string>>>>>")


def records(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(*r, k + 1) for k, r in enumerate(RECORDS)], "record_id string, domain string, subdomain string, language string, source_id string, license string, provenance string, text string, off int, pilot boolean, intended_use string, line_no long")
    return df.withColumn("text_sha256", X.fingerprint(F.when(F.col("off") == 3, F.lit("else")).otherwise(F.col("text")))).withColumn("text_chars", F.coalesce("off", F.char_length("text"))).drop("off")


def registry_gate(spark, sf):
    return G.registry_gate(registry(spark))


def registry_split(spark, sf):
    return G.registry_split(registry(spark)).select(F.array_join("approved", ",").alias("approved"), F.array_join("not_ingestable", ",").alias("not_ingestable"))


def ingest_permission(spark, sf):
    asked = spark.createDataFrame([("web_a",), ("wiki_b",), ("old_e",), ("gone",)], "source_id string")
    return G.may_ingest(asked, registry(spark), ["web_a", "old_e"])


def license_rules(spark, sf):
    return registry(spark).select("line_no", G.license_allowed(F.col("license")).alias("allowed"), G.license_forbidden(F.col("license")).alias("forbidden"))


def taxonomy_gate(spark, sf):
    return G.taxonomy_gate(taxonomy(spark))


def taxonomy_size(spark, sf):
    return G.taxonomy_size(taxonomy(spark))


def pilot_gate(spark, sf):
    return G.record_gate(records(spark), taxonomy(spark), registry(spark))


def gate_status(spark, sf):
    return G.status(registry_gate(spark, sf))


# ---- the driver's other tables


def role_balance(spark, sf):
    return R.shares(table(spark, sf, "conversations").groupBy("role").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "role")


def conversation_stats(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.size(X.words(F.col("text"))).cast("long")).alias("words"))


def label_join_quality(spark, sf):
    return docs(spark, sf).select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def html_text_lines(spark, sf):
    plain = F.regexp_replace(F.regexp_replace("html", r"<script>[^<]*</script>|<style>[^<]*</style>", " "), r"<[^>]*>", "\n")
    return table(spark, sf, "pages").select("page_id", F.explode(F.split(plain, "\n")).alias("l")).where(X.strip(F.col("l")) != "").groupBy("page_id").agg(F.count("*").alias("n_lines"))


def incremental_dedup(spark, sf):
    """Documents as a stream of files; distinct texts kept, whichever batch brings them."""
    from ..streaming.ingest import distinct_lines
    from ..tables import fresh_path

    source, out, checkpoint = (fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    given = docs(spark, sf)
    files = max(4, given.rdd.getNumPartitions())  # they grow in number, not in size; half of them are a batch
    given.repartition(files, "doc_id").write.parquet(source)
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(source)
    kept = distinct_lines(stream, LINES).select("line", F.hex("digest").alias("digest"))
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.sum(F.char_length("line").cast("long")).alias("chars"))


_HELPERS = {"docs", "lines", "eval_lines", "judged", "narrow", "counted", "long", "registry", "taxonomy", "records", "table", "stash", "spread", "parameters", "queries"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _HELPERS}
