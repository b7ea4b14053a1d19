"""Profiles of a corpus: counts, lengths, shares, manifests and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import stash


def length_ranks(rows: DataFrame, length: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """For each group the length at given ranks (from 0; expressions over n, the group's size). Rows are first counted by length, so a group is no task of
    its own however large it is."""
    counted = rows.groupBy(*by, length).agg(F.count("*").alias("c"))
    up_to = Window.partitionBy(*by).orderBy(length).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    summed = counted.withColumn("__to", F.sum("c").over(up_to)).withColumn("n", F.sum("c").over(whole))
    at = [F.max(F.when((F.col("__to") - F.col("c") <= r) & (r < F.col("__to")), F.col(length))).alias(name) for name, r in ranks.items()]
    return summed.groupBy(*by).agg(*at)


def text_profile(texts: DataFrame, text: str, by: list[str], script: str = "arabic", normalize: bool = False) -> DataFrame:
    """For each group of texts (none empty): lines, length figures, characters of a script, words, distinct words, repeated texts, broken UTF-8, odd white space.

    Medians are the element at half the count of the sorted lengths, p90 that at nine tenths. Groups without texts have no row; without groups (by empty) no texts give a row
    of lines 0 and nothing else. normalize: texts are normalized first. They are written once, as they are counted, so that no aggregate works them out again.
    """
    given, by = by, by or ["__all"]
    src = (texts if given else texts.withColumn("__all", F.lit(0))).select(*by, (X.normalized(F.col(text)) if normalize else F.col(text)).alias("t")).where("t <> ''").select("*", F.char_length("t").cast("long").alias("n_chars"))
    src = stash(src, "profile")
    whole = src.groupBy(*by).agg(
        F.count("*").alias("lines"),
        F.sum("n_chars").alias("chars"),
        F.min("n_chars").alias("min_len"),
        F.max("n_chars").alias("max_len"),
        F.sum(X.counted(F.col("t"), X.SCRIPTS[script]).cast("long")).alias("script_chars"),
        F.sum(F.size(X.words(F.col("t"))).cast("long")).alias("words"),
        F.sum((~F.is_valid_utf8("t")).cast("long")).alias("invalid_utf8"),
        F.sum(X.odd_whitespace(F.col("t")).cast("long")).alias("whitespace_anomalies"),
    )
    distinct_words = src.select(*by, F.explode(F.array_distinct(X.words(F.col("t")))).alias("w")).distinct().groupBy(*by).agg(F.count("*").alias("unique_words"))
    distinct_texts = src.select(*by, X.digest(F.col("t")).alias("d")).distinct().groupBy(*by).agg(F.count("*").alias("distinct_lines"))
    n = F.col("n")
    lengths = length_ranks(src, "n_chars", by, {"p50_len": F.floor(n / 2), "p90_len": F.floor(n * 0.9)})

    out = whole
    for other in (distinct_words, distinct_texts, lengths):
        out = out.join(other, by, "left")
    made = out.select(
        *given,
        "lines",
        X.safe_divide(F.col("chars"), F.col("lines")).alias("mean_len"),
        "min_len",
        "p50_len",
        "p90_len",
        "max_len",
        "chars",
        X.safe_divide(F.col("script_chars"), F.col("chars")).alias("script_character_ratio"),
        "words",
        F.coalesce("unique_words", F.lit(0).cast("long")).alias("unique_words"),
        X.safe_divide(F.coalesce("unique_words", F.lit(0)), F.col("words")).alias("unique_word_ratio"),
        (F.col("lines") - F.col("distinct_lines")).alias("duplicate_lines"),
        X.safe_divide(F.col("lines") - F.col("distinct_lines"), F.col("lines")).alias("duplicate_rate"),
        "invalid_utf8",
        "whitespace_anomalies",
    )
    if given or src.limit(1).count():
        return made
    nothing = src.sparkSession.createDataFrame([(0,)], "lines long")
    return nothing.select(*[F.col("lines") if f.name == "lines" else F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema])


def verdict_of(profile: DataFrame) -> DataFrame:
    """profile with status: PASS without repeated lines and broken UTF-8."""
    return profile.withColumn("status", F.when((F.col("duplicate_lines") == 0) & (F.col("invalid_utf8") == 0), "PASS").otherwise("FAIL"))


def shares(sized: DataFrame, group: str, size: str = "bytes") -> DataFrame:
    """Each group's share of the sum of sizes; 0 if the sum is. sized has a row for each group, so it is small."""
    total = F.sum(size).over(Window.partitionBy(F.lit(0)))
    return sized.select(group, size, X.safe_divide(F.col(size), total).alias("share"))


def ratio_of(shared: DataFrame, group: str, a: str, b: str, size: str = "bytes") -> DataFrame:
    """One row: shares of a and b, and a by b (0 if b has none)."""
    part = lambda g: F.coalesce(F.sum(F.when(F.col(group) == g, F.col(size))), F.lit(0))
    total = F.coalesce(F.sum(size), F.lit(0))
    return shared.agg(X.safe_divide(part(a), total).alias(f"{a}_share"), X.safe_divide(part(b), total).alias(f"{b}_share"), X.safe_divide(part(a), part(b)).alias("ratio"))


def change_report(texts: DataFrame, text: str, order: list[str]) -> DataFrame:
    """For each step of normalization: how many texts it alters, and the beginning of the first. Steps that alter none have a row as well; blank texts are left out."""
    src = texts.where(X.strip(F.col(text)) != "").select(*order, X.head(F.col(text), 70).alias("head"), X.changes(F.col(text)).alias("reasons"))
    found = src.select("*", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.min_by("head", F.struct(*order)).alias("example"))
    steps = texts.sparkSession.createDataFrame([(r,) for r in ("nfkc", "tatweel", "diacritics", "whitespace")], "reason string")
    return steps.join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "example")


def change_totals(texts: DataFrame, text: str) -> DataFrame:
    """samples, changed, unchanged and changed_rate over texts that aren't blank."""
    src = texts.where(X.strip(F.col(text)) != "").select((X.normalized(F.col(text)) != F.col(text)).cast("long").alias("c"))
    return src.agg(F.count("*").alias("samples"), F.coalesce(F.sum("c"), F.lit(0)).alias("changed")).select("samples", "changed", (F.col("samples") - F.col("changed")).alias("unchanged"), X.safe_divide(F.col("changed"), F.col("samples")).alias("changed_rate"))


def not_idempotent(texts: DataFrame, text: str, order: list[str], first: int) -> DataFrame:
    """Of the first so many texts that aren't blank: how many were checked, how many normalizing alters, and the beginning of the first such."""
    src = texts.where(X.strip(F.col(text)) != "").select(*order, F.col(text).alias("__text")).orderBy(*order).limit(first)
    off = X.normalized(F.col("__text")) != F.col("__text")
    return src.agg(F.count("*").alias("checked"), F.count_if(off).alias("mismatches"), F.min_by(F.when(off, X.head(F.col("__text"), 80)), F.when(off, F.struct(*order))).alias("example"))


def shard_manifest(rows: DataFrame, line: str, order: list[str], by: str = "shard") -> DataFrame:
    """For each shard: lines, characters, bytes, and the SHA-256 of its file (lines in order, each ended by LF). A shard is as large as a file should be: one task's work."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("__line")))), lambda r: r["__line"])
    return rows.groupBy(by).agg(
        F.count("*").alias("line_count"),
        F.sum(F.char_length(line).cast("long")).alias("char_count"),
        F.sum(F.octet_length(line).cast("long") + 1).alias("bytes"),
        X.fingerprint(F.concat(F.array_join(inside, "\n"), F.lit("\n"))).alias("sha256"),
    )


def group_manifest(rows: DataFrame, line: str, by: str, groups: list[str]) -> DataFrame:
    """For each of the groups, empty ones too: lines, words, characters and bytes."""
    found = rows.groupBy(by).agg(F.count("*").alias("line_count"), F.sum(F.size(X.words(F.col(line))).cast("long")).alias("word_count"), F.sum(F.char_length(line).cast("long")).alias("char_count"), F.sum(F.octet_length(line).cast("long") + 1).alias("bytes"))
    names = rows.sparkSession.createDataFrame([(g,) for g in groups], f"{by} string")
    return names.join(found, by, "left").na.fill(0, ["line_count", "word_count", "char_count", "bytes"])


def compared(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each key and column in which expected and actual differ; a key that one side lacks differs in presence."""
    both = expected.withColumn("__e", F.lit(True)).alias("e").join(actual.withColumn("__a", F.lit(True)).alias("a"), key, "full_outer")
    text = lambda c: c.cast("string")
    tests = [F.struct(F.lit("present").alias("column"), text(F.col("__e")).alias("expected"), text(F.col("__a")).alias("actual"), (~F.col("__e").eqNullSafe(F.col("__a"))).alias("differs"))]
    tests += [F.struct(F.lit(c).alias("column"), text(F.col(f"e.{c}")).alias("expected"), text(F.col(f"a.{c}")).alias("actual"), (F.col("__e") & F.col("__a") & ~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))).alias("differs")) for c in columns]
    return both.select(key, F.explode(F.array(*tests)).alias("t")).where("t.differs").select(key, "t.column", "t.expected", "t.actual")


def side_by_side(metrics: DataFrame, key: str, which: str, old: str, new: str, columns: list[str]) -> DataFrame:
    """Metrics of two versions in one row for each key: old_x, new_x."""
    a, b = (metrics.where(F.col(which) == v).select(key, *[F.col(c).alias(f"{n}_{c}") for c in columns]) for v, n in ((old, "old"), (new, "new")))
    return a.join(b, key, "full_outer")


def contamination(manifests: DataFrame) -> DataFrame:
    """From stats (a map of counters) and train_hashes_checked: overlaps rejected, in sum and each; missing counters are 0."""
    of = lambda k: F.coalesce(F.col("stats")[k], F.lit(0).cast("long"))
    return manifests.select(of("train_overlap").alias("train_overlap_rejected"), of("eval_overlap").alias("eval_overlap_rejected"), F.coalesce("train_hashes_checked", F.lit(0).cast("long")).alias("train_hashes_checked"), of("dup").alias("dup_rejected"), (of("train_overlap") + of("eval_overlap")).alias("contamination_count"), of("accepted").alias("heldout_lines_final"))


def worst(rows: DataFrame, score: Column, n: int, order: list[str], text: str) -> DataFrame:
    """The n rows of the highest score, ties by the order: score and the beginning of the text."""
    return rows.select(*order, score.alias("score"), X.head(F.col(text), 80).alias("head")).orderBy(F.desc("score"), *order).limit(n)
