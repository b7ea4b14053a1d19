"""Building a corpus: lines, quality rules, exact deduplication, decontamination, verdicts, and where to stop.

One verdict column says what becomes of each line; counters, accepted lines and cut-offs are all read from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import stash
from .ordering import mark_first, running


@dataclass(frozen=True)
class Profile:
    """What a corpus accepts. Lengths are in characters; a script of None asks for none; on_raw tests lines before they are normalized."""

    least: int = 30
    most: int | None = 20_000
    script: str | None = "arabic"
    script_ratio: float = 0.5
    unique_words: float | None = 0.3
    on_raw: bool = False
    compatibility: bool = True


# The profiles' bounds.
ARABIC_LINES = Profile()
LATIN_LINES = Profile(script="latin")
ANY_LINES = Profile(most=None, script=None, on_raw=True)
DOCUMENTS = Profile(least=40, most=8_000, script=None, unique_words=None)


def document_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, pos (from 0) and raw line of every document; null texts have none."""
    return docs.select(F.col(id), F.posexplode(X.lines(F.col(text))).alias("pos", "raw"))


def passes(profile: Profile, line: Column) -> Column:
    """The quality rule; conditions stand from cheap to dear, and a failed one ends the test."""
    n = F.char_length(X.strip(line) if profile.on_raw else line)
    ok = n >= profile.least
    if profile.most is not None:
        ok = ok & (n <= profile.most)
    if profile.script:
        ok = ok & (X.script_ratio(line, profile.script) >= profile.script_ratio)
    if profile.unique_words is not None:
        ok = ok & (X.unique_ratio(X.words(line)) >= profile.unique_words)
    return ok


def normalized_lines(docs: DataFrame, profile: Profile, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, the columns keep of docs, pos, raw, line (normalized, none empty). NFKC runs once for each document: it never crosses a line boundary.

    Lines are normalized before they are taken apart, so what follows reads a column and doesn't work it out again for each rule.
    """
    id = [id, *(keep or [])]
    src = docs.select(*id, (X.nfkc(F.col(text)) if profile.compatibility and not profile.on_raw else F.col(text)).alias("__text"))
    if profile.on_raw and profile.compatibility:
        found = src.select(*id, F.posexplode(X.lines(F.col("__text"))).alias("pos", "raw")).select(*id, "pos", "raw", X.normalized(F.col("raw")).alias("line"))
        return found.where("line <> ''")
    both = F.transform(X.lines(F.col("__text")), lambda x: F.struct(x.alias("raw"), X.normalized(x, compatibility=False).alias("line")))
    return src.select(*id, F.posexplode(both).alias("pos", "l")).select(*id, "pos", "l.raw", "l.line").where("line <> ''")


def verdicts(lines: DataFrame, blocked: DataFrame | None, profile: Profile, *, order: list[str], order_of_tests: str = "quality,eval,duplicate", name: str = "eval") -> DataFrame:
    """lines with digest and verdict: quality, eval, duplicate or accepted.

    lines: raw, line and the order's columns. blocked: a column digest. A duplicate is a line that passes all other tests but is not the first of its text. With tests
    quality,duplicate,eval the same rows are accepted, since blocked lines never count as seen.
    """
    rule = passes(profile, F.col("raw") if profile.on_raw else F.col("line"))
    judged = lines.select("*", rule.alias("__q"), X.digest(F.col("line")).alias("digest"))
    if blocked is not None:
        known = stash(blocked.select("digest").distinct().withColumn("__hit", F.lit(True)), "blocked")
        judged = judged.join(known, "digest", "left").withColumn("__e", F.coalesce("__hit", F.lit(False))).drop("__hit")
    else:
        judged = judged.withColumn("__e", F.lit(False))
    eligible = F.col("__q") & ~F.col("__e")
    ranked = mark_first(judged.withColumn("__el", eligible), ["digest", "__el"], order, "__new")
    verdict = F.when(~F.col("__q"), "quality").when(F.col("__e"), name).when(~F.col("__new"), "duplicate").otherwise("accepted")
    return ranked.withColumn("verdict", verdict).drop("__q", "__e", "__el", "__new")


def digests(lines: DataFrame, column: str = "line") -> DataFrame:
    """Distinct digests of a column, for blocking."""
    return lines.select(X.digest(F.col(column)).alias("digest")).distinct()


def first_of_each(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Exact deduplication: of rows with equal keys the first in the order. The rank's limit is pushed below the exchange."""
    by = Window.partitionBy("__key").orderBy(*order)
    return df.withColumn("__key", key).withColumn("__rank", F.row_number().over(by)).where("__rank = 1").drop("__key", "__rank")


def not_in(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Anti join. The known side is written first: Spark then broadcasts it only if it is small, and can split a common key otherwise."""
    return df.join(stash(known.select(on).distinct(), "known"), on, "left_anti")


def repeated(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows after the first of each key that isn't null."""
    return mark_first(df.where(F.col(key).isNotNull()), [key], order, "__new").where("NOT __new").drop("__new")


def counters(judged: DataFrame, *by: str) -> DataFrame:
    return judged.groupBy(*by, "verdict").agg(F.count("*").alias("n"))


#: Up to so many accepted rows are found as the first of all, by one task from so many of each partition; more by running totals.
FIRST_ROWS = 10_000


def until(judged: DataFrame, target: int, *, order: list[str], document: str | None = None) -> DataFrame:
    """The rows up to the one that reaches so many accepted; with document, up to the end of its document. All of them if the target isn't reached.

    What lies behind isn't counted, so counters() of the result are those of a build that stops there. judged is read twice; a written table is best.
    """
    accepted = judged.where("verdict = 'accepted'").select(*order)
    if target <= FIRST_ROWS:
        end = accepted.orderBy(*order).limit(target).agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("last")).first()
        reached = end["last"] if end["n"] == target else None
    else:
        reached = running(accepted, order, {"__n": F.lit(1).cast("long")}).where(F.col("__n") == target).select(*order).first()
    if reached is None:
        return judged
    if document is not None:
        return judged.where(F.col(document) <= F.lit(reached[document]))
    # up to the row that reaches the target, in the order
    last = F.struct(*[F.lit(reached[k]).cast(judged.schema[k].dataType).alias(k) for k in order])
    return judged.where(F.struct(*order) <= last)


def stored(text: Column) -> Column:
    """How a text of several lines is kept on one; tidied again, so that normalizing it once more changes nothing."""
    return X.tidy_whitespace(X.flattened(text))
