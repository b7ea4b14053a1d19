"""Cutting texts and token streams: chunks, samples by bytes, heads and tails, splits, shards, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ordering import numbered, running


def sentences(text: Column) -> Column:
    """Pieces of a text's lines between '. ', stripped, none empty; all but a line's last keep their period."""

    def of_line(line: Column) -> Column:
        ended = lambda parts: F.transform(parts, lambda p, i: F.when((p != "") & (i < F.size(parts) - 1), F.concat(p, F.lit("."))).otherwise(p))
        return F.filter(X.let(F.transform(F.split(line, r"\. "), X.strip), ended), lambda p: p != "")

    found = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    return F.flatten(F.transform(F.filter(F.transform(found, X.strip), lambda x: x != ""), of_line))


def chunks(text: Column, *, limit: int = 8_000, least: int = 40, packing: str = "greedy") -> Column:
    """A text's sentences, joined by spaces into chunks of least to limit characters; others are dropped. Null has none.

    greedy fills each chunk as far as it goes. cumulative counts what a chunk holds anew with every sentence added, so sizes grow with the square of
    their number and chunks close early; corpora that were cut so can be matched with it. Sentences are dealt by their lengths first, so each is copied once.
    """
    if packing not in ("greedy", "cumulative"):
        raise ValueError(f"packing is greedy or cumulative, not {packing}")
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("held"), zero.alias("size"), zero.alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("begins"))

    def add(a: Column, n: Column) -> Column:
        new = (a["at"] == 0) | (a["size"] + n + 1 > limit)
        held = F.when(new, n).otherwise(a["held"] + 1 + n)
        # the first sentence opens a chunk that nothing was counted for
        size = F.when(new, n).otherwise(held + (a["size"] if packing == "cumulative" else 0))
        return F.struct(held.alias("held"), size.alias("size"), (a["at"] + 1).alias("at"), F.when(new, F.concat(a["begins"], F.array(a["at"] + 1))).otherwise(a["begins"]).alias("begins"))

    def cut(parts: Column) -> Column:
        begins = F.aggregate(F.transform(parts, lambda p: F.char_length(p).cast("long")), start, add, lambda a: F.concat(a["begins"], F.array(a["at"] + 1)))
        joined = lambda b: F.transform(F.slice(b, 1, F.size(b) - 1), lambda f, i: F.array_join(F.slice(parts, f.cast("int"), (F.get(b, i + 1) - f).cast("int")), " "))
        return X.let(begins, joined)

    return F.filter(X.let(sentences(text), cut), lambda c: F.char_length(c).between(least, limit))


def line_bytes(line: Column) -> Column:
    """Bytes of a line and its end in a file."""
    return (F.octet_length(line) + 1).cast("long")


def head_by_bytes(lines: DataFrame, budget: int, order: list[str], line: str = "line") -> DataFrame:
    """The whole lines that fit into so many bytes, up to the first that doesn't."""
    return running(lines, order, {"__bytes": line_bytes(F.col(line))}).where(F.col("__bytes") <= budget).drop("__bytes")


def tail_by_bytes(lines: DataFrame, budget: int, most: int | None, order: list[str], line: str = "line") -> DataFrame:
    """The whole lines of the last so many bytes, blank ones left out, of these the first most."""
    summed = running(lines, order, {"__bytes": line_bytes(F.col(line))})
    total = summed.agg(F.max("__bytes")).first()[0] or 0
    start = max(0, total - budget)
    # a line that the start falls into isn't whole; one that begins right there loses as well, since its beginning can't be told
    whole = summed.where((F.col("__bytes") - line_bytes(F.col(line)) > start) | F.lit(start == 0)).where(X.strip(F.col(line)) != "").drop("__bytes")
    return whole if not most else numbered(whole, order, "__n").where(F.col("__n") <= most).drop("__n")


def sample_by_share(lines: DataFrame, total: int, by: str, order: list[str], line: str = "line") -> DataFrame:
    """From each group (they are few: languages, sources) its head, of as many bytes as its share of total."""
    sizes = {r[0]: r[1] for r in lines.groupBy(by).agg(F.sum(line_bytes(F.col(line)))).collect()}
    out = None
    for group, size in sorted(sizes.items(), key=str):
        part = head_by_bytes(lines.where(F.col(by).eqNullSafe(F.lit(group))), total * size // sum(sizes.values()), order, line)
        out = part if out is None else out.unionByName(part)
    return lines.where("false") if out is None else out


def split_in_order(rows: DataFrame, share: float, order: list[str]) -> DataFrame:
    """rows with split: train for the first floor(n x share) of the order, validation for the rest."""
    ranked = numbered(rows, order, "__n")
    n = rows.count()
    return ranked.withColumn("split", F.when(F.col("__n") <= int(n * share), "train").otherwise("validation")).drop("__n")


def split_stream(stream: DataFrame, share: float) -> DataFrame:
    """As split_in_order, for rows that are numbered already: pos from 0 without gaps."""
    return stream.withColumn("split", F.when(F.col("pos") < int(stream.count() * share), "train").otherwise("validation"))


def in_shards(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """rows with shard: the first so many of the order are 0, the next 1, and so on; the last may be short."""
    ranked = numbered(rows, order, "__n")
    return ranked.withColumn("shard", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def windows(tokens: DataFrame, length: int, count: int, seed: int = 0) -> DataFrame:
    """count training windows of a token stream (pos from 0 without gaps, token_id): window, x (length ids) and y (the same, one further).

    A window's start follows from its number and the seed by a multiplicative hash, so it is the same however often it is made. Only the tokens of windows are exchanged.
    """
    n = tokens.count()
    if n < length + 1:
        return tokens.sparkSession.createDataFrame([], "window bigint, x array<bigint>, y array<bigint>")
    starts = tokens.sparkSession.range(count).select(F.col("id").alias("window"), ((F.col("id") * 2_654_435_761 + seed * 40_503 + 12_345) % (n - length)).alias("start"))
    wanted = starts.select("window", "start", F.explode(F.sequence("start", F.col("start") + length)).alias("pos"))
    got = wanted.join(tokens.select(F.col("pos").cast("long"), F.col("token_id").cast("long")), "pos")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda t: t["token_id"])
    return got.groupBy("window").agg(ids.alias("ids")).select("window", F.slice("ids", 1, length).alias("x"), F.slice("ids", 2, length).alias("y"))
