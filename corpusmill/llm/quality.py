"""Quality by importance resampling.

Two generative models over hashed n-grams (words and runs of symbols, alone and in pairs): a target model from good labelled documents, and a raw model from all
documents. A document's weight is the ratio of its probabilities under the two. Documents are sampled by Gumbel top-k: each log weight gets
Gumbel noise, drawn from its id, and the k largest stay. k is how many documents weigh more than a cut, which labelled documents outside the target model calibrate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT, map_texts, raw, settle, stash
from .sharding import find_splitters
from .words import doc_of, mix, token_hashes

BUCKETS = 1 << 17
#: The target model and the cut are fitted on so many labelled documents at most; their ids may be broadcast.
LABELLED_ROWS = 200_000
#: Pseudo-counts that draw the target model to the raw one where the target has little.
SMOOTHING = 4.0
#: How much worse it is to reject a good document than to keep a bad one.
KEEP_GOOD = 10.0


def grams(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each n-gram."""
    h, first = token_hashes(*raw(texts))
    doc = doc_of(first)
    both = doc[1:] == doc[:-1]
    pairs = mix(h[:-1] + h[1:] * np.uint64(3))[both]
    return (np.concatenate([mix(h), pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[:-1][both]])


def count_grams(docs: DataFrame, text: str, weight: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all documents, and over those whose column weight is true. A task sums its own documents before anything is exchanged."""
    settle(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(f"`{weight}`"), F.lit(False)).alias("w"), F.col(f"`{text}`").cast("string").alias(TEXT))

    def run(batches):
        every, chosen = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        from .common import slices

        for b in batches:
            for begin, end in slices(b.column(1)):
                bucket, doc = grams(b.column(1).slice(begin, end - begin), buckets)
                every += np.bincount(bucket, minlength=buckets)
                mine = b.column(0).slice(begin, end - begin).to_numpy(zero_copy_only=False).astype(bool)[doc]
                chosen += np.bincount(bucket[mine], minlength=buckets)
        some = np.flatnonzero(every)
        for k in range(0, len(some), 1 << 14):
            part = some[k : k + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(every[part]), pa.array(chosen[part])], names=["bucket", "every", "chosen"])

    counted = src.mapInArrow(run, "bucket int, every long, chosen long").groupBy("bucket").agg(F.sum("every"), F.sum("chosen")).collect()
    out = np.zeros((2, buckets))
    for bucket, every, chosen in counted:
        out[:, bucket] = every, chosen
    return out[0], out[1]


def log_ratios(every: np.ndarray, chosen: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of target over raw probability of each bucket; the target is smoothed by the raw model."""
    expected = every * (chosen.sum() / max(1.0, every.sum()))
    return np.log((chosen + smoothing) / (expected + smoothing)) if chosen.sum() else np.zeros(len(every))


def calibrated_cut(scores: list[tuple[float, bool]], keep_good: float = KEEP_GOOD) -> float:
    """The cut (weights from it on are good) of least cost on (score, good); without documents of both sorts, none is rejected."""
    ordered = sorted(scores)
    good, bad = sum(g for _, g in ordered), sum(not g for _, g in ordered)
    if not good or not bad:
        return float("-inf")
    best, cut, lost, caught = float(bad), float("-inf"), 0, 0
    for k, (s, g) in enumerate(ordered):
        lost, caught = lost + g, caught + (not g)
        cost = keep_good * lost / good * bad + bad - caught
        if cost < best and (k + 1 == len(ordered) or ordered[k + 1][0] > s):
            best, cut = cost, (s + ordered[k + 1][0]) / 2 if k + 1 < len(ordered) else float("inf")
    return cut


def gumbel(id: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def as_ordered_long(x: Column) -> Column:
    """A long that grows with a finite double, to 52 bits of sign, exponent and leading digits: by scaling, since noise makes keys spread evenly enough."""
    return F.round(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x)) * 4e9).cast("long")


def resample(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label_id: str = "doc_id", good: Column | None = None, bad: Column | None = None, k: int | None = None, seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """keep (only id if not given), log_weight, gumbel_key, and kept: whether the row is among the k of the largest keys.

    labels: good and bad are conditions on its rows (quality = 1 and toxic = 0; quality = 0). Without k, the calibrated cut gives it; without labels of both sorts all
    rows stay. A null or empty text weighs 0 (log). Rows of one id get the same noise, and rows of the same key stay or go together. Labels with a null id say nothing;
    contradicting labels of one id count as the least of them. A column of keep named as a result gives way.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) if good is None else good
    bad = F.col("quality") == 0 if bad is None else bad
    keep = [c for c in ([id] if keep is None else keep) if c not in ("log_weight", "gumbel_key", "kept")]
    known = labels.select(F.col(f"`{label_id}`").alias("__label_id"), F.when(good, 1).when(bad, 0).alias("__good")).where("__label_id IS NOT NULL AND __good IS NOT NULL").groupBy("__label_id").agg(F.min("__good").alias("__good"))
    known = stash(known, "labels")
    n = known.count()
    cells = 1 << 20
    sample = known.where(F.pmod(F.xxhash64("__label_id"), F.lit(cells)) < max(1, min(cells, cells * LABELLED_ROWS // max(1, n)))).limit(2 * LABELLED_ROWS)
    # half of the sample makes the target model, the other half the cut
    sample = sample.withColumn("__fits", F.pmod(F.xxhash64("__label_id", F.lit(1)), F.lit(2)) == 0)
    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, id])], F.col(f"`{text}`").cast("string").alias(TEXT)) if text not in keep else docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, id])]).withColumn(TEXT, F.col(f"`{text}`").cast("string"))
    marked = src.join(F.broadcast(sample), F.col(f"`{id}`") == F.col("__label_id"), "left").withColumn("__target", F.col("__fits") & (F.col("__good") == 1)).withColumn("__held", F.when(~F.col("__fits"), F.col("__good")))
    ratios = log_ratios(*count_grams(marked, TEXT, "__target"))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        table = shared.value

        def weigh(texts: pa.Array) -> list:
            bucket, doc = grams(texts, len(table))
            return [np.bincount(doc, table[bucket], len(texts)).astype(np.float64)]

        return weigh

    weighed = map_texts(marked, TEXT, [*dict.fromkeys([*keep, id]), "__held"], [T.StructField("log_weight", T.DoubleType())], make)
    # written with what is kept, so that no text is read a third time
    weighed = stash(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col(f"`{id}`"), seed)), "weights")
    narrow = weighed.select("log_weight", "gumbel_key", "__held")
    total = narrow.count()
    if k is None:
        cut = calibrated_cut([(r[0], bool(r[1])) for r in narrow.where("__held IS NOT NULL").select("log_weight", "__held").collect()])
        k = narrow.where(F.col("log_weight") >= cut).count() if cut > float("-inf") else total
    if k >= total:
        chosen = F.lit(True)
    elif k <= 0:
        chosen = F.lit(False)
    else:
        keyed = narrow.select(as_ordered_long(F.col("gumbel_key")).alias("__key"), F.lit(1).alias("__size"))
        ((threshold, _, _),) = find_splitters(keyed, [(total - k, 0.0)], 12)
        chosen = as_ordered_long(F.col("gumbel_key")) >= threshold
    return weighed.select(*[F.col(f"`{c}`") for c in keep], "log_weight", "gumbel_key", chosen.alias("kept"))
