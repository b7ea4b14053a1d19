"""Near-duplicates by ProbMinHash: weighted shingles, probability Jaccard, banding, verification.

An element of weight w is a Poisson process of rate w: its arrivals fall on the signature's slots, and each slot keeps the element that
arrives first. Two signatures then agree in a slot with the probability Jaccard similarity of the weighted sets. An element stops once its next arrival is
later than the latest first arrival of any slot.

Candidates share a band. Within a bucket every member is compared with one pivot, not with all others; that finds the links of groups of any
size. What a pivot can't decide is completed, without comparing all members: two texts of different components can be linked only if they share one of their rarest
shingles, or consist nearly wholly of common ones.

The bound. Let A be the weight of x's shingles that y lacks, X that of the others, B and Y the same of y. Each shared i adds 1 / (A/x_i + B/y_i + max(X/x_i, Y/y_i)) at
most, which is concave and homogeneous in (x_i, y_i), so the probability Jaccard is at most 1 / (1 + A/X + B/Y). Hence a text whose rarest shingles, unshared, weigh more than
1 - threshold of it has no link; and if only common shingles are shared, the ratios of uncommon to common weight of the two add up to 1/threshold - 1 at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, TEXT, explode_texts, forget, map_texts, raw, settle, slices, stash
from .components import components, sized
from .words import doc_of, mix, shingles, word_hashes

SLOTS, BAND = 160, 5
SHINGLE, SIMILARITY = 5, 0.8
#: What a pivot leaves open is estimated again with so many slots before texts are compared.
LONG_SLOTS = 1_024
#: Entries of a bucket that meet others in one group.
BLOCK = 256
#: A shingle that more of the texts left open have is a common one: to share it brings no two together.
COMMON = 256
_LOW = np.uint64((1 << 54) - 1)
FIELDS = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())]


def weighted(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 54-bit numbers, ascending, their counts, and each text's first. For at most 1024 texts."""
    if len(texts) > SLICE_ROWS:
        raise ValueError(f"{len(texts)} texts at once; their numbers have ten bits")
    words, first = word_hashes(*raw(texts))
    sh, at = shingles(words, first, k)
    key = np.sort((doc_of(at).astype(np.uint64) << np.uint64(54)) | (sh >> np.uint64(10)))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(key)))
    key = key[starts]
    begins = np.searchsorted(key, np.arange(len(texts), dtype=np.uint64) << np.uint64(54))
    return key & _LOW, counts, np.append(begins, len(key))


def weight(counts: np.ndarray) -> np.ndarray:
    """A shingle that a text repeats counts more, but not in proportion."""
    return 1 + np.log(counts)


def signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash: for each text (row) and slot the element whose process arrives first. Texts without elements have zeros."""
    n = len(first) - 1
    best, sig = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    doc, time, e, w = doc_of(first), np.zeros(len(elements)), elements, weights
    round_, burst = 0, 1
    while len(e):
        for _ in range(burst):
            x = mix(e + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            round_ += 1
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            at = doc * slots + (((mix(x) & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, at, time)
            won = time == best[at]
            sig[at[won]] = e[won]
        latest = best.reshape(n, slots).max(axis=1)
        go = time <= latest[doc]
        doc, time, e, w = doc[go], time[go], e[go], w[go]
        burst = 1 if len(e) > 20_000 else 8
    return sig.reshape(n, slots)


def band_hashes(sig: np.ndarray, rows: int = BAND) -> np.ndarray:
    bands = sig.shape[1] // rows
    h = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        h = mix(h + sig[:, j : bands * rows : rows] + np.uint64(j + 1))
    return mix(h + np.arange(bands, dtype=np.uint64)).view(np.int64)


def probability_jaccard(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """Exact: sum over shared i of 1 / sum over all j of max(a_j / a_i, b_j / b_i). Elements of equal pairs of counts count together."""
    if not len(a) or not len(b):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    only_a, only_b = np.ones(len(a), bool), np.ones(len(b), bool)
    only_a[ia] = only_b[ib] = False
    pair = lambda x, y: (x.astype(np.int64) << 31) | y
    zero = np.zeros(1, np.int64)
    kinds, n = np.unique(np.concatenate([pair(ca[ia], cb[ib]), pair(ca[only_a], zero), pair(zero, cb[only_b])]), return_counts=True)
    x, y = kinds >> 31, kinds & ((1 << 31) - 1)
    wa, wb = np.where(x > 0, weight(np.maximum(x, 1)), 0.0), np.where(y > 0, weight(np.maximum(y, 1)), 0.0)
    total = 0.0
    for i in np.flatnonzero((x > 0) & (y > 0)):
        total += n[i] / (n * np.maximum(wa / wa[i], wb / wb[i])).sum()
    return float(total)


def similarity(a: str | None, b: str | None) -> float:
    """Of two texts; 0 if one has no words."""
    e, c, f = weighted(pa.array([a or "", b or ""], pa.large_string()))
    return probability_jaccard(e[: f[1]], c[: f[1]], e[f[1] :], c[f[1] :])


def floor(threshold: float, slots: int) -> float:
    """An estimate from so many slots that a pair at the threshold falls below once in some million times."""
    return threshold - 5 * float(np.sqrt(threshold * (1 - threshold) / slots))


def bytes_of(sig: np.ndarray) -> list[bytes]:
    """A byte for each slot: enough to compare signatures, where one in 256 agrees by chance."""
    return [row.tobytes() for row in (mix(sig) >> np.uint64(56)).astype(np.uint8)]


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def longer(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, long_signature) for the texts (id, text) of ids."""

    def make():
        def run(batch: pa.Array) -> list:
            e, c, f = weighted(batch)
            return [bytes_of(signatures(e, weight(c), f, LONG_SLOTS))]

        return run

    return map_texts(texts.join(sized(ids), "id", "left_semi"), "text", ["id"], [T.StructField("long_signature", T.BinaryType())], make, 1 << 18)


def sketch(docs: DataFrame, id: str, text: str) -> DataFrame:
    def make():
        def run(texts: pa.Array) -> list:
            e, c, f = weighted(texts)
            sig = signatures(e, weight(c), f)
            counted = mix(e + c.astype(np.uint64))
            zero = np.zeros(1, np.uint64)
            sums = [np.concatenate([zero, np.cumsum(h, dtype=np.uint64)]) for h in (counted, mix(counted))]
            bands = band_hashes(sig)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1)))
            return [*((s[f[1:]] - s[f[:-1]]).view(np.int64) for s in sums), np.diff(f), lists, bytes_of(sig)]

        return run

    return map_texts(docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias(TEXT)), TEXT, ["id"], FIELDS, make)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact similarity, from the texts (id, text) of the ids in pairs only."""
    settle(pairs.sparkSession)
    needed = stash(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    own = stash(texts.join(sized(needed), "id", "left_semi"), "texts")
    both = pairs.join(own.withColumnsRenamed({"id": "b", "text": "tb"}), "b").join(own.withColumnsRenamed({"id": "a", "text": "ta"}), "a").select("a", "b", "ta", "tb")

    def compare(batches):
        for batch in batches:
            for begin, end in slices(pc.binary_join_element_wise(batch.column(2), batch.column(3), "")):
                b = batch.slice(begin, end - begin)
                ea, ca, fa = weighted(b.column(2))
                eb, cb, fb = weighted(b.column(3))
                sims = [probability_jaccard(ea[fa[i] : fa[i + 1]], ca[fa[i] : fa[i + 1]], eb[fb[i] : fb[i + 1]], cb[fb[i] : fb[i + 1]]) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(compare, "a long, b long, similarity double")


def shares(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingle, share of the text's weight) of the texts (id, text) of ids."""

    def make():
        def run(batch: pa.Array) -> tuple:
            e, c, f = weighted(batch)
            w, doc = weight(c), doc_of(f)
            return doc, e.view(np.int64), w / np.bincount(doc, w, len(batch))[doc]

        return run

    fields = [T.StructField("shingle", T.LongType()), T.StructField("share", T.DoubleType())]
    return explode_texts(texts.join(sized(ids), "id", "left_semi"), "text", ["id"], fields, make, 1 << 18)


def rare_pairs(tokens: DataFrame, members: DataFrame, threshold: float, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """(pairs, off). pairs (a, b): texts of different components (members: id, component) that share one of both's rarest shingles, no group of which is larger than common.
    off (id, off): for texts that may be linked by common shingles alone the ratio of their uncommon to their common weight.

    tokens: id, shingle, share. Of a text the rarest shingles count until they weigh more than 1 - threshold; those that no other text here has come first and need no partner.
    """
    often = stash(tokens.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "often")
    known = stash(tokens.join(sized(often), "shingle"), "known")
    is_common = F.col("n") > common
    on = F.sum(F.when(is_common, F.col("share")).otherwise(0.0))
    off = stash(known.groupBy("id").agg(on.alias("on")).where(F.col("on") >= threshold - 1e-9).select("id", ((1 - F.col("on")) / F.col("on")).alias("off")), "off")
    mine = Window.partitionBy("id")
    before = 1 - F.sum("share").over(mine) + F.sum("share").over(mine.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, 0)) - F.col("share")
    rarest = known.withColumn("before", before).where((F.col("before") <= 1 - threshold + 1e-9) & ~is_common).select("id", "shingle")
    groups = rarest.join(sized(members), "id").groupBy("shingle").agg(F.collect_list(F.struct("id", "component")).alias("g")).where(F.size("g") > 1)
    each = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (y["id"] > x["id"]) & (y["component"] != x["component"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    pairs = stash(groups.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct(), "rare")
    forget(often, known)
    return pairs, off


def agreeing(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) whose signatures (id, signature) don't rule a link out."""
    settle(pairs.sparkSession)
    both = pairs.join(signatures.withColumnsRenamed({"id": "b", "signature": "sb"}), "b").join(signatures.withColumnsRenamed({"id": "a", "signature": "sa"}), "a").select("a", "b", "sa", "sb")

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                rows = pa.array(np.flatnonzero(agreement(x, y) >= floor(threshold, x.shape[1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


#: Members of a bucket by sort, and the sorts that each can meet. 0 and 1: light ones outside and inside of the largest component; 2 and 3: others outside and inside of it.
MEETS = {0: [0, 1, 2, 3], 1: [0, 2], 2: [0, 1], 3: [0]}


def sorted_members(entries: DataFrame, threshold: float) -> DataFrame:
    """entries with sort, and counts: how many members of each sort the bucket has. Buckets in which none can meet are left out."""
    by_component = entries.groupBy("bucket", "component").count()
    largest = stash(by_component.groupBy("bucket").agg(F.max(F.struct("count", "component"))["component"].alias("largest")), "largest")
    half = (1 / threshold - 1) / 2 + 1e-9
    sort = F.when(F.col("off") <= half, 0).otherwise(2) + F.when(F.col("component") == F.col("largest"), 1).otherwise(0)
    marked = stash(entries.join(sized(largest), "bucket").withColumn("sort", sort).drop("largest"), "marked")
    counts = marked.groupBy("bucket").agg(*[F.count_if(F.col("sort") == k).alias(f"n{k}") for k in MEETS])
    counts = stash(counts.where("n0 > 1 OR n0 > 0 AND n1 + n2 + n3 > 0 OR n1 > 0 AND n2 > 0").select("bucket", F.array(*[f"n{k}" for k in MEETS]).alias("counts")), "counts")
    return marked.join(sized(counts), "bucket")


def left_over(entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that may be linked by common shingles alone and that signatures can't rule out, each once. entries: bucket, id, component, near (similarity to the
    bucket's pivot), off (see rare_pairs), bands, signature, long_signature.

    Only members of different components whose similarities to the pivot differ by no more than 1 - threshold can be linked (1 - similarity is a metric), and only if their off add up to
    1/threshold - 1 at most, so one of them is light: has half of that at most. Members of the bucket's largest component don't meet each other, nor do two that aren't light. A
    pair is looked at in the first bucket that it shares. All meet in blocks, so that no group is larger than two of them.
    """
    settle(entries.sparkSession)
    sorts = sorted_members(entries, threshold)
    code = F.shiftleft(F.col("sort").cast("long"), 32) + F.col("block")
    blocks = lambda sort: F.when(F.col("counts")[sort] > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.col("counts")[sort] / BLOCK).cast("int") - 1), lambda k: F.lit(sort << 32) + k)).otherwise(F.array().cast("array<bigint>"))
    others = F.lit(None).cast("array<bigint>")
    for sort, partners in MEETS.items():
        others = F.when(F.col("sort") == sort, F.concat(*[blocks(p) for p in partners])).otherwise(others)
    placed = sorts.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.element_at("counts", F.col("sort") + 1) / BLOCK)).cast("int")).withColumn("block", code)
    met = placed.withColumn("other", F.explode(others))
    met = met.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "near", "off", "bands", "signature", "long_signature")
    apart, most_off = 1 - threshold + 1e-9, 1 / threshold - 1 + 1e-9

    def meet(group: pa.Table) -> pa.Table:
        ids, comp, block, near, off = (group.column(c).to_numpy() for c in ("id", "component", "block", "near", "off"))
        sig, long = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint8).reshape(len(ids), -1) for c in ("signature", "long_signature"))
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        bucket, one_block = group.column("bucket")[0].as_py(), group.column("i")[0] == group.column("j")[0]
        a_out, b_out = [], []
        for k in range(len(ids)):
            rows = np.flatnonzero((ids < ids[k]) & (comp != comp[k]) & (np.abs(near - near[k]) <= apart) & (off + off[k] <= most_off) & (one_block | (block != block[k])))
            rows = rows[agreement(sig[rows], sig[k]) >= floor(threshold, sig.shape[1])]
            rows = rows[agreement(long[rows], long[k]) >= floor(threshold, long.shape[1])]
            if len(rows):
                rows = rows[bands[k][(bands[rows] == bands[k]).argmax(axis=1)] == bucket]
                a_out.append(ids[rows])
                b_out.append(np.full(len(rows), ids[k]))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": join(a_out), "b": join(b_out)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return met.groupBy("bucket", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, report: dict | None = None) -> DataFrame:
    """(id, class_id) for every row: documents linked by a similarity of threshold or more, at any distance, are one class, named by its smallest id.

    Words are lower-cased runs of letters and digits, shingles are five words (all words of a shorter text). A null or empty text and one without words is
    alone in its class. id must be a number (it is cast to long). Rows that share an id are one document. A row with a null id gets the class of its exact copies that have one, else
    null. Other columns are not carried; an empty table gives no rows. report, if given, is told how many pairs were looked at: those with pivots, rare (by a shared rare shingle), and
    common (in buckets of texts that common shingles alone may link).
    """
    sketches = stash(sketch(docs, id, text), "sketches")
    worded = sketches.where("n > 0")
    # exact copies (equal weighted shingles) are one node
    copies = stash(worded.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("k1", "k2", "rep"), "copies")
    joined = worded.join(copies, ["k1", "k2"], "left")
    nodes = stash(joined.where("rep IS NULL OR rep = id").where("id IS NOT NULL").select("id", "bands", "signature"), "nodes")
    entries = nodes.select("id", F.explode("bands").alias("bucket"))
    pivots = stash(entries.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("bucket", "pivot"), "pivots")
    shared = stash(entries.join(pivots, "bucket"), "shared")
    pairs = stash(shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    texts = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    checked = stash(verify(pairs, texts), "checked")
    links = checked.where(F.col("similarity") >= threshold).select("a", "b")
    found = stash(components(links), "components")
    # what the pivots leave open: members of other components than the pivot's, and those of its own that one of these may be near to
    known = shared.join(checked.select(F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("similarity").alias("near")), ["pivot", "id"])
    known = known.join(found.withColumnsRenamed({"component": "cp", "id": "pivot"}), "pivot", "left").join(found, "id", "left")
    known = stash(known.select("bucket", "id", "near", F.coalesce("cp", "pivot").alias("cp"), F.coalesce("component", "id").alias("component")), "known")
    outside = stash(known.where("component <> cp").groupBy("bucket").agg(F.max("near").alias("nearest")), "outside")
    open_ = known.join(outside, "bucket").where((F.col("component") != F.col("cp")) | (F.col("near") <= F.col("nearest") + (1 - threshold)))
    open_ = stash(open_.select("bucket", "id", "component", "near"), "open")
    several = stash(open_.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("bucket"), "several")
    remaining = stash(open_.join(several, "bucket", "left_semi"), "remaining")
    forget(pivots, shared, known, outside, open_, several)
    if report is not None:
        report |= {"pivots": pairs.count(), "rare": 0, "common": 0}
    if remaining.limit(1).count():
        members = stash(remaining.select("id", "component").distinct(), "members")
        tokens = stash(shares(texts, members.select("id")), "tokens")
        rare, off = rare_pairs(tokens, members, threshold)
        new_links = linked(agreeing(rare, nodes.select("id", "signature"), threshold), texts, threshold)
        # texts that consist nearly wholly of common shingles
        entries = stash(remaining.join(sized(off), "id"), "entries")
        if report is not None:
            n = lambda k: F.col("counts")[k]
            looked = n(0) * (n(0) - 1) / 2 + n(0) * (n(1) + n(2) + n(3)) + n(1) * n(2)
            report["rare"] = rare.count()
            report["common"] = int(sorted_members(entries, threshold).select("bucket", looked.alias("n")).distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        if entries.limit(1).count():
            ids = stash(entries.select("id").distinct(), "needed")
            long = stash(longer(texts, ids).join(nodes, "id"), "longer")
            new_links = new_links.union(linked(left_over(entries.join(long, "id"), threshold), texts, threshold))
            forget(ids, long)
        if new_links.limit(1).count():
            before, found = found, stash(components(links.union(new_links)), "components")
            forget(before)
        forget(members, tokens, rare, off, entries, new_links)
    forget(nodes, pairs, checked, remaining)
    named = sketches.select("id", "k1", "k2", "n").join(copies, ["k1", "k2"], "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    return named.join(found.withColumnRenamed("id", "node"), "node", "left").select("id", F.coalesce("component", "node").alias("class_id"))


def linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts are similar enough."""
    pairs = stash(pairs, "candidates")
    out = stash(verify(pairs, texts).where(F.col("similarity") >= threshold).select("a", "b"), "links")
    forget(pairs)
    return out
