"""Benchmark decontamination with suffix arrays of the training texts.

Each task holds shards of whole texts. For a shard it sorts the positions of all words by the words that follow (a suffix array, by
prefix doubling, resolved as deep as a window is long; texts end in separators that no query has). Every suffix of every benchmark item
is then found by binary search, which gives all its verbatim occurrences; occurrences that go on along a diagonal are joined, so a match
of any length is known whole. Nothing is shuffled: the benchmark travels to the texts, in blocks of a checked size. What all tasks need of a block, its words as numbers
and its suffixes, is made once; a shard first drops the suffixes that have a word, or a pair of words, that it hasn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, raw
from .words import word_hashes

#: Bytes of benchmark text that one broadcast may hold; a larger benchmark is cut into several, used one after another.
BLOCK_BYTES = 16 << 20
#: Occurrences in a shard that are joined at a time.
MOST_HITS = 2_000_000
_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item", T.StringType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("matches", _SPANS)]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and their ranks from 0 on (equal keys, equal ranks)."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.uint64)
    new[:1] = 0
    new[1:] = np.cumsum(np.diff(keys[order]) != 0)
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = new
    return order, ranks


def suffix_order(ranks: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ranks in the order of (at least) the depth ranks that follow; beyond the end all are 0."""
    have, order = 1, np.argsort(ranks, kind="stable")
    while have < depth:
        bits = max(1, int(ranks.max(initial=0)).bit_length())
        parts = max(2, min(64 // bits, -(-depth // have)))
        key = np.zeros(len(ranks), np.uint64)
        for j in range(parts):
            key <<= np.uint64(bits)
            if j * have < len(ranks):
                key[: len(ranks) - j * have] |= ranks[j * have :]
        order, ranks = ranked(key)
        have *= parts
    return order


class Shard:
    """The suffix array of some texts' words (hashes), resolved to depth words. Each text is followed by a separator."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        self.depth = depth
        self.vocabulary, inverse = np.unique(words, return_inverse=True)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.place = np.arange(len(words)) + doc  # of each word, after the separators before it
        self.ranks = np.zeros(len(words) + len(first) + depth, np.uint64)
        self.ranks[self.place] = inverse.astype(np.uint64) + np.uint64(1)
        self.order = suffix_order(self.ranks[: len(words) + len(first)], depth)
        self.doc = np.full(len(words) + len(first), -1)
        self.doc[self.place] = doc
        self.first = first

    def find(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Binary search for the benchmark's suffixes: those that may occur here, and for these the run [from, to) of the suffixes that begin so."""
        if not len(self.vocabulary) or not len(bench.vocabulary):
            none = np.zeros(0, np.int64)
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, bench.vocabulary), len(self.vocabulary) - 1)
        rank_of = np.where(self.vocabulary[at] == bench.vocabulary, at + 1, 0)
        words = rank_of[bench.words].astype(np.uint64)
        strange = np.concatenate([[0], np.cumsum(words == 0)])
        rows = np.flatnonzero(strange[bench.starts + bench.n] == strange[bench.starts])
        rows = rows[self.has_pairs(words, bench, rows)]
        n = bench.n[rows]
        q = np.zeros((len(rows), self.depth), np.uint64)
        for j in range(self.depth):
            inside = j < n
            q[inside, j] = words[bench.starts[rows[inside]] + j]
        ends = []
        for after in (False, True):
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.order))
            while (lo < hi).any():
                mid = (lo + hi) // 2
                suffix = self.order[np.minimum(mid, len(self.order) - 1)]
                less, equal = np.zeros(len(rows), bool), np.ones(len(rows), bool)
                for j in range(self.depth):
                    here = self.ranks[suffix + j]
                    counts = j < n
                    less |= equal & counts & (here < q[:, j])
                    equal &= ~counts | (here == q[:, j])
                go = (less | equal if after else less) & (lo < hi)
                lo, hi = np.where(go, mid + 1, lo), np.where(~go & (lo < hi), mid, hi)
            ends.append(lo)
        return rows, *ends

    def has_pairs(self, words: np.ndarray, bench: Benchmark, rows: np.ndarray) -> np.ndarray:
        """Whether each suffix's first and last pair of words occur here."""
        if not len(rows):
            return np.zeros(0, bool)
        pairs = self.ranks[self.order] << np.uint64(32) | self.ranks[self.order + 1]  # ascending, as suffixes are
        fine = np.ones(len(rows), bool)
        several = (bench.n[rows] > 1) & (self.depth > 1)
        for last in (False, True):
            p = (bench.starts[rows] + (bench.n[rows] - 2 if last else 0))[several]
            wanted = words[p] << np.uint64(32) | words[p + 1]
            fine[several] &= pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted
        return fine


@dataclass
class Benchmark:
    """A block of items as the tasks need it: the words of all items as numbers of a vocabulary of hashes, and of each suffix (of window words, or a shorter item whole) where
    it starts, how many words count, whose it is, and its place in the item."""

    names: np.ndarray
    vocabulary: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    n: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(ids: list, items: list[str], window: int) -> Benchmark:
        words, first = word_hashes(*raw(pa.array(items, pa.large_string())))
        vocabulary, numbers = np.unique(words, return_inverse=True)
        count = np.diff(first)
        suffixes = np.maximum(count - window + 1, np.minimum(count, 1))
        owner = np.repeat(np.arange(len(items)), suffixes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
        names = np.array([None if x is None else str(x) for x in ids], object)
        return Benchmark(names, vocabulary, numbers.astype(np.int32), first[owner] + place, np.minimum(count[owner], window), owner, place)


def matcher(bench: Benchmark, window: int, most: int = MOST_HITS):
    """A function from an Arrow array of texts to their word counts and maximal verbatim matches. Only so many occurrences are held at a time: in
    texts of one repeated word a match may come in parts, which cover the same words."""
    n, owner, place, names = bench.n, bench.owner, bench.place, bench.names

    def join(shard: Shard, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, found: list[list]) -> None:
        """Adds all occurrences of these suffixes to found; those that follow one another on a diagonal of item and text are one match."""
        size = hi - lo
        hit = shard.order[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        row, doc = np.repeat(rows, size), shard.doc[hit]
        begin = hit - doc - shard.first[doc]
        o = np.lexsort((begin, begin - place[row], owner[row], doc))
        doc, begin, row = doc[o], begin[o], row[o]
        item, diagonal = owner[row], begin - place[row]
        new = np.ones(len(o), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (begin[1:] != begin[:-1] + 1)
        starts = np.flatnonzero(new)
        last = np.append(starts[1:], len(o)) - 1
        for d, b, e, k in zip(doc[starts].tolist(), begin[starts].tolist(), (begin[last] + n[row[last]]).tolist(), item[starts].tolist(), strict=True):
            found[d].append({"begin": b, "end": e, "item": names[k]})

    def search(texts: pa.Array) -> list:
        data, at = raw(texts)
        words, first = word_hashes(data, at)
        counts = np.diff(first)
        found: list[list] = [[] for _ in range(len(texts))]
        if len(n) and len(words):
            shard = Shard(words, first, window)
            rows, lo, hi = shard.find(bench)
            some = hi > lo
            rows, lo, hi = rows[some], lo[some], hi[some]
            up_to, begin = np.cumsum(hi - lo), 0
            while begin < len(rows):
                end = max(begin + 1, int(np.searchsorted(up_to, (up_to[begin - 1] if begin else 0) + most, "right")))
                join(shard, rows[begin:end], lo[begin:end], hi[begin:end], found)
                begin = end
        return [counts, found]

    return search


def blocks_of(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_BYTES) -> tuple[int, Iterator[tuple[list, list[str]]]]:
    """How many blocks of at most about so many bytes of text the benchmark's items make, and these one after another: the driver holds one at a time."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = int(-(-total // most)) or 1

    def blocks():
        for k in range(n):
            rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect() if n > 1 else items.collect()
            yield [r[0] for r in rows], [r[1] for r in rows]

    return n, blocks()


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All verbatim matches of at least window words (or of a whole shorter item) between docs and the benchmark.

    Returns for each row of docs the columns keep (all but none if not given; of the same name as a result's, they give way), n_words, and
    matches: arrays of (begin, end, item) in words, end exclusive, item as a string. A null or empty text has no words and no match;
    repeated rows are searched each; an item without words, or null, is never found; an item with a null id is found under a null id.
    """
    names = {f.name for f in FIELDS}
    carry = [c for c in (docs.columns if keep is None else keep) if c not in names]
    out = docs.withColumn("__searched", F.col(f"`{text}`").cast("string"))
    n, blocks = blocks_of(benchmark, item_id, item_text, block_bytes)
    for k, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark.of(*block, window))

        def make(shared=shared):
            return matcher(shared.value, window)

        out = out.withColumnRenamed("matches", "__matches") if k else out
        more = ["__searched"] * (k + 1 < n) + ["__matches"] * (k > 0)
        out = map_texts(out, "__searched", [*carry, *more], FIELDS, make)
        if k:
            out = out.withColumn("matches", F.concat("__matches", "matches")).drop("__matches")
    return out.select(*[F.col(f"`{c}`") for c in carry], "n_words", "matches")


def summary(found: DataFrame) -> DataFrame:
    """From find_matches: n_hit (words inside any match), items (distinct ids, as sorted strings), longest match and its place."""
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["begin"].alias("b"), m["end"].alias("e"))))
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, m: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), m["e"] - F.greatest(m["b"], a["to"]))).alias("n"), F.greatest(a["to"], m["e"]).alias("to")),
        lambda a: a["n"],
    )
    longest = F.array_max(F.transform("matches", lambda m: F.struct((m["end"] - m["begin"]).alias("n"), (-m["begin"]).alias("b"), m["item"].alias("i"))))
    return found.withColumns({"n_hit": covered, "items": F.array_sort(F.array_distinct(F.filter(F.col("matches")["item"], lambda i: i.isNotNull()))), "longest_match": F.coalesce(longest["n"], F.lit(0).cast("long")), "longest_begin": -longest["b"], "longest_item": longest["i"]})


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 1, **options) -> DataFrame:
    """docs without the rows in which passages of min_items or more different items occur; columns and rows otherwise as they were."""
    cols = docs.columns
    marked = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in cols]))
    text = options.pop("text", "text")
    found = find_matches(marked.select("__row", F.col(f"`{text}`").alias("__searched")), benchmark, text="__searched", keep=["__row"], **options)
    kept = found.where(F.size(F.array_distinct(F.filter(F.col("matches")["item"], lambda i: i.isNotNull()))) < min_items)
    return kept.select(*[F.col("__row")[c].alias(c) for c in cols])
