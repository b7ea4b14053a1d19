"""Best-fit packing by minimum bin slack.

Texts become pieces of at most size ids, once, in a map. Only the histogram of lengths (size rows at most) goes to the driver, where
each bin is filled by dynamic programming over subset sums, held as bits of one integer, and the combination found is removed as often
as the histogram allows. The resulting plan (patterns of lengths, not of pieces) goes back to the pieces: a piece's rank among those of its
length says which bin it fills. Ranks are taken in salted groups, so that no length, however common, is one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import explode_texts, stash
from .encoders import encode_many

PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def pieces(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: list[str] | None = None, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each text's ids and one end_id, cut into pieces of size ids if there are more; then the first piece has the rest.

    Returns keep (all columns but the text if not given), piece (from 0), start, length, ids_crc32, and ids if asked for. A null text is
    an empty one: one piece of one id. Repeated rows are packed each.
    """
    names = {f.name for f in [*PIECE, IDS]} | {"sequence_id", "offset"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names and (keep is not None or c != text)]

    def make():
        def cut(texts: pa.Array) -> tuple:
            rows, piece, start, length, crc, out = [], [], [], [], [], []
            for row, ids in enumerate(encode_many(tokenizer, texts.fill_null("").to_pylist())):
                ids = np.append(np.array(ids, "<u4"), np.array([end_id], "<u4"))
                at, k = 0, 0
                while at < len(ids):
                    to = at + size if at or len(ids) % size == 0 else len(ids) % size
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
                    if with_ids:
                        out.append(ids[at:to].astype(np.int32))
                    at, k = to, k + 1
            return (rows, piece, start, length, crc, *([out] if with_ids else []))

        return cut

    return explode_texts(docs, text, keep, PIECE + [IDS] * with_ids, make)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths (with how often each) of the largest sum of at most room; long ones first where sums are equal."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted((n for n in counts if counts[n] > 0 and n <= room), reverse=True):
        left, b = min(counts[n], room // n), 1
        while left:
            b = min(b, left)
            steps.append((reach, n, b))
            reach |= (reach << (n * b)) & mask
            left, b = left - b, b * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for before, n, b in reversed(steps):
        if not before >> at & 1:
            at -= n * b
            out[n] = out.get(n, 0) + b
    return out


def minimum_bin_slack(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (lengths with how often each, number of such bins). Each bin starts from the longest piece that is left and is filled as far as can be."""
    left, bins = {n: c for n, c in histogram.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        one = fullest(left, size - longest)
        left[longest] += 1
        one[longest] = one.get(longest, 0) + 1
        times = min(left[n] // m for n, m in one.items())
        bins.append((one, times))
        for n, m in one.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return bins


def plan(bins: Iterable[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset in the bin), ordered by length and rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for one, times in bins:
        offset = 0
        for n, m in sorted(one.items(), reverse=True):
            rows.append((n, used.get(n, 0), m, base, offset))
            used[n] = used.get(n, 0) + m * times
            offset += n * m
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(cut: DataFrame, *, order: list[str], size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces, from their column length (1 to size). order: columns that tell the pieces apart, besides
    piece and start; equal rows are exchangeable. cut is read three times: it should be a written table. Empty input gives no rows."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    # groups of about equal size: at most size + 8 a partition in all, whatever the number of pieces
    share = max(64, sum(histogram.values()) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = {n: -(-c // share) for n, c in histogram.items()}
    first = np.zeros(size + 2, np.int64)
    for n in range(1, size + 1):
        first[n + 1] = first[n] + salts.get(n, 0)
    salt_of = spark.createDataFrame(list(salts.items()), "length long, __salts long")
    salted = cut.join(F.broadcast(salt_of), "length").withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order], "piece", "start", *([] if "ids_crc32" not in cut.columns else ["ids_crc32"])), "__salts")).drop("__salts")
    before = np.zeros(first[-1], np.int64)
    for n, s, c in salted.groupBy("length", "__salt").count().collect():
        before[first[n] + s] = c
    for n in salts:  # counts to ranks of each group's first
        part = before[first[n] : first[n + 1]]
        part[:] = np.concatenate([[0], np.cumsum(part)[:-1]])
    steps = plan(minimum_bin_slack(histogram, size))
    key = steps[:, 0] << 44 | steps[:, 1]
    shared = spark.sparkContext.broadcast((first, before, steps, key))
    cols = [*cut.columns, "sequence_id", "offset"]
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def put(batches):
        first, before, steps, key = shared.value
        for b in batches:
            n, s, r = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__salt", "__rank"))
            rank = before[first[n] + s] + r - 1
            step = steps[np.searchsorted(key, n << 44 | rank, "right") - 1]
            nth = rank - step[:, 1]
            made = [pa.array(step[:, 3] + nth // step[:, 2]), pa.array(step[:, 4] + nth % step[:, 2] * n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols[:-2]), *made], names=cols)

    by = Window.partitionBy("length", "__salt").orderBy(*[F.col(f"`{c}`") for c in order], "piece", "start")
    ranked = salted.withColumn("__rank", F.row_number().over(by).cast("long"))
    return ranked.select(*cut.columns, "__salt", "__rank").mapInArrow(put, schema)


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: list[str], size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """pieces() placed into sequences of at most size ids, as few as minimum bin slack finds. keep should tell the documents apart."""
    cut = stash(pieces(docs, tokenizer, text=text, keep=keep, size=size, end_id=end_id, with_ids=with_ids), "pieces")
    return place(cut, order=[c for c in keep if c in cut.columns], size=size)


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length, ids. A group has size ids at most. Needs pieces with ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
