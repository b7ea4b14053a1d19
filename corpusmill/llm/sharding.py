"""Sharding by histogram sort, with DataFrame functions only.

Every row has a 64-bit key and a size in bytes. Splitters between shards (and between the blocks that a shard is sorted in) are found by
counting: each round puts probes into the intervals that still hold a wanted splitter, one pass over (key, size) counts the exact bytes and rows below each probe, and
the interval shrinks to the pair of probes around the target. Once every splitter is within tolerance of its target, rows are exchanged, once.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def buckets(key: str, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, by a binary search written out as an expression."""

    def node(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        bound = f"{bounds[mid]}L" if bounds[mid] != LOW else "(-9223372036854775807L - 1L)"
        return f"CASE WHEN {key} < {bound} THEN {node(lo, mid)} ELSE {node(mid + 1, hi)} END"

    return F.expr(node(0, len(bounds)))


def find_splitters(keyed: DataFrame, targets: list[tuple[float, float]], first_bits: int) -> list[tuple[int, int, int]]:
    """For each target (bytes, tolerance): a splitter such that the bytes of keys below it are within tolerance of the target, or as
    near as keys allow (equal keys stay together), with the exact bytes and rows below.

    The first round counts between 2 ** first_bits even probes. Each later one looks only at the intervals that still hold a wanted
    splitter, with 64 or more even probes in each, so what a round returns is bounded by the number of targets.
    """
    known: dict[int, tuple[int, int]] = {LOW: (0, 0)}
    have, active = 0, [-1]
    while active and have < 64:
        step = min(first_bits if not have else 10 if len(active) <= 64 else 6, 64 - have)
        inside = keyed.where(F.shiftright("__key", 64 - have).isin(active)) if have else keyed
        shift = 64 - have - step
        counted = sorted(tuple(r) for r in inside.groupBy(F.shiftright("__key", shift).alias("cell")).agg(F.sum("__size"), F.count("*")).collect())
        running, parent = (0, 0), None
        for cell, size, rows in counted:
            if have and cell >> step != parent:
                parent = cell >> step
                running = known[parent << (64 - have)]
            known[cell << shift] = running
            running = (running[0] + size, running[1] + rows)
            known[(cell + 1) << shift] = running
        have += step
        keys = sorted(known)
        sizes, wanted = [known[k][0] for k in keys], set()
        for t, tolerance in targets:
            k = max(1, min(bisect_right(sizes, t), len(keys) - 1)) if len(keys) > 1 else 0
            if k and min(abs(sizes[k - 1] - t), abs(sizes[k] - t)) > tolerance and known[keys[k]][1] - known[keys[k - 1]][1] > 1:
                wanted.add(keys[k - 1] >> shift)
        active = sorted(wanted)
    keys = [k for k in sorted(known) if k <= HIGH]
    sizes, out = [known[k][0] for k in keys], []
    for t, _ in targets:
        k = bisect_right(sizes, t)
        out.append(min((keys[j] for j in (k - 1, k) if 0 <= j < len(keys)), key=lambda x: (abs(known[x][0] - t), x)))
    return [(k, *known[k]) for k in out]


def histogram_sort(df: DataFrame, key: Column, size: Column, *, shards: int = 24, tolerance: float = 0.01, rows_per_block: int = 2_000_000) -> DataFrame:
    """df with shard (0 to shards - 1, of nearly equal sums of size) and slot (gapless from 0 within a shard, in the order of key).

    key: a long that spreads rows (null counts as the lowest); rows of equal keys go to one shard. size: bytes of a row (null: 0). tolerance: how
    far a splitter may be off, as a share of a mean shard. Within equal keys, slots follow the other columns that can be ordered, so that a task that is run again
    gives the same result; wholly equal rows are exchangeable. Columns named shard or slot give way. An empty df gives no rows.
    """
    df = df.drop("shard", "slot")
    cols = df.columns
    keyed = stash(df.select(F.coalesce(key, F.lit(LOW)).cast("long").alias("__key"), F.coalesce(size, F.lit(0)).cast("long").alias("__size")), "keys")
    total, rows = keyed.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    if not rows:
        return df.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).where("false")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a shard is sorted in blocks, so that it may be larger than a task; at most 4096 in all, as they are part of the plan
    per = max(1, min(4096 // shards, max(-(-2 * parts // shards), -(-rows // (shards * rows_per_block)))))
    blocks = shards * per
    wanted = [total * k / blocks for k in range(1, blocks)]  # bytes below each block
    found = find_splitters(keyed, [(t, total / shards * tolerance / 2 if k % per == 0 else 0.2 * total / blocks) for k, t in enumerate(wanted, 1)], max(10, (8 * blocks).bit_length()))
    bounds = sorted({f[0] for f in found})
    counted = {f[0]: f[2] for f in found}
    shard_bounds = [found[k * per - 1][0] for k in range(1, shards)]
    block_rows = [0, *(counted[b] for b in bounds)]
    shard_of = [bisect_right(shard_bounds, b) for b in [LOW, *bounds]]
    first_of = [counted[shard_bounds[s - 1]] if s else 0 for s in shard_of]
    marked = df.withColumn("__key", F.coalesce(key, F.lit(LOW)).cast("long")).withColumn("__block", buckets("__key", bounds))
    ties = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant") and "map<" not in f.dataType.simpleString()]
    rank = F.row_number().over(Window.partitionBy("__block").orderBy("__key", *ties))
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("__block") + 1)
    ranked = marked.withColumn("__rank", rank)
    return ranked.select(*[F.col(f"`{c}`") for c in cols], at(shard_of).cast("int").alias("shard"), (at([r - f for r, f in zip(block_rows, first_of, strict=True)]) + F.col("__rank") - 1).alias("slot"))
