"""Running totals and ranks over a total order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stash


def running(df: DataFrame, order: list[Column | str], totals: dict[str, Column]) -> DataFrame:
    """df with, for each name in totals, the sum of that column over all rows up to and with each row in the order.

    The rows are written, so that drawing ranges doesn't work them out again, dealt by ranges of the order and written once more; each range's total is one small row, and a range adds what lies before it to its own running sum.
    The order should be total: rows of equal keys are in one range, in any order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    given = stash(df.select("*", *[c.alias(f"__{n}") for n, c in totals.items()], *[k.alias(f"__k{i}") for i, k in enumerate(keys)]), "given")
    by = [F.col(f"__k{i}") for i in range(len(keys))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stash(given.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # of at most parts rows
    offsets = ranged.groupBy("__part").agg(*[F.sum(f"__{n}").alias(f"__sum_{n}") for n in totals])
    offsets = offsets.select("__part", *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in totals])
    inside = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.join(F.broadcast(offsets), "__part").select(*df.columns, *[(F.sum(f"__{n}").over(inside) + F.col(f"__before_{n}")).alias(n) for n in totals])
    return summed


def numbered(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """df with the rank of each row, from 1."""
    return running(df, order, {name: F.lit(1).cast("long")})


def mark_first(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with name: whether the row is the first of its keys in the order.

    A key's rows are ranked in as many salted parts as there are shuffle partitions, and only the parts' firsts meet once more, so that a key that holds a
    third of all rows is no task of its own. Rows of equal keys and order are ranked arbitrarily.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    window = Window.partitionBy(*keys, "__salt").orderBy(*by)
    inside = df.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(parts))).withColumn("__first", F.row_number().over(window) == 1)
    across = inside.withColumn("__salt", F.when(F.col("__first"), F.lit(-1).cast("long")).otherwise(F.col("__salt")))
    return across.withColumn(name, F.col("__first") & (F.row_number().over(window) == 1)).drop("__salt", "__first")
