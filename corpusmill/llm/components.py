"""Connected components of a graph that only Spark holds, and small helpers on tables of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stash

#: A table of ids of at most so many rows (16 bytes each) may be broadcast; a larger one is joined by exchange.
BROADCAST_ROWS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """ids (a written table), marked for broadcast if it is counted to be small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """From edges (a, b) of longs: (id, component) for every id in an edge; the component is its smallest id.

    Alternates large-star and small-star steps, which turn any graph into stars in a logarithmic number of rounds. Each
    round is a written table; nothing is gathered in one task, since minima are aggregated in part before the exchange.
    """
    current = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        # large star: each greater neighbour of u, to the smallest around u; then small star: u and its smaller neighbours, to the smallest of these
        large = stash(both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        floor = stash(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "floor")
        rest = large.join(floor.where("n > 1").select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(floor.select("u", F.col("m").alias("v")).union(rest).distinct(), "edges")
        # stars only: no centre is itself a leaf, and each leaf has one centre
        if not after.groupBy("u").count().where("count > 1").limit(1).count() and not after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            forget(current, lowest, large, floor)
            current = after
            break
        forget(current, lowest, large, floor)
        current = after
    else:
        raise RuntimeError(f"components: no stars after {rounds} rounds")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def without(docs: DataFrame, classes: DataFrame, id: str) -> DataFrame:
    """docs without the rows whose class (id, class_id) is named by another id; of rows that share an id, and a place in their class, one stays: that of the least values, column by
    column (maps don't count).

    Rows without an id stay, copies of each other too: a class can't name them. What goes is a narrow table of ids: it is broadcast if it is counted to be small, and documents are not exchanged.
    """
    gone = stash(classes.where("id IS NOT NULL AND class_id IS NOT NULL AND id <> class_id").select("id").distinct(), "gone")
    twice = stash(classes.where("id IS NOT NULL AND id = class_id").groupBy("id").count().where("count > 1").select("id"), "twice")
    left = docs.join(sized(gone.withColumnRenamed("id", "__gone")), F.col(f"`{id}`") == F.col("__gone"), "left_anti")
    if not twice.limit(1).count():
        return left
    again = sized(twice.withColumnRenamed("id", "__twice"))
    same = F.col(f"`{id}`") == F.col("__twice")
    several = left.join(again, same, "left_semi")
    order = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    first = several.withColumn("__rank", F.row_number().over(Window.partitionBy(f"`{id}`").orderBy(*order))).where(F.col("__rank") == 1).drop("__rank")
    return left.join(again, same, "left_anti").unionByName(first)
