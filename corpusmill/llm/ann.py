"""Largest inner products by a hierarchical k-means tree and best-bin-first traversal.

Vectors get one more component, sqrt(M^2 - |x|^2) with the largest norm M, and queries a 0 there: the nearest by distance are then those of the
largest inner product. The tree has two parts. Its upper part is fitted on a bounded sample and broadcast; its leaves are regions of about a thousand rows. Each region's rows
meet in a task, which fits the lower part on them, down to leaves of a few rows, and answers the queries that come by.

Best-bin-first pops nodes from a priority queue, the nearest centre first, until the least entry lies beyond a query's bound. The leaves popped so are exactly those
on whose path no centre is beyond the bound, which is how regions find them without a common queue. How far out the bounds lie is calibrated: for some queries the exact
neighbours are found by brute force, and the bound is widened until the wanted share of them is inside. A query's bound is in units of the spread of its own scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, stash

#: The upper tree is fitted on a 64th of the vectors, but so many at least and at most; calibration takes about so many queries.
FIT_ROWS, CALIBRATION_QUERIES = (16_384, 524_288), 128
#: Rows of a region (past 65,536 regions they grow), of a leaf, and of the sample for each region at least.
REGION_ROWS, LEAF_ROWS, BRANCHES, MIN_FIT_PER_LEAF = 1_024, 8, 8, 8
#: Rows of a region, and queries that visit it, that meet in one group.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 2_048


@dataclass
class Tree:
    """Nodes with centres, each after its parent; children of -1 are none; leaf is the number of a leaf, or -1."""

    centres: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    nodes_of_leaf: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def fit(x: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
        rng = np.random.default_rng(seed)
        most = max(MIN_FIT_PER_LEAF, len(x) // max(1, leaves))
        centres, children, leaf = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[-1] * branches], [-1]
        todo, n_leaves = [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            part = split(x[rows], branches, rng) if len(rows) > most else None
            if part is None:
                leaf[node] = n_leaves
                n_leaves += 1
                continue
            for k, (own, centre) in enumerate(part):
                children[node][k] = len(centres)
                todo.append((len(centres), rows[own]))
                centres.append(centre)
                children.append([-1] * branches)
                leaf.append(-1)
        return Tree(np.array(centres), np.array(children), np.array(leaf)).indexed()

    def indexed(self) -> Tree:
        self.nodes_of_leaf = np.zeros(self.leaf.max() + 1, np.int64)
        inside = np.flatnonzero(self.leaf >= 0)
        self.nodes_of_leaf[self.leaf[inside]] = inside
        self.parent = np.zeros(len(self.leaf), np.int64)
        node, k = np.nonzero(self.children >= 0)
        self.parent[self.children[node, k]] = node
        return self

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all nodes' centres, less |x|^2."""
        return (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector descends to."""
        d, at = self.distances(x), np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.leaf[at] < 0)).size:
            kids = self.children[at[inner]]
            far = np.where(kids >= 0, np.take_along_axis(d[inner], np.maximum(kids, 0), 1), np.inf)
            at[inner] = kids[np.arange(len(inner)), far.argmin(axis=1)]
        return self.leaf[at]

    def keys(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf the largest distance on the way there (the root's doesn't count): a queue that pops until its least entry is over a bound pops the leaves up to that key."""
        key = self.distances(q)
        key[:, 0] = -np.inf
        for node in range(1, key.shape[1]):
            np.maximum(key[:, node], key[:, self.parent[node]], out=key[:, node])
        return key[:, self.nodes_of_leaf]


def popped(key: np.ndarray, sizes: np.ndarray, bound: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which leaves each query visits: those with a key up to its bound, and the nearest until it has seen least rows. The second part says which of them are needed for that."""
    order = np.argsort(key, axis=1, kind="stable")
    seen = np.cumsum(sizes[order], axis=1) - sizes[order]
    needed = np.zeros(key.shape, bool)
    np.put_along_axis(needed, order, seen < least[:, None], axis=1)
    return (key <= bound[:, None]) | needed, needed


def split(x: np.ndarray, branches: int, rng: np.random.Generator, rounds: int = 8) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """k-means of x: rows and centre of each cluster, or None if x is one point."""
    centres = np.unique(x[rng.choice(len(x), min(branches * 4, len(x)), replace=False)], axis=0)
    if len(centres) < 2:
        centres = np.unique(x, axis=0)
    if len(centres) < 2:
        return None
    centres = centres[rng.choice(len(centres), min(branches, len(centres)), replace=False)]
    for _ in range(rounds if len(x) > 2 * REGION_ROWS else 3):  # small parts settle soon
        member = np.eye(len(centres))[((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)]
        n = member.sum(axis=0)
        centres = (member.T @ x)[n > 0] / n[n > 0, None]
    own = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
    keep = np.unique(own)
    return None if len(keep) < 2 else [(np.flatnonzero(own == k), centres[k]) for k in keep]


def valid(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def augmented(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x**2).sum(axis=1), 0))[:, None]])


def top(rough: np.ndarray, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query (a row of rough scores, -inf for what it doesn't see) its k best of x: query index, row index, score. Scores are summed in one
    fixed order, so equal vectors have equal scores; these are ordered by id, then by row number."""
    if rough.shape[1] > k:
        kth = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        near = rough >= np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), -np.inf)[:, None]
    else:
        near = np.ones(rough.shape, bool)
    near &= rough > -np.inf
    out_q, out_r, out_s = [], [], []
    up_to, begin = np.cumsum(near.sum(axis=1)), 0
    while begin < len(queries):  # a run of queries with so many near rows, or one query
        end = max(begin + 1, int(np.searchsorted(up_to, (up_to[begin - 1] if begin else 0) + (1 << 16), "right")))
        i, r = np.nonzero(near[begin:end])
        score = (x[r] * queries[begin + i]).sum(axis=1)
        o = np.lexsort((rows[r], ids[r], -score, i))
        i, r, score = i[o], r[o], score[o]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out_q.append(begin + i[first])
        out_r.append(r[first])
        out_s.append(score[first])
        begin = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(out_q, np.int64), join(out_r, np.int64), join(out_s, np.float64)


def hide(rough: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rough without each query's own row. rows is ascending."""
    at = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
    mine = np.flatnonzero(rows[at] == own)
    rough[mine, at[mine]] = -np.inf
    return rough


@dataclass
class Spread:
    """How a query's scores over all vectors are spread, from a sample: bounds are so many of these from the mean."""

    norm2: float
    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(x: np.ndarray, norm2: float) -> Spread:
        mean = x.mean(axis=0)
        return Spread(norm2, mean, (x - mean).T @ (x - mean) / len(x))

    def units(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sd = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", q, self.cov, q), 0))
        return self.norm2 - 2 * q @ self.mean, 2 * sd + 1e-9 * (1 + np.sqrt(self.norm2 * (q**2).sum(axis=1)))


def best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def as_query(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))])


def search(vectors: DataFrame, is_query: Column, *, id: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.95, region_rows: int = REGION_ROWS, leaf_rows: int = LEAF_ROWS, report: dict | None = None) -> DataFrame:
    """The k rows of the largest inner product with each query row, by the index: query_id, rank (from 1), id, score, best first, ties to the smaller id.

    is_query picks the queries among the rows. A row is never its own neighbour, but any other row is a candidate, repeated rows and rows of the same id too; rows of an id that is picked
    are queries each, with k answers each under that id. Rows with a null id, with vectors null, zero, with null or non-finite components, or of another length than most take no part.
    id must be a number (it is cast to long). All valid rows are indexed; recall is the share of true neighbours that calibration asks for. Fewer than k candidates give
    fewer rows, an empty table none. report, if given, is told regions, bound, and share: the part of all rows that the calibration's queries are compared with.
    """
    spark = settle(vectors.sparkSession)
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(valid(F.col("v")) & F.col("id").isNotNull())
    facts = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).collect()
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not facts:
        return spark.createDataFrame([], out)
    dim, count, norm2 = max(facts, key=lambda r: (r[1], r[0]))
    rows = rows.where(F.size("v") == dim)
    fit_rows, cells = max(FIT_ROWS[0], min(FIT_ROWS[1], count // 64)), 1 << 20
    share = F.pmod(F.xxhash64("id", "v"), F.lit(cells)) < max(1, min(cells, cells * fit_rows // count))
    sample = matrix(rows.where(share).select("v").limit(2 * fit_rows).toArrow().column(0).combine_chunks())
    if not len(sample):
        sample = matrix(rows.select("v").limit(fit_rows).toArrow().column(0).combine_chunks())
    tree = Tree.fit(augmented(sample, norm2), min(-(-count // region_rows), fit_rows // MIN_FIT_PER_LEAF))
    shared = spark.sparkContext.broadcast((tree, Spread.of(sample, norm2)))

    def put(batches):
        tree = shared.value[0]
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(augmented(matrix(b.column(1)), norm2)).astype(np.int32))], names=["id", "v", "q", "row", "region"])

    # rows are told apart by a number of their own, which stays as it is once the table is written
    indexed = stash(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(put, f"id long, v {kind}, q boolean, row long, region int"), "ann")
    sizes = np.zeros(tree.leaf.max() + 1, np.int64)
    for region, n in indexed.groupBy("region").count().collect():
        sizes[region] = n
    blocks = -(-sizes // BLOCK_ROWS)
    blocked = indexed.join(F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(blocks)], "region int, blocks int")), "region").select("region", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), "row", "id", "v")

    def lower(a: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tree, np.ndarray]:
        """Rows (ascending), ids, vectors, the lower tree and each row's leaf. The same rows give the same tree, whatever order they come in."""
        row = a.column("row").to_numpy()
        order = np.argsort(row)
        x = matrix(a.column("v").combine_chunks())[order]
        own = Tree.fit(augmented(x, norm2), -(-len(x) // leaf_rows))
        return row[order], a.column("id").to_numpy()[order], x, own, own.assign(augmented(x, norm2))

    z = calibrate(indexed, blocked, shared, lower, kind, k, recall, report)
    if report is not None:
        report |= {"regions": int((sizes > 0).sum()), "bound": z}
    layout = spark.sparkContext.broadcast((sizes, blocks))

    def visit(batches):
        (tree, spread), (sizes, blocks) = shared.value, layout.value
        step = max(1, (1 << 22) // len(tree.leaf))
        for b in batches:
            for begin in range(0, b.num_rows, step):
                part = b.slice(begin, step)
                q = matrix(part.column(1))
                mean, unit = spread.units(q)
                bound = mean + z * unit
                seen, needed = popped(np.where(sizes > 0, tree.keys(as_query(q)), np.inf), sizes, bound, np.full(len(q), k + 1))
                i, region = np.nonzero(seen & (sizes > 0))
                n = blocks[region]
                i, region, block = np.repeat(i, n), np.repeat(region, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for at in range(0, len(i), 1 << 14):
                    to = at + (1 << 14)
                    take = pa.array(i[at:to])
                    cols = [*(part.column(c).take(take) for c in range(3)), pa.array(region[at:to].astype(np.int32)), pa.array(block[at:to].astype(np.int32)), pa.array(bound[i[at:to]]), pa.array(needed[i[at:to], region[at:to]])]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "row", "region", "block", "bound", "needed"])

    crowds = stash(indexed.where("q").select("id", "v", "row").mapInArrow(visit, f"id long, v {kind}, row long, region int, block int, bound double, needed boolean"), "visits")
    n_visits = np.ones(len(sizes), np.int64)
    for region, n in crowds.where("block = 0").groupBy("region").count().collect():
        n_visits[region] = -(-n // BLOCK_QUERIES)
    # blocks of a region x blocks of its visitors: every pair of blocks meets once
    per_region = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(n_visits)], "region int, crowds int"))
    left = blocked.join(per_region, "region").select("region", "block", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), "row", "id", "v")
    right = crowds.join(per_region, "region").select("region", "block", F.pmod(F.xxhash64("row"), "crowds").cast("int").alias("crowd"), "row", "id", "v", "bound", "needed")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        row, ids, x, own, leaf = lower(a)
        by_leaf = np.argsort(leaf, kind="stable")
        sizes = np.bincount(leaf, minlength=own.leaf.max() + 1)
        ends = np.cumsum(sizes)
        q, qid, qrow, bound = matrix(b.column("v").combine_chunks()), b.column("id").to_numpy(), b.column("row").to_numpy(), b.column("bound").to_numpy()
        least = np.where(b.column("needed").to_numpy(), k + 1, 0)
        parts = []
        for at in range(0, len(q), 256):
            some = slice(at, at + 256)
            seen, _ = popped(own.keys(as_query(q[some])), sizes, bound[some], least[some])
            rough = np.full((len(q[some]), len(x)), -np.inf)
            for one in np.flatnonzero(seen.any(axis=0) & (sizes > 0)):
                mine, inside = np.flatnonzero(seen[:, one]), by_leaf[ends[one] - sizes[one] : ends[one]]
                rough[np.ix_(mine, inside)] = q[some][mine] @ x[inside].T
            i, r, score = top(hide(rough, qrow[some], row), q[some], x, ids, row, k)
            parts.append(pa.table([qid[some][i], qrow[some][i], ids[r], row[r], score], schema=kinds))
        return pa.concat_tables(parts)

    key = ["region", "block", "crowd"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, query_row long, id long, row long, score double")
    return best(found, k).select("query_id", F.col("rank").cast("int"), "id", "score")


def calibrate(indexed: DataFrame, blocked: DataFrame, shared, lower, kind: str, k: int, recall: float, report: dict | None, most: int = CALIBRATION_QUERIES) -> float:
    """The smallest bound, in units of a query's spread, at which the wanted share of the true neighbours of some queries is reached."""
    spark = indexed.sparkSession
    asked = indexed.where("q").orderBy(F.xxhash64("row"), "row").select("row", "v").limit(most).collect()
    if not asked:
        return 0.0
    queries = spark.sparkContext.broadcast((np.array([r[0] for r in asked], np.int64), np.array([r[1] for r in asked], np.float64)))

    def scan(a: pa.Table) -> pa.Table:
        (qrow, q), (tree, spread) = queries.value, shared.value
        row, ids, x, own, leaf = lower(a)
        key = np.maximum(own.keys(as_query(q)), tree.keys(as_query(q))[:, [a.column("region")[0].as_py()]])
        mean, unit = spread.units(q)
        z = ((key - mean[:, None]) / unit[:, None])[:, leaf]
        i, r, score = top(hide(q @ x.T, qrow, row), q, x, ids, row, k)
        bins = np.bincount(np.clip((z * 16).astype(np.int64) + 512, 0, 1023).ravel(), minlength=1024)
        some = np.flatnonzero(bins)
        none = lambda n, kind: pa.nulls(n, kind)
        found = pa.table({"query_row": qrow[i], "id": ids[r], "row": row[r], "score": score, "z": z[i, r], "bin": none(len(i), pa.int64()), "n": none(len(i), pa.int64())})
        spreads = pa.table({"query_row": none(len(some), pa.int64()), "id": none(len(some), pa.int64()), "row": none(len(some), pa.int64()), "score": none(len(some), pa.float64()), "z": none(len(some), pa.float64()), "bin": some, "n": bins[some]})
        return pa.concat_tables([found, spreads])

    scanned = stash(blocked.groupBy("region", "block").applyInArrow(scan, "query_row long, id long, row long, score double, z double, bin long, n long"), "calibration")
    places = sorted(r[0] for r in best(scanned.where("bin IS NULL"), k).select("z").collect())
    z = places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)] + 1e-9 if places else 0.0
    if report is not None:
        bins = scanned.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("n")).collect()
        report["share"] = sum(n for b, n in bins if (b - 512) / 16 <= z) / max(1, sum(n for _, n in bins))
    return float(z)
