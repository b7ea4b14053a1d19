"""URL filters with DataFrame functions only: rules by host and path first, then gradient-boosted trees on lexical features.

Trees are grown level by level from histograms: each level is one aggregation over the labelled URLs, which are first gathered into a small table of distinct
binned features with counts. Only sums by node, feature and bin come to the driver; scoring is one expression. Statistics of host suffixes are a table of all
suffixes that the labelled URLs have, joined by hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import sized

#: Different labelled URLs that train the model, at most (about, by the hash of the URL). It bounds the suffix tables too (16 bytes a row).
TRAIN_ROWS = 1_000_000
#: Rows of the prior that a suffix's share is drawn to.
SUFFIX_WEIGHT = 20.0
SUFFIXES = (1, 2)
BINS, TREES, DEPTH, RATE, L2 = 16, 12, 3, 0.3, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, if the URL's path starts with path."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: list[Rule], host: Column, path: Column, what: str) -> Column:
    """Of the longest fitting rule (of equal ones the first): its string or its verdict; null if none fits."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):
        found = F.when(r.fits(host, path), str(r) if what == "rule" else r.verdict).otherwise(found)
    return found


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of text; all beyond ASCII count as one."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "\x7f")
    n = F.char_length(plain)

    def part(c: Column) -> Column:
        share = (n - F.char_length(F.replace(plain, c, F.lit("")))) / n
        return -share * F.log2(share)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(F.split(plain, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a + part(c))).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numeric features of a URL's text; a null URL is an empty one."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    n = F.char_length(u)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "length": n,
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "depth": count(path, "/[^/]"),
        "host_labels": count(host, r"[^.]+"),
        "host_hyphens": count(host, "-"),
        "host_digits": count(host, "[0-9]"),
        "digit_ratio": F.when(n > 0, count(u, "[0-9]") / n).otherwise(0.0),
        "symbol_ratio": F.when(n > 0, count(u, "[^A-Za-z0-9]") / n).otherwise(0.0),
        "entropy": entropy(u),
        "host_entropy": entropy(host),
        "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0),
        "query_length": F.char_length(query),
        "fragment": u.contains("#").cast("int"),
        "escapes": count(u, "%[0-9A-Fa-f]{2}"),
        "secure": u.startswith("https://").cast("int"),
        "first_segment": F.char_length(F.regexp_extract(path, "^/([^/]*)", 1)),
        "trailing_slash": path.endswith("/").cast("int"),
    }


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: int
    edge: float
    left: Split | Leaf
    right: Split | Leaf
    left_share: float = 0.5  # of the weight that reached this node in training


@dataclass
class Model:
    """A sum of trees over named features; suffix statistics are tables (key, share), one for each number of labels."""

    names: list[str]
    base: float
    trees: list[Split | Leaf]
    suffixes: list[DataFrame]
    prior: float

    def margin(self, features: dict[str, Column]) -> Column:
        def node(t: Split | Leaf) -> Column:
            if isinstance(t, Leaf):
                return F.lit(t.value)
            x, left, right = features[self.names[t.feature]], node(t.left), node(t.right)
            found = F.when(x <= t.edge, left).when(x > t.edge, right)
            # a statistic that isn't known says nothing: the mean of both sides
            return found.otherwise(left * t.left_share + right * (1 - t.left_share)) if self.names[t.feature].startswith("suffix_") else found

        return sum((node(t) for t in self.trees), F.lit(self.base))

    def looked_up(self, rows: DataFrame) -> DataFrame:
        """rows (with host) and the statistics of their hosts' suffixes; null for a suffix that the labelled URLs lack."""
        for k, table in zip(SUFFIXES, self.suffixes, strict=True):
            named = sized(table.withColumnsRenamed({"key": f"__key{k}", "share": f"__share{k}"}))
            rows = rows.join(named, F.xxhash64(suffix(F.col("host"), k)) == F.col(f"__key{k}"), "left").drop(f"__key{k}")
        return rows

    def features(self, url: str) -> dict[str, Column]:
        return lexical(F.col(url), F.col("host"), F.col("path")) | {f"suffix_{k}": F.col(f"__share{k}") for k in SUFFIXES}

    def score(self, rows: DataFrame, url: str) -> DataFrame:
        """rows (with host and path) and score, the margin for block."""
        # each feature is worked out once, as an element of one column, and not at each split that asks for it
        valued = self.looked_up(rows).withColumn("__x", F.array(*[c.cast("double") for c in self.features(url).values()]))
        return valued.withColumn("score", self.margin({name: F.col("__x")[k] for k, name in enumerate(self.names)})).drop("__x", *[f"__share{k}" for k in SUFFIXES])


def suffix_statistics(rows: DataFrame, labels: int, prior: float, weight: float = SUFFIX_WEIGHT) -> DataFrame:
    """Of every host suffix of so many labels (by its hash, key) the share of blocked URLs, drawn to the prior as far as it is rare. rows: host, y, n."""
    summed = rows.groupBy(F.xxhash64(suffix(F.col("host"), labels)).alias("key")).agg(F.sum(F.col("y") * F.col("n")).alias("y"), F.sum("n").alias("n"))
    return stash(summed.select("key", ((F.col("y") + weight * prior) / (F.col("n") + weight)).alias("share")), "suffixes")


def grow(table: DataFrame, edges: list[list[float]], trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[Split | Leaf]]:
    """Boosted trees for logistic loss. table: bins (array of ints, feature value <= edges[f][bin], for the last beyond all), y (0 or 1), n (rows)."""
    blocked, total = table.agg(F.sum(F.col("y") * F.col("n")), F.sum("n")).first()
    base = math.log((blocked + 0.5) / (total - blocked + 0.5))
    grown: list[Split | Leaf] = []

    def scored(t: Split | Leaf) -> Column:
        return F.lit(t.value) if isinstance(t, Leaf) else F.when(F.col("bins")[t.feature] <= edges[t.feature].index(t.edge), scored(t.left)).otherwise(scored(t.right))

    current = table.withColumn("margin", F.lit(base))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("margin")))
        slopes = current.select("bins", ((F.col("y") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))
        paths: dict[int, list[tuple[int, int, bool]]] = {0: []}  # node: splits on its way (feature, bin, left)
        splits: dict[int, tuple[int, int]] = {}
        sums: dict[int, tuple[float, float]] = {}
        for level in range(depth):
            where = F.lit(None).cast("int")
            for node, way in paths.items():
                inside = F.lit(True)
                for f, b, left in way:
                    inside &= (F.col("bins")[f] <= b) if left else (F.col("bins")[f] > b)
                where = F.when(inside, node).otherwise(where)
            cells = slopes.withColumn("node", where).where("node IS NOT NULL").select("node", "g", "h", F.posexplode("bins").alias("f", "b"))
            found: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for node, f, b, g, h in cells.groupBy("node", "f", "b").agg(F.sum("g"), F.sum("h")).collect():
                found.setdefault(node, {}).setdefault(f, {})[b] = (g, h)
            deeper: dict[int, list[tuple[int, int, bool]]] = {}
            for node, by_feature in sorted(found.items()):
                g_all, h_all = (sum(x[k] for x in by_feature[0].values()) for k in (0, 1))
                sums[node] = (g_all, h_all)
                best, choice = 1e-6, None
                for f, hist in sorted(by_feature.items()):
                    g = h = 0.0
                    for b in sorted(hist)[:-1]:
                        g, h = g + hist[b][0], h + hist[b][1]
                        gain = g * g / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all**2 / (h_all + L2)
                        if gain > best + 1e-9:
                            best, choice = gain, (f, b, (g, h))
                if choice:
                    f, b, (g, h) = choice
                    splits[node] = (f, b)
                    sums[2 * node + 1], sums[2 * node + 2] = (g, h), (g_all - g, h_all - h)
                    deeper[2 * node + 1], deeper[2 * node + 2] = [*paths[node], (f, b, True)], [*paths[node], (f, b, False)]
            paths = deeper
            if not paths:
                break

        def tree(node: int, splits=splits, sums=sums) -> Split | Leaf:
            if node not in splits:
                g, h = sums[node]
                return Leaf(round(RATE * g / (h + L2), 9))
            f, b = splits[node]
            return Split(f, edges[f][b], tree(2 * node + 1), tree(2 * node + 2), round(sums[2 * node + 1][1] / sums[node][1], 9))

        if not splits:
            break
        grown.append(tree(0))
        current = current.withColumn("margin", F.col("margin") + scored(grown[-1]))
    return base, grown


def sampled(labelled: DataFrame, url: str, y: str, most: int) -> DataFrame:
    """url, host, path, y and n (rows): about most different URLs at most, each counted, so that one URL in very many rows is one row here."""
    cells = 1 << 20
    known = labelled.select(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), F.col(f"`{y}`").cast("int").alias("y")).where("y IS NOT NULL")
    n = known.agg(F.approx_count_distinct("url")).first()[0]
    chosen = known.where(F.pmod(F.xxhash64("url"), F.lit(cells)) < max(1, min(cells, cells * most // max(1, n)))) if n > most else known
    counted = chosen.groupBy("url", "y").agg(F.count("*").alias("n"))
    return counted.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "y", "n")


def balanced(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows with n such that both labels weigh the same in all, as much as there are rows."""
    half = sum(counts.values()) / 2
    return rows.withColumn("n", F.col("n") * F.when(F.col("y") == 1, half / counts[1]).otherwise(half / counts[0]))


def train(labelled: DataFrame, url: str = "url", y: str = "y", most: int = TRAIN_ROWS) -> Model | None:
    """labelled: a URL and 1 for block, 0 for allow; about most different URLs are used. None if one of the two is missing.

    The two labels weigh the same: how many URLs are labelled block says nothing of how many others should be. Half of the URLs give the suffix statistics and the other half grow the trees, so that no tree is grown on a share its own URL is part of.
    """
    rows = stash(sampled(labelled, url, y, most), "urls")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    rows = balanced(rows, counts)
    prior = 0.5
    first_half = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2)) == 0
    model = Model([], 0.0, [], [suffix_statistics(rows.where(first_half), k, prior) for k in SUFFIXES], prior)
    features = model.features("url")
    model.names = list(features)
    values = stash(model.looked_up(rows.where(~first_half)).select("y", "n", F.array(*[F.coalesce(c.cast("double"), F.lit(prior)) for c in features.values()]).alias("x")), "features")
    cuts = [k / BINS for k in range(1, BINS)]
    quantiles = values.agg(*[F.percentile_approx(F.col("x")[k], cuts, 2000).alias(f"q{k}") for k in range(len(features))]).first()
    edges = [sorted(set(q or [])) for q in quantiles]
    binned = F.array(*[sum(((F.col("x")[k] > e).cast("int") for e in edges[k]), F.lit(0)) for k in range(len(features))])
    table = stash(values.select("y", "n", binned.alias("bins")).groupBy("bins", "y").agg(F.sum("n").alias("n")), "bins")
    # a bin beyond the last edge can't be split off to its right
    model.base, model.trees = grow(table, [[*e, float("inf")] for e in edges])
    return model


def rule_labels(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """url and y: 1 where a rule blocks, 0 where one allows, null where none fits."""
    u = F.col(f"`{url}`").cast("string")
    verdict = longest_rule(rules, host_of(u), path_of(u), "verdict")
    return pages.select(u.alias("url"), F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("y"))


def held_out_loss(labelled: DataFrame, url: str = "url", y: str = "y", parts: int = 10) -> tuple[float, float] | None:
    """Log loss and accuracy on one of so many parts of the URLs by a model of the others, each the mean of the two labels' means (saying nothing: 0.693 and 0.5). None if there is nothing to learn or to hold out."""
    held = F.pmod(F.xxhash64(F.coalesce(F.col(url).cast("string"), F.lit("")), F.lit(2)), F.lit(parts)) == 0
    model = train(labelled.where(~held), url, y)
    if model is None:
        return None
    scored = model.score(sampled(labelled.where(held), url, y, TRAIN_ROWS), "url").withColumn("p", 1 / (1 + F.exp(-F.col("score"))))
    loss = F.sum(-F.col("n") * F.when(F.col("y") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))) / F.sum("n")
    right = F.sum(F.when((F.col("score") > 0) == (F.col("y") == 1), F.col("n")).otherwise(0)) / F.sum("n")
    by_label = scored.groupBy("y").agg(loss, right).collect()
    return (sum(r[1] for r in by_label) / 2, sum(r[2] for r in by_label) / 2) if len(by_label) == 2 else None


def judge(pages: DataFrame, rules: list[Rule], *, url: str = "url", keep: list[str] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """keep (all columns if not given), host, path, rule (the longest fitting rule's string, else null), score (the model's margin for block) and verdict: the rule's, else block
    if score is over 0.

    The trees learn from labelled (url, y), or if that isn't given from the URLs that the rules settle. If one of the two labels has no example the score is null and the
    verdict allow. A null URL, and one without ://, has an empty host and path, fits no rule and is judged by its features. Repeated URLs are judged each; an empty table gives
    no rows. Columns of keep named as results give way.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "score", "verdict")]
    u = F.col(f"`{url}`").cast("string")
    kept = [f"__keep{k}" for k in range(len(keep))]  # names that can't clash on the way
    ruled = pages.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(keep, kept, strict=True)], u.alias("__url"), host_of(u).alias("host"), path_of(u).alias("path"))
    ruled = ruled.withColumns({"rule": longest_rule(rules, F.col("host"), F.col("path"), "rule"), "__by_rule": longest_rule(rules, F.col("host"), F.col("path"), "verdict")})
    model = train(rule_labels(pages, rules, url) if labelled is None else labelled)
    judged = ruled.withColumn("score", F.lit(None).cast("double")) if model is None else model.score(ruled, "__url")
    return judged.select(*[F.col(name).alias(c) for c, name in zip(keep, kept, strict=True)], "host", "path", "rule", "score", F.coalesce("__by_rule", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))
