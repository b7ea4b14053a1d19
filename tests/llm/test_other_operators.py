"""URL filters, personal data, sharding, near-duplicates, nearest neighbours, archives and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann as A
from corpusmill.llm import components as CC
from corpusmill.llm import minhash as M
from corpusmill.llm import pii
from corpusmill.llm import queries as Q
from corpusmill.llm import sharding as S
from corpusmill.llm import urls as U
from corpusmill.llm import warc as W

from ..oracle import connected, same

# ---- URLs

URLS = [
    ("https://WWW.Example.com/en/1?a=b", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://b.net/es/?q#f", "b.net", "/es/", "net/es/", "block"),
    ("http://b.net/de/", "b.net", "/de/", None, None),
    ("http://x.com", "x.com", "", None, None),
    ("HTTP://É.Net?x=/fr/", "É.net", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("x\n://h.net/fr/\n?", "h.net", "/fr/\n", "net/fr/", "block"),
]


def test_hosts_and_rules(spark):
    df = spark.createDataFrame([(k, u[0]) for k, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in U.judge(df, Q.URL_RULES).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (verdict or got[k].verdict) and got[k].verdict in ("allow", "block")
    assert U.judge(df.where("false"), Q.URL_RULES).count() == 0


def test_trees_learn(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(f"http://{word()}.org/{word()}" if k % 3 else f"http://{word()}-{word()}.org/{r.randint(1000, 9999)}?{word()}=1&b=2", int(k % 3 == 0)) for k in range(600)]
    train, held = spark.createDataFrame(rows[:400], "url string, y int"), spark.createDataFrame(rows[400:], "url string, y int")
    got = U.judge(held, [], labelled=train).collect()
    assert np.mean([(x.verdict == "block") == (x.y == 1) for x in got]) > 0.97
    only = U.judge(held, [], labelled=train.where("y = 0"))
    assert only.where("verdict <> 'allow' OR score IS NOT NULL").count() == 0


def test_labels_come_from_the_rules(spark):
    r = random.Random(18)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rules = [U.Rule("com", "/", "allow"), U.Rule("net", "/x", "block")]
    rows = [(k, f"http://{word()}.com/{word()}" if k % 2 else f"http://{word()}.net/x{word()}?a={k}&b=1") for k in range(300)] + [(1000, "http://aabbcc.org/abcdef"), (1001, "http://aabbcc.net/yabcdef?a=5&b=1"), (1002, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit("clash")).withColumn("__url", F.lit("clash")).withColumn("n", F.lit("clash"))
    labels = U.rule_labels(pages, rules)
    assert {(x.y, x["count"]) for x in labels.groupBy("y").count().collect()} == {(0, 150), (1, 150), (None, 3)}
    got = U.judge(pages, rules)
    assert got.columns == ["page_id", "url", "__url", "n", "host", "path", "rule", "score", "verdict"] and got.count() == 303
    verdicts = {x.page_id: x.verdict for x in got.collect()}
    assert verdicts[1001] == "block" and verdicts[1000] == "allow"
    loss, right = U.held_out_loss(labels)
    assert loss < 0.3 and right > 0.95
    assert U.held_out_loss(labels.where("y = 1")) is None


def test_all_suffixes_count(spark):
    rows = [(f"h{k % 400}.example", k % 400 % 2, 1 + k % 3) for k in range(800)]
    table = U.suffix_statistics(spark.createDataFrame(rows, "host string, y int, n long"), 2, 0.5)
    got = {x.key: x.share for x in table.collect()}
    assert len(got) == 400
    key = spark.createDataFrame([("a.h7.example",)], "host string").select(F.xxhash64(U.suffix(F.col("host"), 2))).first()[0]
    n = sum(x[2] for x in rows if x[0] == "h7.example")
    assert got[key] == pytest.approx((n + 10) / (n + 20))


def plain_trees(rows, edges, trees, depth):
    """rows: bins, y, n. Exact greedy search over all splits, node by node."""
    blocked, total = sum(y * n for _, y, n in rows), sum(n for _, _, n in rows)
    base = np.log((blocked + 0.5) / (total - blocked + 0.5))
    margin, out = np.full(len(rows), base), []
    bins, y, n = np.array([b for b, _, _ in rows]), np.array([y for _, y, _ in rows]), np.array([n for _, _, n in rows])

    def node(mine, level, g, h):
        if level < depth:
            best = (1e-6, None)
            for f in range(bins.shape[1]):
                for b in sorted({*bins[mine, f]})[:-1]:
                    left = mine & (bins[:, f] <= b)
                    gl, hl, ga, ha = g[left].sum(), h[left].sum(), g[mine].sum(), h[mine].sum()
                    gain = gl**2 / (hl + U.L2) + (ga - gl) ** 2 / (ha - hl + U.L2) - ga**2 / (ha + U.L2)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b))
            if best[1]:
                f, b = best[1]
                return (f, edges[f][b], node(mine & (bins[:, f] <= b), level + 1, g, h), node(mine & (bins[:, f] > b), level + 1, g, h))
        return U.RATE * g[mine].sum() / (h[mine].sum() + U.L2)

    def add(t, mine):
        if isinstance(t, tuple):
            f, edge, left, right = t
            low = bins[:, f] <= edges[f].index(edge)
            add(left, mine & low)
            add(right, mine & ~low)
        else:
            margin[mine] += t

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(node(np.ones(len(rows), bool), 0, (y - p) * n, p * (1 - p) * n))
        add(out[-1], np.ones(len(rows), bool))
    return out


def test_trees_like_brute_force(spark):
    r = random.Random(28)
    rows = []
    for _ in range(150):
        b = [r.randrange(4) for _ in range(3)]
        rows.append((b, int(b[0] + b[1] + r.randrange(3) > 4), r.randint(1, 5)))
    edges = [[0.5, 1.5, 2.5, float("inf")]] * 3

    def plain(t):
        return (t.feature, t.edge, plain(t.left), plain(t.right)) if isinstance(t, U.Split) else pytest.approx(t.value, abs=1e-6)

    _, got = U.grow(spark.createDataFrame(rows, "bins array<int>, y int, n long"), edges, 3, 2)
    assert plain_trees(rows, edges, 3, 2) == [plain(t) for t in got]


def test_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("aaaa",), ("abcd",), ("éü",)], "t string")
    assert [round(x[0], 6) for x in df.select(U.entropy(F.col("t"))).collect()] == [1.0, 0.0, 0.0, 2.0, 0.0]


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    r = random.Random(9)
    bits = ["a@b.co", "x.y%z@d-e.org", "@", ".", "1.2.3.4", "300.1.1.1", "001.2.3.255", " ", "é", "\U0001f600", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111111111111112", "7", "-", "42", "word", "\n", "a@b", "c.d", "378282246310005"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(400)] + [None, "", "9" * 20_000, "a" * 20_000, "1-" * 9_000, "a@b.co " * 300, "1.1.1.1." * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    for row in pii.find_personal(df).collect():
        found = [(s.kind, s.begin, s.end) for s in row.spans if s.base]
        assert found == plain_spans(texts[row.doc_id]), texts[row.doc_id]
        assert set(found) <= {(s.kind, s.begin, s.end) for s in row.spans}
    assert pii.find_personal(df.where("false")).count() == 0


def test_classifier_adds_and_redacts(spark):
    rows = [(k, f"please call me, phone (555) 234-56{k:02d} now, mail a{k}@b.org or +1 555 234 56{k:02d}") for k in range(60)] + [(100, "reach john (at) mail (dot) example.com"), (101, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal(df)
    assert found.where("exists(spans, s -> NOT s.base)").count() > 50
    clean = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted("text", F.col("spans")).alias("t")).collect()}
    assert "@b.org" not in clean[3] and "234" not in clean[3] and "<email>" in clean[3] and clean[101] is None


def test_spans_cost_no_more_than_text(spark):
    rows = [(k, "".join(f"ab{j}@c.de w " for j in range(n))) for k, n in enumerate((50, 16_000, 64_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pii.find_personal(df.where("doc_id = 0")).collect()
    for k, most in ((1, 8), (2, 16)):
        begin = time.time()
        found = pii.find_personal(df.where(f"doc_id = {k}"))
        (got,) = found.select(F.size("spans").alias("n"), F.md5(pii.redacted("text", F.col("spans"))).alias("t")).collect()
        n = rows[k][1].count("@")
        assert (got.n, got.t) == (n, hashlib.md5(b"<email> w " * n).hexdigest()) and time.time() - begin < most


def test_cut_and_running(spark):
    text = "".join(chr(97 + k % 26) if k % 7 else "\U0001f600" for k in range(3000))
    df = spark.createDataFrame([(text, b, e) for b, e in [(0, 0), (0, 1), (1023, 1025), (1024, 1024), (0, 3000), (2040, 2060), (2999, 3000), (3000, 3000)]], "t string, b long, e long")
    assert [r.c for r in df.select(pii.cut(pii.pieces_of(F.col("t")), F.col("b"), F.col("e")).alias("c"), "b", "e").collect()] == [text[b:e] for b, e in [(0, 0), (0, 1), (1023, 1025), (1024, 1024), (0, 3000), (2040, 2060), (2999, 3000), (3000, 3000)]]
    r = random.Random(19)
    lists = [[], [5], [r.randint(0, 99) for _ in range(127)], [r.randint(0, 99) for _ in range(1000)]]
    got = spark.createDataFrame([(x,) for x in lists], "v array<long>").select(pii.running(F.col("v"), pii.zero(), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), pii.zero(), F.greatest).alias("m")).collect()
    for x, row in zip(lists, got, strict=True):
        assert row.s == [sum(x[:k]) for k in range(len(x))] and row.m == [max(x[:k], default=0) for k in range(len(x))]


def test_added_spans_keep_off_base_spans(spark):
    spans = [(0, 0, 10, True), (1, 5, 8, False), (1, 10, 12, False), (2, 11, 20, False), (2, 30, 40, True), (3, 25, 31, False), (3, 41, 42, False), (1, 20, 30, False)]
    df = spark.createDataFrame([(spans,), ([],), ([(0, 1, 2, True)],)], "s array<struct<k: tinyint, begin: bigint, end: bigint, base: boolean>>")
    got = [sorted(tuple(x)[1:3] for x in r[0]) for r in df.select(pii.apart(F.col("s"))).collect()]
    assert got == [[(10, 12), (11, 20), (20, 30), (41, 42)], [], []]


def test_obfuscated_forms_are_candidates(spark):
    texts = ["server 10[.]20[.]30[.]40 is up", "card 4111.1111.1111.1111 paid", "write ann [at] mail [dot] org", "call (555) 234-5678", "version 1.2.3 of 1000.2000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [pii.KINDS[c.kind] for c in r.candidates if not c.base and c.format > 0] for r in pii.candidates(df, "text", ["doc_id"]).collect()}
    assert got == {0: ["ip"], 1: ["card"], 2: ["email"], 3: ["phone"], 4: []}


def test_expectation_maximisation_like_the_definition():
    r = random.Random(29)
    votes = [(0, *(r.choice([-1, 0, 1]) for _ in range(3))) for _ in range(60)] + [(0, 1, 1, 1)] * 30 + [(0, -1, -1, -1)] * 40
    counted = [(p, votes.count(p)) for p in sorted(set(votes))]
    # plainly, span by span: the same start, priors and order of steps
    belief = [(1 + sum(v > 0 for v in p[1:])) / (2 + sum(v != 0 for v in p[1:])) for p in votes]
    for _ in range(50):
        prior = (1 + sum(belief)) / (2 + len(votes))
        yes = {(j, t): ((18 if t else 2) + sum((b if t else 1 - b) for b, p in zip(belief, votes, strict=True) if p[j] > 0)) / (20 + sum((b if t else 1 - b) for b, p in zip(belief, votes, strict=True) if p[j])) for j in (1, 2, 3) for t in (0, 1)}
        new = []
        for p in votes:
            likely = [(prior if t else 1 - prior) * np.prod([yes[j, t] if p[j] > 0 else 1 - yes[j, t] for j in (1, 2, 3) if p[j]]) for t in (0, 1)]
            new.append(likely[1] / sum(likely))
        done, belief = max(abs(a - b) for a, b in zip(new, belief, strict=True)) < 1e-6, new
        if done:
            break
    got = pii.reliabilities(counted)
    assert [got[p] for p in votes] == pytest.approx(belief, abs=1e-9)


def test_expectation_maximisation():
    belief = pii.reliabilities([((0, 1, 1), 80), ((0, -1, -1), 80), ((0, 1, -1), 5), ((0, 1, 0), 3)])
    assert belief[0, 1, 1] > 0.95 > 0.2 > belief[0, -1, -1]
    assert pii.reliabilities([]) == {}


# ---- sharding


def test_histogram_sort(spark):
    r = random.Random(10)
    rows = [(k, r.randint(1, 100), None if k % 50 == 0 else 5 if k % 3 == 0 else r.getrandbits(63) - (1 << 62)) for k in range(4000)] + [(1, 7, 9)] * 20
    df = spark.createDataFrame(rows, "doc_id long, size long, key long").withColumn("slot", F.lit("clash"))
    key = Q.text_group_key("key", "doc_id")
    got = S.histogram_sort(df, key, F.col("size"), shards=6).toPandas()
    assert len(got) == len(rows)
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 6 and sums.max() < 1.02 * sums.mean() and sums.min() > 0.98 * sums.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert S.histogram_sort(df.where("false"), key, F.col("size")).count() == 0
    one = S.histogram_sort(df, F.lit(3).cast("long"), F.col("size"), shards=4).toPandas()
    assert one.shard.nunique() == 1 and sorted(one.slot) == list(range(len(rows)))


def test_shards_are_ordered(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") * 7919 % 2003 - 1000).alias("k"))
    got = S.histogram_sort(df, F.col("k"), F.lit(1), shards=5).orderBy("shard", "slot").collect()
    assert [r.k for r in got] == sorted(r.k for r in got)
    assert {r["count"] for r in S.histogram_sort(df, F.col("k"), F.lit(1), shards=5).groupBy("shard").count().collect()} == {400}


# ---- near-duplicates


def copies(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(r.randint(0, 30))
    bases = [[word() for _ in range(r.randint(30, 90))] for _ in range(12)]
    out = []
    for k in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = word()
        out.append((k, " ".join(w)))
    return out


def plain_shingles(t):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    return Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(1, len(words)))))


def plain_similarity(a, b):
    """Probability Jaccard by its definition, over weights 1 + ln(count)."""
    w = [{k: 1 + math.log(n) for k, n in x.items()} for x in (a, b)]
    total = 0.0
    for i in w[0].keys() & w[1].keys():
        total += 1 / sum(max(w[0].get(j, 0) / w[0][i], w[1].get(j, 0) / w[1][i]) for j in w[0].keys() | w[1].keys())
    return total


def plain_classes(docs, threshold=0.8):
    """The class of each document, by comparing all pairs (those whose sizes rule a link out are left aside)."""
    parent = {d: d for d, _ in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    bags = [(d, plain_shingles(t)) for d, t in docs]
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            few = len(x.keys() & y.keys())
            if few and root(a) != root(b) and (x == y or few > 0.4 * max(len(x), len(y))) and plain_similarity(x, y) >= threshold - 1e-12:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d, _ in docs}


def boilerplate(seed, n, own=25, shared=150):
    """Texts that share most of their words, some with a near copy."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    common = " ".join(word() for _ in range(shared))
    out = []
    for k in range(n):
        mine = [word() for _ in range(own)] if k % 10 else [*out[-1][1].split()[:own][:-1], word()] if out else [word() for _ in range(own)]
        out.append((k, " ".join(mine) + " " + common))
    return out


@pytest.mark.parametrize("common", [4, M.COMMON])
def test_shared_boilerplate_like_brute_force(spark, common, monkeypatch):
    monkeypatch.setattr(M, "COMMON", common)
    monkeypatch.setattr(M.rare_pairs, "__defaults__", (common,))
    docs = [*boilerplate(21, 60), *[(d + 1000, t) for d, t in boilerplate(22, 40, 12, 160)], *[(d + 2000, t) for d, t in boilerplate(23, 30, 40, 60)]]
    got = {r.id: r.class_id for r in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_classes(docs)


def test_pairs_grow_with_documents(spark):
    looked = []
    for n in (600, 2400):
        report = {}
        M.near_duplicates(spark.createDataFrame(boilerplate(24, n), "doc_id long, text string"), report=report)
        looked.append(sum(report.values()))
    assert looked[1] / looked[0] < 4**1.2, looked


def test_classes_like_brute_force(spark):
    docs = [*copies(11, 160), (500, None), (501, ""), (502, "..."), (503, "a b"), (504, "A, b!"), (505, "a c"), (3, dict(copies(11, 160))[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit(1)).withColumn("n", F.lit(1))
    got = {r.id: r.class_id for r in M.near_duplicates(df).collect()}
    assert got == plain_classes(list(dict(docs).items()))
    assert M.near_duplicates(df).count() == len(docs)
    assert M.near_duplicates(df.where("false")).count() == 0
    none = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (None, "else where")], "doc_id long, text string")
    assert sorted((str(r.id), str(r.class_id)) for r in M.near_duplicates(none).collect()) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_signatures_estimate_probability_jaccard():
    a, b = "one two three four five six seven eight nine ten " * 2 + "x y z", "one two three four five six seven eight nine ten eleven x y z w"
    e, c, f = M.weighted(pa.array([a, b], pa.large_string()))
    sig = M.signatures(e, M.weight(c), f, 4096)
    exact = M.similarity(a, b)
    assert 0.05 < exact < 0.95 and abs((sig[0] == sig[1]).mean() - exact) < 0.04
    assert M.similarity(a, a) == pytest.approx(1.0) and M.similarity(a, "") == 0.0


def test_probability_jaccard_by_definition():
    wa, wb = {1: 1, 2: 3, 3: 1}, {2: 1, 3: 1, 4: 2}
    w = lambda c: 1 + np.log(c) if c else 0.0
    keys = sorted({*wa, *wb})
    by_hand = sum(1 / sum(max(w(wa.get(j, 0)) / w(wa[i]), w(wb.get(j, 0)) / w(wb[i])) for j in keys) for i in keys if i in wa and i in wb)
    arrays = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
    assert M.probability_jaccard(*arrays(wa), *arrays(wb)) == pytest.approx(by_hand)


def test_components(spark):
    r = random.Random(12)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}
    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.id: x.component for x in CC.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for a, b in edges if a != b for k in (a, b)}
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- nearest neighbours


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 12)).astype(np.float32) * rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    x[100:400] = x[100]
    return x


def exact(rows, queries, k):
    """Plain: for each query (a place in rows) the places of its neighbours, best first, ties to the smaller id."""
    out = []
    for q in queries:
        scored = [(-sum(float(a) * float(b) for a, b in zip(v, rows[q][1], strict=True)), i, p) for p, (i, v) in enumerate(rows) if p != q]
        out.append([p for _, _, p in sorted(scored)[:k]])
    return out


def test_recall_and_order(spark, vectors):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    report = {}
    got = A.search(df, F.col("vec_id") % 20 == 0, k=20, region_rows=100, report=report).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    plain = vectors.astype(float) @ vectors.astype(float).T
    np.fill_diagonal(plain, -np.inf)
    assert by.keys() == set(range(0, 3000, 20)) and report["regions"] > 10 and report["share"] < 0.5
    for rows in by.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r.score, r.id)) and all(r.id != r.query_id for r in rows)
        assert all(abs(r.score - vectors[r.id].astype(float) @ vectors[r.query_id].astype(float)) < 1e-9 for r in rows)
    # of equal scores any is as good
    assert np.mean([sum(r.score >= np.sort(plain[q])[-20] - 1e-9 for r in by[q]) / 20 for q in by]) >= 0.9


@pytest.mark.parametrize("region_rows", [40, 1024])
def test_repeated_ids_are_rows_of_their_own(spark, region_rows):
    rng = np.random.default_rng(14)
    rows = [(k % 150, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 6)))] + [(7, [3.0] * 6)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = A.search(df, F.col("vec_id") % 20 == 0, k=301, region_rows=region_rows, recall=1.0).collect()
    queries = [p for p, (i, _) in enumerate(rows) if i % 20 == 0]
    want = sorted((rows[q][0], n + 1, rows[p][0]) for q, near in zip(queries, exact(rows, queries, 301), strict=True) for n, p in enumerate(near))
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == want


def test_bounds_are_a_queue(vectors):
    import heapq

    x = vectors[:400].astype(float)
    tree = A.Tree.fit(x, 40)
    q = x[:9] * 2
    d, key, sizes = tree.distances(q), tree.keys(q), np.bincount(tree.assign(x), minlength=tree.leaf.max() + 1)
    for bound, least in ((-1.0, 0), (3.0, 0), (-1e9, 30), (1e9, 0)):
        seen, _ = A.popped(tree.keys(q), sizes, np.full(len(q), bound), np.full(len(q), least))
        for i in range(len(q)):
            heap, out, rows = [(-np.inf, 0)], set(), 0
            while heap and (heap[0][0] <= bound or rows < least):
                _, node = heapq.heappop(heap)
                if tree.leaf[node] >= 0:
                    out.add(int(tree.leaf[node]))
                    rows += sizes[tree.leaf[node]]
                else:
                    for kid in tree.children[node]:
                        if kid >= 0:
                            heapq.heappush(heap, (d[i, kid], int(kid)))
            mine = np.flatnonzero(seen[i])
            if least:  # leaves behind the same inner node may change places
                assert max(key[i, mine]) == max(key[i, sorted(out)]) and sizes[mine].sum() >= least
            else:
                assert out == set(mine.tolist())


def test_query_reaches_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = Q.op9_kmeans_tree(spark, sf).collect()
    queries = [p for p, (i, _) in enumerate(rows) if i % 20 == 0]
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    true = exact(rows, queries, 20)
    assert np.mean([len({rows[p][0] for p in near} & found[rows[q][0]]) / len(near) for q, near in zip(queries, true, strict=True)]) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [5.0, 5.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.id) for r in A.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 7), (0, 2, 7), (0, 3, 8), (0, 4, 20), (20, 1, 7), (20, 2, 7), (20, 3, 8), (20, 4, 0)]
    assert A.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert A.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


# ---- archives

PAGES = [(5, "http://x/é", "same"), (3, None, "same"), (9, "http://y", "same"), (4, "u", None), (8, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (6, "u", "big " * 50_000), (2, "u", "\x1f\x8b")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("key", F.lit("clash"))
    for k, limit in enumerate((1, 3000, W.FILE_BYTES)):
        W.write_warc(W.classify(df, url="url"), str(tmp_path / f"w{k}"), file_bytes=limit)
        archive = W.read_warc(spark, str(tmp_path / f"w{k}"), "part-*")
        assert W.gaps(archive).count() == 0 and W.quarantine(archive, str(tmp_path / "log")) == 0 and not (tmp_path / "log").exists()
        got = {r.record_id.split(":")[2] or None: r for r in W.resolve(archive).collect()}
        assert len({r.record_id for r in got.values()}) == len(PAGES) == len(got)
        for page, _, html in PAGES:
            assert got[str(page) if page is not None else None].payload.decode() == (html or "")
        assert {k for k, r in got.items() if r.record_type == "revisit"} == {"5", "9", None, "8"}
        assert all(r.refers_to.startswith("<urn:page:3:") for k, r in got.items() if k in ("5", "9"))
    assert archive.select("file").distinct().count() <= df.rdd.getNumPartitions()
    one = {r.record_type for r in W.classify(df, least=10**9).collect()}
    assert one == {"response"}
    heads = {r.h["warc-target-uri"] for r in archive.select(F.col("headers").alias("h")).collect()}
    assert "http://x/é" in heads and {r[0] for r in archive.select(F.col("headers")["content-type"]).where("headers['warc-type'] = 'response'").collect()} == {"application/http; msgtype=response"}
    W.write_warc(W.classify(df.where("false")), str(tmp_path / "none"))
    assert W.read_warc(spark, str(tmp_path / "none"), "part-*").count() == 0


def test_catalogue_reads_payloads(spark, tmp_path):
    pages = [*PAGES, (4, "u", None), (4, "v", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    W.write_warc(W.classify(df), str(tmp_path / "w"))
    rows = W.catalogue(W.read_warc(spark, str(tmp_path / "w"), "part-*")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = next(h for p, _, h in pages if str(p) == str(r.page_id)) or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    names = spark.createDataFrame([("a b>:/é", "x"), ("z", "x")], "page_id string, html string")
    W.write_warc(W.classify(names), str(tmp_path / "names"))
    got = W.catalogue(W.read_warc(spark, str(tmp_path / "names"), "part-*")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [("a b>:/é", "response", None), ("z", "revisit", "a b>:/é")]


def test_damage_is_logged(spark, tmp_path):
    (tmp_path / "in").mkdir()
    whole = b"".join(records(6))
    (tmp_path / "in" / "a.warc").write_bytes(whole[:300] + b"\0" * 40 + whole[340:])
    archive = W.read_warc(spark, str(tmp_path / "in"))
    n = W.quarantine(archive, str(tmp_path / "log"))
    assert n > 0 and spark.read.parquet(str(tmp_path / "log")).count() == n


def test_salvage_is_linear():
    one = W.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", "<1>")], b"text " * 400, False)
    for data in (one * 38_000, b"WARC/ \x1f\x8b\x08" * 500_000, b"WARC/1.0\r\nx" * 400_000):
        begin = time.time()
        kinds = {x[1] for x in W.salvage(data)}
        assert kinds == ({"record"} if data.startswith(one) else {"gap"}) and time.time() - begin < 10


def records(n):
    body = lambda k: b"body %d " % k * 50
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    return [W.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{k}>"), ("WARC-Block-Digest", f"sha1:{digest(body(k))}")], body(k), k % 2 == 0) for k in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_salvage(seed):
    r = random.Random(seed)
    parts = records(12)
    bad = set(r.sample(range(12), 3))
    data = b""
    for k, p in enumerate(parts):
        if k in bad:
            at = r.randrange(len(p) - 8)
            p = r.choice([p[:at], p[:at] + b"\0\1\2\3" + p[at + 4 :], b"junk" + p[5:], p[: len(p) // 2]])
        data += p
    found = list(W.salvage(data))
    ids = [h["warc-record-id"] for *_, h, _ in found if h]
    assert {f"<{k}>" for k in range(12) if k not in bad} <= set(ids) and ids == sorted(ids, key=lambda x: int(x[1:-1]))
    at = 0
    for offset, _, n, *_ in found:  # records and gaps cover every byte once
        assert offset == at
        at += n
    assert at == len(data)


def test_salvage_of_nothing_and_of_other_files():
    assert list(W.salvage(b"")) == []
    assert [x[1] for x in W.salvage(b"no archive")] == ["gap"]
    whole = gzip.compress(b"".join(records(4)[1::2]))
    assert [x[1] for x in W.salvage(whole)] == ["record", "record"]


def test_salvage_inside_damaged_members():
    plain = [gzip.decompress(p) if p[:2] == b"\x1f\x8b" else p for p in records(8)]
    ids = lambda found: [int(h["warc-record-id"][1:-1]) for *_, h, _ in found if h]
    kinds = lambda found: [x[1] for x in found]
    # one record of a sound member fails its digest, another has no version line
    bad = [p.replace(b"body 3", b"BODY 3") if k == 3 else b"junk" + p[5:] if k == 5 else p for k, p in enumerate(plain)]
    found = list(W.salvage(gzip.compress(b"".join(bad))))
    assert ids(found) == [0, 1, 2, 4, 6, 7] and kinds(found).count("gap") == 2
    for level in (0, 6):  # stored bytes show the same records twice: in the file and inflated
        whole = gzip.compress(b"".join(plain), level, mtime=0)
        # cut off at every place: what is whole comes out, once, and records and the gap behind them cover the file
        for cut in range(20, len(whole), 23):
            found = list(W.salvage(whole[:cut]))
            shown = len(zlib.decompressobj(31).decompress(whole[:cut]))
            assert ids(found) == [k for k in range(8) if sum(map(len, plain[: k + 1])) <= shown]
            assert not ids(found) or {x[:3:2] for x in found if x[1] == "record"} == {(0, next((x[0] for x in found if x[1] == "gap" and x[0]), cut))}
        # changed in the middle, and in the check sum; the next member stays
        for at in (len(whole) // 2, len(whole) - 6):
            found = list(W.salvage(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :] + records(1)[0]))
            got = ids(found)
            assert got[-1] == 0 and got[:-1] == sorted(set(got[:-1])) and "gap" in kinds(found) and got[0] == 0 and len(got) > 1
    # in a member whose check sum fails a record without a digest is not known to be intact
    one = W.record_bytes([("WARC-Record-ID", "<1>")], b"text")
    assert kinds(W.salvage(one)) == ["record"] and kinds(W.salvage(one[:-8] + b"sums" + one[-4:])) == ["gap"]


# ---- queries and pipeline


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same(connected(sf), Q.queries()[name](spark, sf), Q.oracle_sql()[name])


def test_a_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.queries()) == list(range(1, 11))


def test_url_query_rules(spark, sf):
    got = Q.op1_url_filters(spark, sf)
    hosts = duckdb.sql(f"select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) p from '{sf}/pages.parquet'").fetchall()
    rows = {r.page_id: r for r in got.collect()}
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for page, host, path in hosts:
        fit = [(a + b, v) for a, b, v in rules if (host == a or host.endswith("." + a)) and path.startswith(b)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, rows[page].verdict)
        assert (rows[page].host, rows[page].path, rows[page].rule, rows[page].verdict) == (host, path, rule, verdict)


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        texts = {r.doc_id: r.text for r in before.collect()} if "text" in before.columns else {}
        if name == "quality_classifier":
            good = [d for d, x in labels.items() if x.quality == 1 and x.toxic == 0]
            assert np.mean([d in kept[name] for d in good]) > 0.95
        elif name == "minhash_near_dedup":
            assert kept[name].keys() == {d for d, c in plain_classes(sorted(texts.items())).items() if d == c}
        elif name == "pii":
            assert not any(plain_spans(r.text) for r in kept[name].values())
            assert all(r.n_chars == len(r.text) for r in kept[name].values()) and kept[name].keys() == texts.keys()
        elif name == "best_fit_packing":
            assert {d for d in kept[name]} == texts.keys()
    assert len(P.STAGES) == 5 and P.run(spark, sf).count() == docs.count()


ODD_DOCS = [
    (1, None, "en", "s", None, "x"),
    (2, "", "en", "s", 0, "x"),
    (3, "mail me at ann@example.org or +1 555 234 5678 today please", None, None, 58, None),
    (3, "mail me at ann@example.org or +1 555 234 5678 today please", None, None, 58, None),
    (3, "another text under the same id, with nine words", "en", "t", 47, "y"),
    (None, "no id here but words enough to be looked at twice", "en", "s", 49, "x"),
    (None, "no id here but words enough to be looked at twice", "en", "s", 49, "x"),
    (5, "word " * 40_000, "en", "s", 200_000, "x"),
    (6, "!!! ... \n\n", "de", "s", 10, "x"),
]
ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string"


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the sort is said in any text here"), (2, None), (None, "no id here but words enough to be looked at")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"])
def test_stages_on_odd_tables(spark, odd_tables, name):
    import corpus_pipeline as P

    stage = dict(P.STAGES)[name]
    docs = spark.createDataFrame(ODD_DOCS, ODD_COLUMNS)
    out = stage(spark, docs, odd_tables)
    rows = out.collect()
    key = lambda r: tuple(str(x) for x in r)
    if name == "best_fit_packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 5, 6, None} and len([r for r in rows if r.doc_id == 3]) == 3
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    else:
        assert out.columns == docs.columns
    if name == "quality_classifier":
        assert {key(r) for r in rows} <= {key(r) for r in ODD_DOCS}
    elif name == "minhash_near_dedup":
        # of the rows of id 3 the one of the least text stays
        assert sorted(map(key, rows)) == sorted(map(key, [r for k, r in enumerate(ODD_DOCS) if k not in (2, 3)]))
    elif name == "benchmark_decontamination":
        assert sorted(map(key, rows)) == sorted(map(key, ODD_DOCS))
    elif name == "pii":
        assert sorted(r.text for r in rows if r.doc_id == 3) == ["another text under the same id, with nine words"] + ["mail me at <email> or <phone> today please"] * 2
        assert [r.n_chars for r in rows if r.doc_id in (1, 2)] in ([None, 0], [0, None]) and all(r.spans is None for r in rows) and len(rows) == len(ODD_DOCS)
    assert stage(spark, docs.where("false"), odd_tables).count() == 0
    assert stage(spark, docs.select("doc_id", "text").where("doc_id < 3"), odd_tables).count() == 2


def test_sharding_query_keeps_its_contract(spark, tmp_path):
    r = random.Random(31)
    texts = [None, "", "é" * 9, *["w " * r.randint(0, 40) + str(r.randrange(60)) for _ in range(900)]]
    rows = [(k, r.choice(texts)) for k in range(1500)] + [(2000, None), (2001, ""), (None, "x"), (7, "again"), (7, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op6_histogram_sharding(spark, str(tmp_path)).collect()
    plain = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == plain
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}
    shards = {}
    for x in got:
        shards.setdefault(x.shard, []).append(x)
    assert set(shards) == set(range(24))
    sums = [sum(x.size for x in part) for part in shards.values()]
    assert max(sums) - min(sums) <= 2 * max(x[1] for x in plain)
    for part in shards.values():
        assert sorted(x.slot for x in part) == list(range(len(part)))
    # equal texts, null and empty too, lie side by side in the order of shards and slots
    order = [x.text_crc32 for x in sorted(got, key=lambda x: (x.shard, x.slot))]
    assert len([k for k, _ in itertools.groupby(order)]) == len(set(order))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert Q.op6_histogram_sharding(spark, f"{tmp_path}/none").count() == 0
