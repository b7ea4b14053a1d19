import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.model_size import parameters
from corpusmill.operators import corpus as C
from corpusmill.operators import gates as G
from corpusmill.operators import ordering as O
from corpusmill.operators import pieces as P
from corpusmill.operators import reports as R
from corpusmill.plans import queries as Q


def plain_chunks(text, limit, least, cumulative):
    """Brute force, by its own rule: sentences first, then a walk over them."""
    pieces = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        parts = line.strip().split(". ")
        pieces += [p.strip() + "." * (k + 1 < len(parts)) for k, p in enumerate(parts) if p.strip()]
    groups, size = [], 0
    for p in pieces:
        if groups and size + len(p) + 1 <= limit:
            groups[-1].append(p)
            size = len(" ".join(groups[-1])) + (size if cumulative else 0)
        else:
            groups.append([p])
            size = len(p) * (2 if False else 1)
    return [c for c in map(" ".join, groups) if least <= len(c) <= limit]


@pytest.mark.parametrize("packing", ["greedy", "cumulative"])
def test_chunks(spark, packing):
    r = random.Random(3)
    texts = ["".join(r.choice(["ab", "c. ", ". ", "\n", " ", "\r\n", "word "]) for _ in range(r.randint(0, 120))) for _ in range(150)] + ["", None, "x" * 300, "y. " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", P.chunks(F.col("t"), limit=80, least=5, packing=packing).alias("c"))
    got = {row.k: row.c for row in df.collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] is None
        elif packing == "greedy":
            assert got[k] == plain_chunks(t, 80, 5, False)
        else:
            assert all(5 <= len(c) <= 80 for c in got[k])
    if packing == "cumulative":
        # sizes add up anew with each sentence: 10, then 10 + 21, then 31 + 32, and the fourth no longer fits
        df = spark.createDataFrame([("\n".join(["abcdefghij"] * 6),)], "t string")
        assert [len(c) for c in df.select(P.chunks(F.col("t"), limit=70, least=1, packing=packing)).first()[0]][0] <= 43


def test_running_totals_and_ranks(spark):
    rows = [(k, (k * 37) % 11) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {r.k: r.total for r in O.running(df, ["k"], {"total": F.col("v")}).collect()}
    total = 0
    for k, v in rows:
        total += v
        assert got[k] == total
    assert [r.ordinal for r in O.numbered(df, ["k"]).orderBy("k").collect()] == list(range(1, 201))
    assert O.running(df.where("false"), ["k"], {"total": F.col("v")}).count() == 0


def test_heads_tails_and_shards(spark):
    df = spark.createDataFrame([(k, "x" * (k % 5)) for k in range(40)], "k long, line string")
    sizes = [k % 5 + 1 for k in range(40)]
    head = [r.k for r in P.head_by_bytes(df, 30, ["k"]).orderBy("k").collect()]
    assert head == [k for k in range(40) if sum(sizes[: k + 1]) <= 30]
    start = sum(sizes) - 20
    tail = [r.k for r in P.tail_by_bytes(df, 20, 4, ["k"]).orderBy("k").collect()]
    assert tail == [k for k in range(40) if sum(sizes[:k]) > start and k % 5][:4]
    assert [r.shard for r in P.in_shards(df, 15, ["k"]).orderBy("k").collect()] == [k // 15 for k in range(40)]
    assert {r.split: r["count"] for r in P.split_in_order(df, 0.95, ["k"]).groupBy("split").count().collect()} == {"train": 38, "validation": 2}


def test_windows(spark):
    stream = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("token_id"))
    rows = P.windows(stream, 8, 50).collect()
    assert len(rows) == 50
    assert all(len(r.x) == 8 and r.x[1:] == r.y[:-1] and r.x[0] <= 3 * 91 for r in rows)
    assert P.windows(stream.limit(5), 8, 50).count() == 0


def test_verdict_order(spark):
    rows = [(0, 0, "short"), (1, 0, "this line is long enough to pass the rule"), (1, 1, "this line is long enough to pass the rule"), (2, 0, "blocked line that is long enough to pass too"), (3, 0, "blocked line that is long enough to pass too"), (4, 0, "one more good line that is long enough here")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, line string").withColumn("raw", F.col("line"))
    blocked = C.digests(df.where("doc_id = 2"))
    j = C.verdicts(df, blocked, C.LATIN_LINES, order=["doc_id", "pos"])
    assert [r.verdict for r in j.orderBy("doc_id", "pos").collect()] == ["quality", "accepted", "duplicate", "eval", "eval", "accepted"]
    assert C.until(j, 1, order=["doc_id", "pos"]).count() == 2
    assert C.until(j, 1, order=["doc_id", "pos"], document="doc_id").count() == 3
    assert C.until(j, 99, order=["doc_id", "pos"]).count() == 6


def test_profile(spark):
    df = spark.createDataFrame([("x" * 50,), ("y" * 200,), ("z" * 100,)], "t string")
    r = R.text_profile(df, "t", []).first()
    assert (r.min_len, r.p50_len, r.p90_len, r.max_len, r.duplicate_lines) == (50, 100, 200, 200, 0)
    two = R.text_profile(spark.createDataFrame([("same",), ("same",)], "t string"), "t", []).first()
    assert (two.duplicate_lines, two.duplicate_rate) == (1, 0.5)
    (none,) = R.text_profile(df.where("false"), "t", []).collect()
    assert none.lines == 0 and none.chars is None and none.duplicate_rate is None
    assert R.text_profile(df.where("false").withColumn("g", F.lit(1)), "t", ["g"]).count() == 0
    spaced = spark.createDataFrame([("a  b",), ("a b",), ("  ",)], "t string")
    assert [R.text_profile(spaced, "t", [], normalize=n).first().duplicate_lines for n in (False, True)] == [0, 1]


def test_balance_and_contamination(spark):
    df = spark.createDataFrame([("ar", 30), ("arz", 10)], "lang string, bytes long")
    r = R.ratio_of(df, "lang", "ar", "arz").first()
    assert (r.ar_share, r.arz_share, r.ratio) == (0.75, 0.25, 3.0)
    assert R.ratio_of(df.where("false"), "lang", "ar", "arz").first().ratio == 0.0
    m = spark.createDataFrame([({"train_overlap": 37, "eval_overlap": 0}, 400_000)], "stats map<string,long>, train_hashes_checked long")
    assert R.contamination(m).first().contamination_count == 37


def test_parameters(spark):
    df = spark.createDataFrame([(2, 1, 1, 2, 3, 5, 7, True, True)], "hidden long, heads long, kv_heads long, head_dim long, inner long, vocab long, layers long, qk_norm boolean, tied boolean")
    r = parameters(df).first()
    assert r.total == 7 * (2 * 4 + 2 * 4 + 3 * 6 + 4 + 4) + 10 + 2


GOOD = {"source_id": "s", "language": "ar", "role": "web", "license": "MIT", "provenance": "dump", "status": "approved"}


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({}, None),
        ({"language": ""}, "missing required field 'language'"),
        ({"status": "maybe"}, "invalid status 'maybe'"),
        ({"license": "CC-BY-SA-4.0"}, "approved with conditional license 'CC-BY-SA-4.0'"),
        ({"license": "CC_BY_NC"}, "forbidden license 'CC_BY_NC' must not be approved"),
        ({"license": "Mine"}, "approved with unapproved license 'Mine'"),
        ({"provenance": " unverified "}, "approved with unverified provenance 'unverified'"),
        ({"license": " MIT "}, None),
    ],
)
def test_registry_rules(spark, change, said):
    row = GOOD | change
    df = spark.createDataFrame([(*(row[k] for k in G.REQUIRED), 1)], ", ".join(f"{k} string" for k in G.REQUIRED) + ", line_no long")
    found = [r.problem for r in G.registry_gate(df).collect()]
    assert said in found if said else not found


def test_clean_taxonomy_and_its_weights(spark):
    make = lambda w: spark.createDataFrame([({"en": "en"}, [("a", w, [("x", ["en"])]), ("b", 0.5, [("y", ["en"])])])], "languages map<string,string>, domains array<struct<id: string, weight: double, subdomains: array<struct<id: string, languages: array<string>>>>>")
    assert G.taxonomy_gate(make(0.5)).count() == 0
    assert [r.problem for r in G.taxonomy_gate(make(0.7)).collect()] == ["domain weights sum to 1.2000, expected ~1.0"]
    assert tuple(G.taxonomy_size(make(0.5)).first()) == (2, 2)


def test_clean_record(spark):
    rec = Q.records(spark).where("line_no = 1")
    assert G.record_gate(rec, Q.taxonomy(spark), Q.registry(spark)).count() == 0
    assert G.status(G.record_gate(rec, Q.taxonomy(spark), Q.registry(spark))).first().status == "PASS"


def test_first_of_a_common_key(spark):
    rows = [(k, 0 if k % 3 else k % 7, k % 5) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, key int, o int")
    got = {r.k for r in O.mark_first(df, ["key"], ["o", "k"], "new").where("new").collect()}
    expected = {}
    for k, key, o in rows:
        expected[key] = min(expected.get(key, (o, k)), (o, k))
    assert got == {k for _, k in expected.values()}
    assert O.mark_first(df.where("false"), ["key"], ["o"], "new").count() == 0


def test_stops_without_running_totals(spark, monkeypatch):
    """Small targets take the first accepted rows; large ones take running totals of these alone. Both stop at the same row."""
    rows = [(d, p, "accepted" if (d * 7 + p) % 3 else "quality") for d in range(40) for p in range(5)]
    j = spark.createDataFrame(rows, "doc_id long, pos int, verdict string").repartition(5)
    kept = lambda *a, **b: sorted(map(tuple, C.until(j, *a, order=["doc_id", "pos"], **b).collect()))
    order = [r for r in rows if r[2] == "accepted"]
    seen = []
    with monkeypatch.context() as m:
        m.setattr(C, "running", lambda *a: pytest.fail("small target"))
        for n in (1, 50, len(order)):
            assert kept(n) == [r for r in rows if r <= order[n - 1]]
            assert kept(n, document="doc_id") == [r for r in rows if r[0] <= order[n - 1][0]]
            seen.append(kept(n))
        assert kept(len(order) + 1) == rows
    monkeypatch.setattr(C, "FIRST_ROWS", 0)
    assert [kept(n) for n in (1, 50, len(order))] == seen and kept(len(order) + 1) == rows


def test_sentences_are_dealt_by_length(spark):
    """Against the definition, chunk by chunk, on texts of many sentences, with all sizes around the limits."""

    def plain(text, limit, least, packing):
        parts = []
        for line in re.split("\r\n|\r|\n", text):
            found = line.strip().split(". ")
            parts += [p.strip() + "." * (k < len(found) - 1) for k, p in enumerate(found) if p.strip()]
        done, held, size = [], "", 0
        for p in parts:
            if held and size + len(p) + 1 > limit:
                done, held, size = [*done, held], p, len(p)
            else:
                held = f"{held} {p}" if held else p
                size = len(held) + (size if packing == "cumulative" else 0)
        return [c for c in [*done, held] if c and least <= len(c) <= limit]

    texts = ["", "a. b", " . \n. ", "x" * 90, "\r\n".join(f"{'ab ' * (k % 9)}é{k}. {'c' * (k % 23)}. " for k in range(900)), "one. two\n\n three . four"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    for limit, least, packing in ((40, 5, "greedy"), (41, 1, "greedy"), (60, 3, "cumulative"), (8000, 40, "greedy")):
        got = {r.k: r.c for r in df.select("k", P.chunks(F.col("t"), limit=limit, least=least, packing=packing).alias("c")).collect()}
        assert [got[k] for k in range(len(texts))] == [plain(t, limit, least, packing) for t in texts]
    plan = df.select(P.chunks(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # sentences are found once, and stripped once: three times each before
