"""Token counts, packing, decontamination, quality: against brute force, on odd inputs."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate as D
from corpusmill.llm import encoders as E
from corpusmill.llm import packing as P
from corpusmill.llm import quality as Q
from corpusmill.llm.queries import byte_bpe
from corpusmill.llm.token_counts import chunked_ids, count_tokens
from corpusmill.llm.words import doc_of, shingles, token_hashes, word_hashes

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "one two three", None, None, 13), (3, "one two three", None, None, 13), (None, "no id here", "en", "s", 10), (5, "word " * 40_000, "en", "s", 1), (6, "!!! ... \n\n", "en", "s", 1), (7, "x" * 30_000, "en", "s", 1)]
STRINGS = ["a", "b", " ", "  ", "\n", "'s", "'", ".", "1", "23", "é", "<|endoftext|>", "世", "\x85", "　", "ⅷ", "\t", "Ab", "_", "\xa0"]


@pytest.fixture(scope="module")
def tokenizer():
    return E.load(byte_bpe())


def strings(seed, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(STRINGS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_fast_ids_are_the_librarys(tokenizer):
    texts = strings(1, 2000, 60)
    assert E.encode_many(byte_bpe(), texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("chunk", "overlap"), [(20, 3), (50, 7), (400, 64)])
def test_spliced_ids_are_the_whole_texts(tokenizer, chunk, overlap):
    for t in [*strings(2, 300, 300), "x" * 3000, " " * 3000, "ab " * 1000, "12ab" * 700, "\n" * 500, "世" * 900]:
        assert chunked_ids(tokenizer, t, chunk, overlap) == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" * 1_000_000, " " * 1_000_000, "世" * 1_000_000, "x" * 200_000 + " a " + " " * 200_000 + "b1" * 1000 + "世" * 200_000])
def test_long_texts_without_boundaries(tokenizer, text):
    begin = time.time()
    got = chunked_ids(tokenizer, text)
    assert time.time() - begin < 8
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_counts_on_odd_inputs(spark, tokenizer):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("n_tokens", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(df, byte_bpe(), keep=["doc_id", "n_tokens"], chunk=10_000).collect()))
    assert got == sorted((d or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ODD)
    assert count_tokens(df.where("false"), byte_bpe()).count() == 0


def check_packed(rows, docs, tokenizer, size):
    by_seq = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    for d, t in docs.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == size for r in mine[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    return len(by_seq)


def test_packing(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = P.pack(docs, byte_bpe(), keep=["doc_id"], size=256).collect()
    total = sum(r.length for r in rows)
    assert check_packed(rows, texts, tokenizer, 256) <= -(-total // 256) * 1.01 + 1


def test_packing_odd_inputs(spark, tokenizer):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("offset", F.lit(1)).withColumn("piece", F.lit("x"))
    rows = P.pack(df, byte_bpe(), keep=["doc_id", "offset", "piece"], size=512).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ODD)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert P.pack(df.where("false"), byte_bpe(), keep=["doc_id"]).count() == 0


def test_sequences(spark, tokenizer):
    df = spark.createDataFrame([(k, "w " * (k * 7 % 50)) for k in range(60)], "doc_id long, text string")
    packed = P.pack(df, byte_bpe(), keep=["doc_id"], size=64, with_ids=True)
    for r in P.assemble(packed).collect():
        assert len(r.ids) == r.length <= 64


def test_fullest_is_best():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        room = r.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = P.fullest(counts, room)
        assert all(m <= counts[n] for n, m in got.items())
        assert sum(n * m for n, m in got.items()) == max(s for s in sums if s <= room)


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def plain_matches(text, items, window):
    wins = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(len(w) - window + 1, min(1, len(w)))):
            wins[tuple(w[k : k + window])].add(i)
    w = plain_words(text)
    hit, found = [0] * len(w), set()
    for n in {len(k) for k in wins}:
        for k in range(len(w) - n + 1):
            if x := wins.get(tuple(w[k : k + n])):
                found |= x
                hit[k : k + n] = [1] * n
    return len(w), sum(hit), {str(i) for i in found if i is not None}


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 200])
def test_matches_like_brute_force(spark, block):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("ab cd Ef gh, ij-kl é 12".split()) for _ in range(n))
    items = [(k, say(r.randint(0, 14))) for k in range(12)] + [(3, say(6)), (None, "ab cd ab"), (99, None), (98, "")]
    docs = [(k, say(r.randint(0, 60))) for k in range(80)] + [(200, None), (201, ""), (202, "ab cd ab cd"), (202, "ab cd ab cd")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("matches", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 5):
        got = defaultdict(list)
        for row in D.summary(D.find_matches(df, bench, window=window, block_bytes=block)).collect():
            got[row.doc_id].append(row)
        for d, t in docs:
            for row in got[d]:
                assert (row.n_words, row.n_hit, set(row["items"])) == plain_matches(t, items, window)
        kept = D.decontaminate(df, bench, window=window, min_items=2, block_bytes=block)
        assert kept.columns == df.columns
        assert sorted(row.doc_id for row in kept.collect()) == sorted(d for d, t in docs if len(plain_matches(t, items, window)[2]) < 2)


def test_longest_match(spark):
    df = spark.createDataFrame([(1, "x y one two three four five six z")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "zero one two three four five six seven")], "item_id long, text string")
    r = D.summary(D.find_matches(df, bench, window=3)).first()
    assert (r.longest_match, r.longest_begin, r.longest_item) == (6, 2, "7")


@pytest.mark.parametrize("most", [1, 500, D.MOST_HITS])
def test_repeated_words_in_parts(most):
    texts = ["la " * 400, "x la la y", "", "la " * 9]
    n, found = D.matcher(D.Benchmark.of([1, 2], ["la " * 60, "la la y"], 8), 8, most)(pa.array(texts, pa.large_string()))
    for text, count, matches in zip(texts, n, found, strict=True):
        covered = {k for m in matches for k in range(m["begin"], m["end"])}
        assert (count, len(covered), {m["item"] for m in matches}) == plain_matches(text, [(1, "la " * 60), (2, "la la y")], 8)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find_matches(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.summary(D.find_matches(one, bench)).first().n_hit == 0


def test_words_and_shingles():
    texts = ["One two  THREE", "", "a", "é1-x", "one two three four five six", "three"]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, first = word_hashes(np.frombuffer(data, np.uint8), at)
    assert list(np.diff(first)) == [len(plain_words(t)) for t in texts]
    assert list(h[:3]) == list(h[first[4] : first[4] + 3]) and h[2] == h[first[5]]
    s, sf = shingles(h, first, 5)
    assert list(np.diff(sf)) == [1, 0, 1, 1, 2, 1] and len(set(s)) == len(s)
    t, tf = token_hashes(np.frombuffer(data, np.uint8), at)
    assert list(np.diff(tf)) == [3, 0, 1, 3, 6, 1] and list(doc_of(tf)[:4]) == [0, 0, 0, 2]


def test_quality_keeps_good_and_rejects_junk(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice("the cat sat on a mat and ran".split()) for _ in range(40))
    junk = lambda: " ".join(r.choice("### $$$ BUY!! NOW!! %%%".split()) for _ in range(40))
    rows = [(k, junk() if k % 4 == 0 else good()) for k in range(400)] + [(None, good()), (1000, None), (1001, ""), (1, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0, "x") for k in range(0, 400, 2)] + [(None, 1, 0, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = Q.resample(docs, labels, keep=["doc_id", "text", "kept"])
    assert got.columns == ["doc_id", "text", "log_weight", "gumbel_key", "kept"]
    rows = got.collect()
    assert len(rows) == 404
    assert all(x.kept == (x.doc_id is None or x.doc_id >= 1000 or x.doc_id % 4 != 0) for x in rows)
    assert Q.resample(docs.where("false"), labels).count() == 0
    assert Q.resample(docs, labels.where("false")).where("kept").count() == 404


def plain_grams(t):
    """Words, and runs of other printable characters, alone and in pairs, by the definition."""
    kind = lambda b: 1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2 if b > 32 and b != 127 else 0
    runs = []
    for k, g in itertools.groupby((t or "").encode(), kind):
        if k:
            runs.append(bytes(g))
    return runs, list(zip(runs, runs[1:]))


def test_weights_like_plain_counts(spark):
    r = random.Random(16)
    say = lambda words: " ".join(r.choice(words) for _ in range(r.randint(1, 25)))
    docs = [(k, say("the cat sat on a mat. Then, it: ran".split() if k % 3 else "BUY now!! $$$ cheap the".split())) for k in range(90)] + [(100, None), (101, "")]
    labels = [(k, int(k % 3 > 0), 0) for k in range(0, 90, 2)]
    got = {x.doc_id: x.log_weight for x in Q.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    fits = {x[0] for x in spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("quality = 1").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).select("doc_id").collect()}
    assert 5 < len(fits) < 25
    every, chosen = Counter(), Counter()
    for d, t in docs:
        grams = [x for part in plain_grams(t) for x in part]
        every.update(grams)
        chosen.update(grams if d in fits else [])
    share = sum(chosen.values()) / sum(every.values())
    for d, t in docs:
        want = sum(math.log((chosen[g] + Q.SMOOTHING) / (every[g] * share + Q.SMOOTHING)) for part in plain_grams(t) for g in part)
        assert got[d] == pytest.approx(want, abs=1e-6), (d, t)


def test_top_k_is_exact(spark):
    rows = [(k, "word " * (k % 7)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    got = Q.resample(docs, labels, k=37).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {r.doc_id for r in sorted(got, key=lambda r: -r.gumbel_key)[:37]}


def test_ratio_model():
    every, chosen = np.array([100.0, 50, 0, 10]), np.array([50.0, 0, 0, 5])
    got = Q.log_ratios(every, chosen)
    assert got[1] < 0 < got[0] and got[2] == 0
    assert Q.calibrated_cut([(1.0, True), (-1.0, False)]) == 0.0
    assert Q.calibrated_cut([(1.0, True)]) == float("-inf")
