import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as X


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(inputs)], "k long, t string")
    return [tuple(r[1:]) for r in df.select("k", *[c.alias(f"c{i}") for i, c in enumerate(columns)]).orderBy("k").collect()]


CASES = [
    ("①", "1"),
    ("①②③", "123"),
    ("ﬀ", "ff"),
    ("مـحـمـد", "محمد"),
    ("مُحَمَّد", "محمد"),
    ("أ إ آ ؤ ئ ء ة ى", "أ إ آ ؤ ئ ء ة ى"),
    ("a    b\tc", "a b c"),
    ("a\n\n\nb", "a\n\nb"),
    ("a \r\n b\rc", "a\nb\nc"),
    ("   ", ""),
    ("　x\xa0", "x"),
    (None, None),
    ("", ""),
]


def test_normalized(spark):
    assert [r[0] for r in values(spark, [a for a, _ in CASES], X.normalized(F.col("t")))] == [b for _, b in CASES]


def test_diacritics_can_stay(spark):
    word = unicodedata.normalize("NFKC", "مُحَمَّد")
    assert values(spark, [word], X.normalized(F.col("t"), diacritics=True)) == [(word,)]


def test_changes(spark):
    got = [r[0] for r in values(spark, ["ـa", "ًa", "a   b", "ﬀ", "plain"], X.changes(F.col("t")))]
    assert got[0] == ["tatweel"] and got[1] == ["diacritics"] and got[2] == ["whitespace"] and "nfkc" in got[3] and got[4] == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x85  \xa0　ـًﬀé"), max_size=40), min_size=1, max_size=30))
def test_like_python(spark, inputs):
    t = F.col("t")
    for given_, (lines, words, stripped, compat) in zip(inputs, values(spark, inputs, X.lines(t), X.words(t), X.strip(t), X.nfkc(t)), strict=True):
        assert [x for x in lines if x] == [x for x in given_.splitlines() if x]
        assert words == given_.split()
        assert stripped == given_.strip()
        assert compat == unicodedata.normalize("NFKC", given_)


def test_scripts_and_ratios(spark):
    t = F.col("t")
    got = values(spark, ["مح abc", "abc", "مح٤", "123 !", ""], X.language(t), X.script_ratio(t, "arabic"), X.unique_ratio(X.words(t)))
    assert [g[0] for g in got] == ["mixed", "en", "ar", "other", "other"]
    assert [g[1] for g in got] == [pytest.approx(2 / 5), 0.0, 1.5, 0.0, 0.0]
    assert got[4][2] == 0.0


def test_digests_and_fallbacks(spark):
    t = F.col("t")
    got = values(spark, ["", "a" * 64, "A" * 64, None, "a" * 64 + "\n"], X.fingerprint(t), X.is_hex_digest(t), X.first_filled(t, F.lit("else")))
    assert got[0][0] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert [g[1] for g in got] == [False, True, False, False, False]
    assert got[0][2] == "else" and got[3][2] == "else"


def test_simple_characters(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    plain = [c for c, (ok,) in zip(chars, values(spark, chars, X.simple(F.col("t"))), strict=True) if ok]
    assert set("\n azAZéÿŐſ’€0~".replace("ſ", "")) <= set(plain) and not set("\t\r\xa0ª²×÷ĳŉſǆɐ…‑ـ") & set(plain)
    latin = re.compile(r"[A-Za-zÀ-ɏ]")
    for c in plain:
        assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
        assert not c.isspace() or c in " \n"
        assert (unicodedata.category(c)[0] == "L" or unicodedata.category(c) in ("Nl", "No")) == (latin.fullmatch(c) is not None)


def test_simple_texts_like_others(spark):
    """An odd character in a piece of its own takes texts by the other path; what the paths give is the same."""
    texts = ["", "one", " a b ", "Ein Maß. Noch  eins’ \n x\n\n\n\ny", "a\nb – c 12 €", "\n", "été  ", "\n\n", "no. . end. "]
    t = F.col("t")
    one = values(spark, texts, X.tidy_whitespace(t), X.words(t), X.lines(t), X.counted(t, X.LETTER), X.counted(t, X.SCRIPTS["latin"]), X.counted(t, X.SCRIPTS["arabic"]))
    odd = F.concat(F.lit("x\n漢\n"), t)
    other = values(spark, texts, X.words(odd), X.lines(odd), X.counted(odd, X.LETTER), X.counted(odd, X.SCRIPTS["latin"]), X.counted(odd, X.SCRIPTS["arabic"]))
    for text, (tidy, words, lines, *counts), (words_2, lines_2, *counts_2) in zip(texts, one, other, strict=True):
        assert tidy == re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(" +", " ", text))).strip()
        assert (["x", "漢", *words], ["x", "漢", *lines]) == (words_2, lines_2)
        assert [a + b for a, b in zip(counts, (2, 1, 0), strict=True)] == counts_2


def test_python_sees_odd_texts_in_small_batches(spark, monkeypatch):
    """Simple texts never go to Python, and no batch holds more than a few MB, whatever the session allows."""
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    monkeypatch.setattr(X, "compatible", lambda texts: pa.array([None if t is None else f"{len(texts)} {texts.nbytes}" for t in texts.to_pylist()], pa.string()))
    rows = spark.range(4000, numPartitions=1).select(F.when(F.col("id") < 2000, F.lit("simple text")).otherwise(F.repeat(F.lit("Ⅷ odd "), 2000)).alias("t"))
    got = rows.select("t", X.nfkc(F.col("t")).alias("n")).collect()
    assert all(r.n == r.t for r in got if r.t == "simple text")
    sizes = [tuple(map(int, r.n.split())) for r in got if r.t != "simple text"]
    assert len(sizes) == 2000 and max(n for n, _ in sizes) <= 1024 and max(b for _, b in sizes) < 10 << 20


def test_each_scan_is_written_once(spark):
    """Conditions used to work out words three times and letters twice for each line."""
    from corpusmill.operators.corpus import LATIN_LINES, passes

    plan = spark.createDataFrame([("a",)], "t string").select(passes(LATIN_LINES, F.col("t")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(X.NOT[X.LETTER]) == 1 and plan.count("array_distinct") == 1 and plan.count("split(") == 2
