"""Queries over whole texts against brute force, on small fixtures whose texts are longer than any cut."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.plans import queries as Q


def documents(spark, folder, texts, ids=None):
    rows = [(ids[k] if ids else k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plain_tidy(t):
    for pattern, to in ((r"\r\n?", "\n"), (r"[ \t\f\x0b]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        t = re.sub(pattern, to, t)
    return t.strip()


def test_whitespace_of_whole_texts(spark, tmp_path):
    texts = ["word " * 200 + " \t x\r\n\r\n\r\n\r\ny \n z\f\x0b" + "tail  " * 300 + "　", "short", "", "a" * 401 + "\r\n", None]
    got = {r.doc_id: r for r in Q.whitespace_functions(spark, documents(spark, tmp_path, texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts[:-1]):
        t = " \t" + text + "\r\n\n\n x \x0b y \xa0"
        assert (got[k].tidy, got[k].stripped, got[k].flat) == (plain_tidy(t), t.strip(), text.replace("\n", " "))
        assert got[k].odd == ("  " in text or "\t" in text or text.strip() != text)
    assert got[4].tidy is None


def test_marks_of_whole_texts(spark, tmp_path):
    texts = ["1234567890 " * 3 + "latin", "x" * 30 + " مُحــمَّد " + "y" * 500 + "ـًٰ", "١٢٣ ! " * 20, "", None]
    got = {r.doc_id: r for r in Q.arabic_marks(spark, documents(spark, tmp_path, texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts[:-1]):
        t = "مُحــمَّد " + text
        arabic, letters = sum("\u0600" <= c <= "\u06ff" for c in t), sum(unicodedata.category(c)[0] == "L" or unicodedata.category(c) in ("Nl", "No") for c in t)
        assert (got[k].no_tatweel, got[k].no_diacritics) == (t.replace("\u0640", ""), re.sub("[\u064b-\u0655\u0670]", "", t))
        assert got[k].ratio == arabic / letters
        assert got[k].lang_id == ("mixed" if re.search("[A-Za-z]", t) else "ar")
    assert [got[k].lang_id for k in range(4)] == ["mixed", "mixed", "ar", "ar"] and got[4].no_tatweel is None


def test_all_pieces_are_counted(spark, tmp_path):
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{k}" for k in range(700)), "it's  we'll\n\n x!? 12", "", None]
    pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
    got = {r.piece: r.n for r in Q.pretoken_counts(spark, documents(spark, tmp_path, texts)).collect()}
    assert got == Counter(x for t in texts if t for x in pieces.findall(t)) and len(got) > 700


def test_windows_of_the_token_stream(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    texts = ["second text, a bit longer than the first one " * 9, "first text", "", None, "last of all: 12345 " * 5]
    ids = [70, 9, 80, 81, 1000]
    stream = [x for _, text in sorted(zip(ids, texts)) if text for x in t.encode(text, add_special_tokens=False).ids]
    got = {r.window: r for r in Q.token_stream_windows(spark, documents(spark, tmp_path, texts, ids)).collect()}
    assert sorted(got) == list(range(64))
    for w, r in got.items():
        start = (w * 2_654_435_761 + 12_345) % (len(stream) - 16)
        assert [int(x) for x in r.x.split(",")] == stream[start : start + 16]
        assert [int(x) for x in r.y.split(",")] == stream[start + 1 : start + 17]


def test_tokenizer_metrics_like_the_library(spark, sf):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text", X.normalized(F.col("text")).alias("t")).orderBy("doc_id").collect()
    want = {}
    for r in texts:
        if r.t:
            n = want.setdefault(r.lang, [0, 0, 0, 0])
            for k, x in enumerate((1, len(r.t.split()), len(r.t), len(library.encode(r.t, add_special_tokens=False).ids))):
                n[k] += x
    got = Q.tokenizer_metrics(spark, sf).collect()
    assert {r.lang: [r.samples, r.words, r.chars, r.tokens] for r in got} == want
    assert all(r.tokens_per_word == pytest.approx(r.tokens / r.words) and r.roundtrip_failed == 0 and r.unk_rate == 0 for r in got)


def test_tables_of_the_token_stream_have_a_row_for_each_text(spark, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    from corpusmill.operators import ordering, tokens

    sizes, stash = [], tokens.stash

    def counted(df, label, *a):
        out = stash(df, label, *a)
        sizes.append((label, out.count(), "ids" in out.columns))
        return out

    monkeypatch.setattr(tokens, "stash", counted)
    monkeypatch.setattr(ordering, "stash", counted)
    texts = ["some words of a text " * 40, "more of it, " * 30, None, "", "ﬁ ① “odd” text " * 20]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    stream = tokens.token_stream(df, "t", tokenizers.path("byte_bpe_50k.json"), ["k"])
    assert stream.count() > 500 and max(n for _, n, _ in sizes) == 3
    assert {label for label, _, ids in sizes if ids} == {"ids", "stream"}  # keys and sizes alone are put in order
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    assert [r.token_id for r in stream.orderBy("pos").collect()] == [x for t in texts if t for x in library.encode(t, add_special_tokens=False).ids]


def test_metrics_take_no_ids_out_of_python(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from corpusmill.operators import tokens

    path = tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("en", "some words <|endoftext|> é́ "), ("en", None), ("fr", ""), ("de", "a" * 70_000 + " 1 b")], "g string, t string")
    m = tokens.measured(df, "t", path, ["g"], unknown=0)
    assert "array<int>" not in m._jdf.queryExecution().analyzed().treeString() and "ids" not in m._jdf.queryExecution().analyzed().toString()
    for t, e, f in df.select("t", tokens.encoded(path, F.col("t")), tokens.token_figures(path, F.col("t"), 0)).collect():
        assert (e is None) == (f is None) == (t is None)
        assert t is None or (f.n, f.u, f.same) == (len(e.ids), e.ids.count(0), e.same)


def test_stream_of_as_many_files_as_partitions(spark, tmp_path, monkeypatch):
    """The files of the stream grow in number; two batches take them all, and their state is kept out of the heap."""
    import os

    from corpusmill import tables

    made, fresh = {}, tables.fresh_path
    monkeypatch.setattr(tables, "fresh_path", lambda spark, label: made.setdefault(label, fresh(spark, label)))
    folder = documents(spark, tmp_path, [f"this is line number {k // 2} of a text, long enough and of different words" for k in range(200)])
    monkeypatch.setattr(Q, "docs", lambda spark, sf: tables.table(spark, sf, "documents").repartition(12))
    (got,) = Q.incremental_dedup(spark, folder).collect()
    assert got.n == 100
    local = lambda label: made[label].removeprefix("file:")
    files = [f for f in os.listdir(local("stream-in")) if f.endswith(".parquet")]
    assert len(files) >= 10 and len([f for f in os.listdir(local("stream-checkpoint") + "/commits") if f.isdigit()]) == 2
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
