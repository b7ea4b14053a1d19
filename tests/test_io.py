import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus as C
from corpusmill.operators import tokens as K
from corpusmill.operators import validation as V
from corpusmill.sources import readers as S
from corpusmill.sources import writers as W
from corpusmill.streaming.ingest import ingest


def test_parquet_texts(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "text string, x int").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("b",)], "text string").write.parquet(str(tmp_path / "two"))
    assert sorted(r.text for r in S.parquet_texts(spark, str(tmp_path)).collect()) == ["a", "b"]
    spark.createDataFrame([(5,)], "content int").write.parquet(str(tmp_path / "three"))
    assert S.parquet_texts(spark, str(tmp_path / "three")).first().text is None
    spark.createDataFrame([(5,)], "other int").write.parquet(str(tmp_path / "four"))
    with pytest.raises(ValueError, match="no text column"):
        S.parquet_texts(spark, str(tmp_path / "four"))


def test_text_and_json_lines(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("one\n\n two \r\nthree", encoding="utf-8")
    assert [r.value for r in S.text_lines(spark, str(f)).collect()] == ["one", " two ", "three"]
    assert S.text_lines(spark, str(tmp_path), recursive=True).count() == 3
    j = tmp_path / "r.jsonl"
    j.write_text('{"a": "x"}\n\n{broken\n{"a": "y", "b": 2}\n', encoding="utf-8")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    rows, problems = S.json_lines(spark, str(j), StructType([StructField("a", StringType()), StructField("b", LongType())]))
    assert [tuple(r) for r in rows.orderBy("line_no").collect()] == [(1, "x", None), (4, "y", 2)]
    assert [tuple(r) for r in problems.collect()] == [("line 3", "invalid JSON")]
    assert S.json_document(spark, str(tmp_path / "none.json"), "a string") is None


def test_binary_ids(spark, tmp_path):
    (tmp_path / "ids.bin").write_bytes(b"".join(n.to_bytes(4, "little") for n in (1, 70_000, 4_294_967_295)))
    assert [tuple(r) for r in S.binary_ids(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, 1), (1, 70_000), (2, 4_294_967_295)]


def test_line_digests(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "k long, value string")
    assert S.line_digests(df).count() == 3
    first = S.line_digests(df, limit=2, order=["k"])
    assert {bytes(r.digest).hex()[:4] for r in first.collect()} == {"ca97", "3e23"}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(k, k // 3, f"line {k}\nmore") for k in range(8)], "k long, shard long, line string")
    W.write_groups(rows, "line", "shard", str(tmp_path / "g"), ["k"])
    back = spark.read.text(str(tmp_path / "g"))
    assert back.count() == 8 and back.where("value = 'line 0 more' AND shard = 0").count() == 1
    W.write_shards(rows.withColumn("line", F.concat(F.lit("l"), "k")), "line", str(tmp_path / "s"), ["k"])
    (one,) = (tmp_path / "s" / "shard=1").glob("part-*")
    assert one.read_text() == "l3\nl4\nl5\n"
    W.write_in_order(rows.withColumn("line", F.col("k").cast("string")), "line", str(tmp_path / "o"), ["k"], 3)
    assert "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))).split() == [str(k) for k in range(8)]
    both = W.concatenated([("ar", rows.where("k < 2")), ("en", rows.where("k >= 2"))], "line", ["k"])
    assert [r.lang for r in both.orderBy("part", "k").collect()] == ["ar"] * 2 + ["en"] * 6
    W.write_json(spark, str(tmp_path / "m.json"), rows.agg(F.count("*").alias("n")))
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 8}
    W.replace_folder(spark, rows, str(tmp_path / "t"))
    W.write_json(spark, str(tmp_path / "m.json"), {"n": 9})
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 9} and not (tmp_path / "m.json.tmp").exists()
    # a run that stopped between its two moves left the old folder aside
    (tmp_path / "t").rename(tmp_path / "t.old")
    W.replace_folder(spark, rows.limit(2), str(tmp_path / "t"))
    assert not (tmp_path / "t.old").exists()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with W.single_writer(spark, str(tmp_path / "lock")), pytest.raises(FileExistsError), W.single_writer(spark, str(tmp_path / "lock")):
        pass
    assert not (tmp_path / "lock").exists()


def test_ingest_restarts(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    docs.where("doc_id % 2 = 0").coalesce(2).write.parquet(source)
    run = lambda: ingest(spark, source, docs.schema, out, check, C.LATIN_LINES, order=["doc_id", "pos"])
    run()
    docs.where("doc_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = spark.read.parquet(out)
    batch = C.verdicts(C.normalized_lines(docs, C.LATIN_LINES), None, C.LATIN_LINES, order=["doc_id", "pos"]).where("verdict = 'accepted'")
    assert got.count() == got.select("digest").distinct().count() == batch.count()
    assert got.select("line").exceptAll(batch.select("line")).count() == 0


def test_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    hard = ["\x00\x01 ​", "word " * 500, "ً" * 50, "\U0001f600" * 100, "é̂̃", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(hard)], "k long, t string").select("k", K.encoded(path, F.col("t")).alias("e"))
    rows = {r.k: r.e for r in df.collect()}
    assert rows[6] is None and all(r.same for k, r in rows.items() if k != 6)
    m = K.measured(spark.createDataFrame([("a", "one two"), ("a", "three"), ("b", " ")], "g string, t string"), "t", path, ["g"]).collect()
    assert [(r.g, r.samples, r.words, r.roundtrip_failed) for r in m] == [("a", 2, 3, 0)]
    stream = K.token_stream(spark.createDataFrame([(0, "a b"), (1, ""), (2, "c")], "k long, t string"), "t", path, ["k"]).orderBy("pos").collect()
    assert [r.pos for r in stream] == list(range(len(stream))) and len(stream) == 3
    a = K.artifact(spark, path).first()
    assert a.model == "BPE" and (a.entries, a.added) == (50_256, 1)


def test_upsert_keeps_other_lines(spark, tmp_path):
    path = str(tmp_path / "registry.jsonl")
    W.upsert_lines(spark, path, [{"source_id": "a", "n": 1}, {"source_id": "b", "n": 1}], "source_id")
    with open(path, "a") as f:
        f.write('{"source_id":"arz",   "odd": "é"}\nnot json\n')
    W.upsert_lines(spark, path, [{"source_id": "b", "n": 2}, {"source_id": "c", "n": 3}], "source_id")
    assert (tmp_path / "registry.jsonl").read_text().splitlines() == ['{"source_id": "a", "n": 1}', '{"source_id": "b", "n": 2}', '{"source_id":"arz",   "odd": "é"}', "not json", '{"source_id": "c", "n": 3}']


def corpus_files(tmp_path):
    texts = tmp_path / "texts"
    texts.mkdir()
    parts = {"ar": "سطر أول\nسطر\n".encode(), "arz": b"one\ntwo\nthree\n"}
    for name, data in parts.items():
        (texts / f"{name}.txt").write_bytes(data)
    whole = b"".join(parts.values())
    (tmp_path / "corpus.txt").write_bytes(whole)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    counts = {n: {"target": 5, "bytes": len(d), "accepted": d.count(b"\n"), "sha256": sha(d)} for n, d in parts.items()}
    return {"version": 1, "normalizer": "n", "counts": counts | {"en": {"target": 0, "sha256": None}}, "corpus": {"bytes": len(whole), "sha256": sha(whole)}}, str(tmp_path / "corpus.txt"), str(texts)


@pytest.mark.parametrize("cell", [V.CELL_BYTES, 3])
def test_file_facts(spark, tmp_path, cell):
    manifest, corpus, texts = corpus_files(tmp_path)
    (tmp_path / "open.txt").write_bytes(b"a\nb")
    (tmp_path / "none.txt").write_bytes(b"")
    paths = [corpus, f"{texts}/ar.txt", f"{texts}/en.txt", str(tmp_path / "open.txt"), str(tmp_path / "none.txt")]
    got = {r.path: (r.bytes, r.lines, r.sha256) for r in V.file_facts(spark, paths, cell).collect()}
    assert got[corpus] == (manifest["corpus"]["bytes"], 5, manifest["corpus"]["sha256"]) and got[paths[2]] == (None, None, None)
    assert got[paths[3]][:2] == (3, 1) and got[paths[4]] == (0, 0, hashlib.sha256(b"").hexdigest())


def test_manifest_problems(spark, tmp_path):
    manifest, corpus, texts = corpus_files(tmp_path)
    found = lambda m, left=(): sorted((r.label, r.problem) for r in V.manifest_problems(spark, m, corpus, texts, list(left)).collect())
    assert found(manifest) == []
    assert found({k: v for k, v in manifest.items() if k != "normalizer"}) == [("normalizer", "missing key")]
    changed = json.loads(json.dumps(manifest))
    changed["counts"]["ar"] |= {"accepted": 9, "sha256": "0"}
    changed["counts"]["en"]["target"] = 7
    changed["corpus"]["bytes"] = 1
    assert found(changed, [f"{texts}/ar.txt", f"{texts}/x.tmp"]) == sorted([("ar", "lines differ"), ("ar", "sha256 differ"), ("en", "missing file"), ("corpus", "bytes differ"), (f"{texts}/ar.txt", "leftover")])
    (tmp_path / "texts" / "en.txt").write_bytes(b"")
    assert ("en", "sha256 differ") in found(manifest)
    (tmp_path / "corpus.txt").unlink()
    assert ("corpus", "missing file") in found(manifest)


def test_training_problems(spark, tmp_path):
    corpus, made = tmp_path / "c.txt", tmp_path / "tokenizer.json"
    found = lambda **k: [r.problem.split(",")[0] for r in V.training_problems(spark, str(corpus), [str(made)], **k).collect()]
    assert found() == ["missing file"]
    corpus.write_text("fine line\n" * 10)
    assert found() == ["100 bytes"] and found(least_bytes=50) == []
    made.write_text("{}")
    assert found(least_bytes=50) == ["would be written over"] and found(least_bytes=50, force=True) == []
    assert found(least_bytes=50, force=True, protected=[str(made)]) == ["is protected"]
    corpus.write_text("fine line\ntwo  spaces\n" * 5)
    assert found(least_bytes=50, force=True) == ["5 of 10 lines aren't normal"]
