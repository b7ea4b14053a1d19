"""Measuring a tokenizer on texts, and the stream of its ids. Encoding runs in Arrow batches; the tokenizer's file is read once by each worker."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import forget, settle, sized, stash
from .ordering import running

#: How byte-level tokenizers cut a text before merging, as a Java regular expression.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters encoded at once, about.
SLICE_CHARS = 1 << 18


@lru_cache(maxsize=4)
def _load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(path: str, texts: list[str]) -> list[list[int]]:
    """The ids of each text: from its ranks if that gives the same, in spliced chunks if it is long."""
    try:
        from ..llm.encoders import encode_many
        from ..llm.token_counts import CHUNK, chunked_ids

        usual = iter(encode_many(path, [x for x in texts if len(x) <= CHUNK]))
        return [next(usual) if len(x) <= CHUNK else chunked_ids(_load(path), x) for x in texts]
    except ImportError:  # the rest of the package does without tiktoken
        return [e.ids for e in _load(path).encode_batch_fast(texts, add_special_tokens=False)]


def _over_texts(path: str, text: Column, kind: str, arrow: pa.DataType, row: Callable) -> Column:
    """row(tokenizer, text, ids) of each text that isn't null. Batches are bounded by bytes, and of their texts few are held at once: encodings take many times their bytes."""
    settle(SparkSession.active())

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        t, out, part, held = _load(path), [], [], 0

        def encode(given: list) -> pa.Array:
            ids = iter(_ids(path, [x for x in given if x is not None]))
            return pa.array([None if x is None else row(t, x, next(ids)) for x in given], arrow)

        for x in texts:
            part.append(x.as_py())
            held += len(part[-1] or "")
            if held > SLICE_CHARS:
                out.append(encode(part))
                part, held = [], 0
        made = pa.concat_arrays([*out, encode(part)])
        del out, part
        pa.default_memory_pool().release_unused()  # workers outlive their batches
        return made

    return run(text)


def encoded(path: str, text: Column) -> Column:
    """struct(ids, same): a text's ids, and whether decoding them gives the text again. A null text gives null."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("same", pa.bool_())])
    return _over_texts(path, text, "struct<ids: array<int>, same: boolean>", kind, lambda t, x, ids: {"ids": ids, "same": t.decode(ids, skip_special_tokens=False) == x})


def token_ids(path: str, text: Column) -> Column:
    """A text's ids alone."""
    return _over_texts(path, text, "array<int>", pa.list_(pa.int32()), lambda t, x, ids: ids)


def token_figures(path: str, text: Column, unknown: int | None = None) -> Column:
    """struct(n, u, same) of encoded(): how many ids, how many of them unknown, and whether they give the text again. Ids stay in the worker."""
    kind = pa.struct([("n", pa.int64()), ("u", pa.int64()), ("same", pa.bool_())])
    return _over_texts(path, text, "struct<n: bigint, u: bigint, same: boolean>", kind, lambda t, x, ids: {"n": len(ids), "u": 0 if unknown is None else ids.count(unknown), "same": t.decode(ids, skip_special_tokens=False) == x})


def measured(texts: DataFrame, text: str, path: str, by: list[str], unknown: int | None = None) -> DataFrame:
    """For each group of texts (normalized first; empty ones left out): samples, words, characters, tokens, their ratios, unknown rate, round trips passed and failed."""
    src = texts.select(*by, X.normalized(F.col(text)).alias("t")).where("t <> ''").withColumn("e", token_figures(path, F.col("t"), unknown))
    rows = src.select(*by, F.size(X.words(F.col("t"))).cast("long").alias("w"), F.char_length("t").cast("long").alias("c"), F.col("e.n").alias("n"), F.col("e.u").alias("u"), F.col("e.same").alias("same"))
    out = rows.groupBy(*by).agg(F.count("*").alias("samples"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.sum("n").alias("tokens"), F.sum("u").alias("unknown"), F.count_if("same").alias("roundtrip_passed"), F.count_if(~F.col("same")).alias("roundtrip_failed"))
    ratio = lambda a, b: X.safe_divide(F.col(a), F.col(b))
    return out.select(*by, "samples", "words", "chars", "tokens", ratio("tokens", "words").alias("tokens_per_word"), ratio("chars", "tokens").alias("chars_per_token"), ratio("tokens", "chars").alias("tokens_per_char"), ratio("unknown", "tokens").alias("unk_rate"), "roundtrip_passed", "roundtrip_failed")


def token_stream(lines: DataFrame, text: str, path: str, order: list[str]) -> DataFrame:
    """All ids of the non-empty lines in order: pos (from 0, gapless) and token_id.

    Ids are written as one array for each line, and only lines' keys and sizes are put in order; the stream is taken apart where it is read, so no table has a row for each token.
    """
    ids = lines.where(F.col(text) != "").select(*order, token_ids(path, F.col(text)).alias("ids"))
    held = stash(ids.withColumn("__row", F.monotonically_increasing_id()).withColumn("__n", F.size("ids").cast("long")), "ids")
    ends = stash(running(held.select("__row", "__n", *order), order, {"__end": F.col("__n")}).select("__row", (F.col("__end") - F.col("__n")).alias("begin")), "begins")
    placed = stash(held.select("__row", "ids").join(sized(ends), "__row").select("begin", "ids"), "stream")
    forget(held, ends)
    return placed.select("begin", F.posexplode("ids").alias("at", "token_id")).select((F.col("begin") + F.col("at")).alias("pos"), F.col("token_id").cast("long").alias("token_id"))


def pretoken_counts(texts: DataFrame, text: str) -> DataFrame:
    """How often each piece that merging starts from occurs; sums are partial before the exchange."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PRETOKEN), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def artifact(spark, path: str) -> DataFrame:
    """One row of what a tokenizer's file holds: model type, entries, merges, added tokens, special tokens."""
    doc = spark.read.text(path, wholetext=True).select("value")
    get = lambda p: F.get_json_object("value", p)
    vocab = F.json_object_keys(get("$.model.vocab"))
    added = F.from_json(get("$.added_tokens"), "array<struct<id: int, content: string, special: boolean>>")
    return doc.select(get("$.model.type").alias("model"), F.size(vocab).cast("long").alias("entries"), F.json_array_length(get("$.model.merges")).cast("long").alias("merges"), F.size(added).cast("long").alias("added"), F.size(F.filter(added, lambda t: t["special"])).cast("long").alias("special"))
