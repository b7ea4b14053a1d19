"""What the operators of this subpackage share: maps over texts in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import forget, fresh_path, settle, spread, stash
from ..tables import table as read_table

__all__ = ["SLICE_BYTES", "TEXT", "explode_texts", "forget", "fresh_path", "map_texts", "raw", "settle", "slices", "stash", "table"]
TEXT = "__text"
#: Texts are handled in slices of at most so many bytes (one longer text is a slice of its own) and rows, whatever the session's batches hold.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1_024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and where each text begins (one more entry than texts). Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows whose texts have at most so many bytes together; a longer text is alone."""
    _, at = raw(texts)
    begin = 0
    while begin < len(texts):
        end = min(begin + SLICE_ROWS, max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1))
        yield begin, end
        begin = end


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list]], most: int = SLICE_BYTES) -> DataFrame:
    """Adds columns made from whole texts, without a shuffle.

    keep: columns of df to carry along; one whose name is among fields is replaced. make() is called once in each task and returns a
    function from an Arrow array of texts (nulls as in df) to one array or list for each field.
    """
    settle(df.sparkSession)
    names = {f.name for f in fields}
    keep = [c for c in dict.fromkeys(keep) if c not in names]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(TEXT))
    schema = T.StructType([src.schema[c] for c in keep] + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    kinds = [out.field(f.name).type for f in fields]

    def run(batches):
        fn = make()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for begin, end in slices(texts, most):
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(fn(texts.slice(begin, end - begin)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(begin, end - begin) for i in range(len(keep))), *made], names=[*keep, *(f.name for f in fields)])
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return src.mapInArrow(run, schema)


def explode_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], tuple]], most: int = SLICE_BYTES) -> DataFrame:
    """As map_texts, for any number of rows from a text: the function returns the index of the text of each row, then the columns."""
    settle(df.sparkSession)
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(TEXT))
    schema = T.StructType([src.schema[c] for c in keep] + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    kinds = [out.field(f.name).type for f in fields]

    def run(batches):
        fn = make()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for begin, end in slices(texts, most):
                rows, *cols = fn(texts.slice(begin, end - begin))
                rows = pa.array(rows, pa.int64())
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(begin, end - begin).take(rows) for i in range(len(keep))), *made], names=[*keep, *(f.name for f in fields)])
        pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, schema)
