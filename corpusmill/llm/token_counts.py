"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where both encodings provably agree.

A place is a proven boundary if no piece that the tokenizer's pattern cuts can span it, whatever stands farther left or right: between a
character that is no space and a space, or between an ASCII letter and an ASCII digit. The text's ids are then those of the left part
followed by those of the right part. Two chunks are spliced at the last such place in their overlap at which both have a token boundary; if there is
none, the overlap is widened, and a stretch without any such place is one chunk.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts
from .encoders import encode_many, load

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
CHUNK, OVERLAP = 1 << 16, 256


def proven(text: str, p: int) -> bool:
    if not 0 < p < len(text):
        return False
    a, b = text[p - 1], text[p]
    if b in " \n\t\r":
        return "!" <= a <= "~" or a >= "\xa1" and a.isalpha()
    return a.isascii() and b.isascii() and (a.isalpha() and b.isdigit() or a.isdigit() and b.isalpha())


def splices(tokenizer) -> bool:
    """Whether added tokens leave proven boundaries alone: none takes in spaces beside it or has a space or a change to a digit inside."""
    return not any(t.lstrip or t.rstrip or t.single_word or any(proven(t.content, p) for p in range(1, len(t.content))) or t.content != t.content.strip() for t in tokenizer.get_added_tokens_decoder().values())


#: Where a proven place can be, for a regular expression; proven() has the last word.
_MAYBE = re.compile(r"[^\W_](?=[ \n\t\r])|[!-~](?=[ \n\t\r])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def first_proven(text: str, begin: int) -> int | None:
    """The first proven place at begin or after it."""
    return next((m.start() + 1 for m in _MAYBE.finditer(text, max(0, begin - 1)) if proven(text, m.start() + 1)), None)


def last_proven(text: str, begin: int, end: int, step: int = 1024) -> int | None:
    """The last proven place after begin and before end. Looks back piece by piece, so a place near the end is found at once."""
    while end > begin + 1:
        low = max(begin, end - step)
        found = [m.start() + 1 for m in _MAYBE.finditer(text, low, end) if m.start() + 1 < end and proven(text, m.start() + 1)]
        if found:
            return found[-1]
        end, step = low + 1, step * 2
    return None


class Encoded:
    """The ids of text[begin:end], and where in the text each begins and ends."""

    def __init__(self, tokenizer, text: str, begin: int, end: int):
        e = tokenizer.encode(text[begin:end], add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2) + begin  # the library makes the whole list at each access
        self.begin, self.end, self.ids, self.starts, self.ends = begin, end, e.ids, at[:, 0], at[:, 1]


def common_boundary(text: str, left: Encoded, from_token: int, right: Encoded) -> tuple[int, int] | None:
    """The tokens of left and right that begin at the last proven place where both have a token boundary."""
    k = np.arange(from_token + 1, len(left.starts))
    k = k[(left.starts[k] >= right.begin) & (left.ends[k - 1] == left.starts[k])]
    places, which, other = np.intersect1d(left.starts[k], right.starts, return_indices=True)
    for j in range(len(places) - 1, -1, -1):
        if proven(text, int(places[j])):
            return int(k[which[j]]), int(other[j])
    return None


def chunked_ids(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of text, encoded in chunks of about so many characters that overlap by about so many. An overlap without a proven place is widened back to
    the last one, and a chunk without any reaches on to the next one: work grows with the text, however it is made."""
    if len(text) <= chunk or not splices(tokenizer):
        return tokenizer.encode(text, add_special_tokens=False).ids
    ids: list[int] = []
    from_token, done, begin, end = 0, 0, 0, chunk  # the tokens before place done are in ids
    left = None
    while True:
        place = last_proven(text, done, end) if end < len(text) else None
        if place is None and end < len(text):
            place = first_proven(text, end)
            end, left = len(text) if place is None else min(len(text), place + overlap), None
        left = left or Encoded(tokenizer, text, begin, end)
        if end >= len(text):
            return ids + left.ids[from_token:]
        wide, cut, start = overlap, None, end
        while cut is None and start > begin:
            start = max(begin, min(end - wide, place - overlap))
            to = min(len(text), max(start + chunk, end + overlap))
            right = Encoded(tokenizer, text, start, to)
            cut, wide = common_boundary(text, left, from_token, right), wide * 2  # wider if the two didn't align
        if cut:
            ids += left.ids[from_token : cut[0]]
            begin, end, left, from_token, done = start, to, right, cut[1], int(right.starts[cut[1]])
        else:
            left, end = None, min(len(text), end + chunk)


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """keep (all columns but the text if not given), n_bytes (UTF-8) and n_tokens of each whole text. A null text is an empty one, with 0
    of both. Repeated rows stay. No shuffle; a task's memory is bounded by its longest text."""
    names = {f.name for f in FIELDS}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names and (keep is not None or c != text)]

    def make():
        t = load(tokenizer)

        def count(texts: pa.Array) -> list:
            texts = texts.fill_null("")
            chars, all_texts = pc.utf8_length(texts).to_pylist(), texts.to_pylist()
            usual = iter(encode_many(tokenizer, [x for x, n in zip(all_texts, chars, strict=True) if n <= chunk]))
            return [pc.binary_length(texts).cast(pa.int64()), [len(next(usual)) if n <= chunk else len(chunked_ids(t, x, chunk, overlap)) for x, n in zip(all_texts, chars, strict=True)]]

        return count

    return map_texts(docs, text, keep, FIELDS, make)
