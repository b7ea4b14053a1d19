"""Byte-level BPE ids as the tokenizers library gives them for a tokenizer file; files are never copied, only their paths travel.

Where the file has a sibling of ranks (same name, .tiktoken), texts of plain characters are encoded from these ranks, which give the same
ids four times as fast: the two libraries can differ only where their Unicode tables or their handling of special strings do, and
texts with such characters or strings always take the tokenizers library.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

#: Characters whose classes have been the same in every Unicode version that libraries use, without rare kinds of space.
_PLAIN = re.compile("[\\t\\n\\r -~\\xa1-\\xac\\xae-\\u024f\\u2010-\\u2027\\u2030-\\u205e]*")
#: Fixed value: how byte-level BPE vocabularies of this family cut a text before merging.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


def encode_many(path: str, texts: list[str]) -> list[list[int]]:
    """The ids of each text, without special tokens added; special strings inside a text become their ids, as by default."""
    fast = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(fast):
        return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]
    marks, encode = special_strings(path), _ranks(fast).encode_ordinary
    plain = [_PLAIN.fullmatch(t) is not None and not any(m in t for m in marks) for t in texts]
    rest = iter(load(path).encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False) if not all(plain) else ())
    return [encode(t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]
