"""Encoding with a public tokenizer (byte-level BPE, local rank file), and its inverse.

Long texts are cut first at safe boundaries: between a character that is not white
space and a space. No match of the pre-tokenizer's pattern runs over such a place, and
the look-ahead in it only looks at white space that follows, so the ids of the parts
together are the ids of the whole. Text without such places stays whole.

Defined results: a null or empty text gets an empty list; names of special tokens are
ordinary text; repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenizer's pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PART_CHARS = 20_000
_SAFE = re.compile(r"(?<=\S)(?= )")


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def encoding(path: str):
    """One encoder per Python worker."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def id_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks(path).items()}


def safe_parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``most`` characters that encode independently."""
    at = 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str | None, path: str, most: int = PART_CHARS) -> list[int]:
    if not text:
        return []
    enc = encoding(path)
    if len(text) <= most:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, most) for i in enc.encode_ordinary(part)]


def decode(ids, path: str) -> str:
    """The text of ``ids`` from their raw bytes."""
    table = id_bytes(path)
    return b"".join(table[int(i)] for i in ids).decode("utf-8", "replace")


def rank_path(directory: str | None = None) -> str:
    return os.path.join(directory or TOKENIZER_DIR, RANKS)


def encode_column(text: Column, directory: str | None = None) -> Column:
    path = rank_path(directory)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encode(t, path) for t in texts])

    return F.coalesce(ids(text), F.array().cast("array<int>"))


def decode_column(ids: Column, directory: str | None = None) -> Column:
    path = rank_path(directory)

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if r is None else decode(r, path) for r in rows])

    return text(ids)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", directory: str | None = None) -> DataFrame:
    """(key, ids) of every row of documents, whose keys are unique; rows are encoded one by one and not shuffled."""
    return documents.select(F.col(key), encode_column(F.col(text), directory).alias("ids"))
