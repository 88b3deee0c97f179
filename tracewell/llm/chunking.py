"""Splitting long texts at natural boundaries by agglomerative merging.

A text is cut into atomic segments at line and sentence ends; a segment too large for an overlap
is cut further at its pre-tokenizer pieces. Every gap between two segments has a strength:
section break, blank line, line end, sentence end, clause, word, inside a word. Segments start
small and neighbours are merged weakest gap first (a heap, ties: the smaller joint size, then the
earlier gap) while the joint size plus the overlap stays within the limit. What remains are the
pieces; each after the first is led by up to ``overlap`` tokens of the end of the one before, begun
at a gap as well.

The text is encoded once, and segments are counted by where its tokens begin. The sizes of pieces are exact: each finished piece is encoded by itself, loses overlap if it is too long, and is
halved at a gap in the rare case that its parts encode to fewer tokens than the whole. A pre-token
longer than the room is cut by tokens at character boundaries.

Defined results: null and empty texts and texts within the limit give no pieces; the pieces
without their overlaps are the text; rows are split one by one, so keys should be unique, as those of documents are.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tokens import PATTERN, encode, encoding, id_bytes, rank_path

LIMIT, OVERLAP = 512, 64
SCHEMA = "doc_id bigint, piece_no int, start_char int, end_char int, overlap_tokens int, n_tokens int, piece string"

_PIECE = regex.compile(PATTERN)
#: Line ends with all blank lines after them; sentence ends before white space; ends of sentences without spaces.
_GAP = regex.compile(r"\n(?:[ \t\r]*\n)*(?!$)|(?<=[.!?…][\"')\]]?)(?=\s[^\n\s])|[。！？；]+(?!$)")
_SECTION = frozenset("#=-*")
_SENTENCE_END = frozenset(".!?。！？…")
_CLAUSE_END = frozenset(",;:，；：、)]}")


def gap_strength(before: str, after: str) -> int:
    """How natural a cut between two neighbouring pre-tokens is: 0 (inside a word) to 6 (section)."""
    space = after if after.isspace() else after[: len(after) - len(after.lstrip())]
    if before.isspace():
        breaks = before.count("\n")
        if breaks >= 2:
            return 6 if after.lstrip().startswith(("#", "=", "-", "*")) else 5
        if breaks:
            return 4
        return 1
    if "\n" in space:
        return 0  # the cut belongs after the white space
    if before[-1] in _SENTENCE_END:
        return 3 if space or ord(before[-1]) > 0x2000 else 0
    if before[-1] in _CLAUSE_END:
        return 2 if space or ord(before[-1]) > 0x2000 else 0
    return 1 if space else 0


@functools.lru_cache(200_000)
def piece_size(piece: str, path: str) -> int:
    return len(encoding(path).encode_ordinary(piece))


def fine_atoms(text: str, begin: int, end: int, strength: int, path: str, room: int) -> Iterator[tuple[int, int, int]]:
    """The pre-tokens of a segment as atoms; none has more than ``room`` tokens."""
    enc, table, before = encoding(path), id_bytes(path), ""
    for m in _PIECE.finditer(text, begin, end):
        piece = m.group()
        if before:
            strength = gap_strength(before, piece)
        before = piece
        if (size := piece_size(piece, path)) <= room:
            yield m.start(), size, strength
            continue
        ids, at, i = enc.encode_ordinary(piece), m.start(), 0
        while i < len(ids):
            # A character may span tokens: shorten until the bytes are whole characters.
            k = min(room, len(ids) - i)
            while True:
                try:
                    part = b"".join(table[x] for x in ids[i : i + k]).decode("utf-8")
                    break
                except UnicodeDecodeError:
                    k -= 1
            yield at, k, strength if i == 0 else 0
            at, i = at + len(part), i + k


@functools.cache
def id_sizes(path: str) -> np.ndarray:
    """Bytes of each token."""
    table = id_bytes(path)
    return np.array([len(table.get(i, b"")) for i in range(max(table) + 1)], dtype=np.int64)


class Places:
    """Where the tokens of a whole text begin, to count those of any segment without encoding it again."""

    def __init__(self, text: str, ids: list[int], path: str):
        sizes = id_sizes(path)[np.asarray(ids, dtype=np.int64)]
        self.starts = np.cumsum(sizes) - sizes
        self.bytes = None
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            self.bytes = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])

    def count(self, begin: int, end: int) -> int:
        if self.bytes is not None:
            begin, end = self.bytes[begin], self.bytes[end]
        a, b = np.searchsorted(self.starts, (begin, end))
        return int(b - a)


def atoms(text: str, path: str, room: int, fine_above: int, places: Places) -> list[tuple[int, int, int]]:
    """(start, tokens, strength of the gap before) of each atomic segment; tokens as the whole text has them."""
    out, begin, strength = [], 0, 6
    for m in itertools.chain(_GAP.finditer(text), (None,)):
        end = m.end() if m else len(text)
        if end > begin:
            size = places.count(begin, end)
            if size <= fine_above:
                out.append((begin, max(size, 1), strength))
            else:
                out += fine_atoms(text, begin, end, strength, path, room)
            begin = end
        if m:
            breaks = m.group().count("\n")
            strength = 3 if not breaks else 4 if breaks == 1 else 6 if text[end : end + 1] in _SECTION else 5
    return out


def merge(sizes: list[int], strengths: list[int], most: int) -> list[int]:
    """First atoms of the pieces: neighbours merged weakest gap first while the joint size is at most ``most``."""
    n = len(sizes)
    size, left, right, alive = list(sizes), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strengths[i], sizes[i - 1] + sizes[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, joint, i = heapq.heappop(heap)
        if not alive[i] or i == 0:
            continue
        a = left[i]
        now = size[a] + size[i]
        if now != joint:
            if now <= most:
                heapq.heappush(heap, (strength, now, i))
            continue
        if now > most:
            continue
        size[a], alive[i], right[a] = now, False, right[i]
        if right[i] < n:
            left[right[i]] = a
            heapq.heappush(heap, (strengths[right[i]], size[a] + size[right[i]], right[i]))
        if a > 0:
            heapq.heappush(heap, (strengths[a], size[left[a]] + size[a], a))
    return [i for i in range(n) if alive[i]]


def split(text: str | None, path: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """(start, end, overlap tokens, tokens, piece) of each piece; empty for a text within the limit."""
    if not text or len(text.encode()) <= limit or len(ids := encode(text, path)) <= limit:
        return []
    parts = atoms(text, path, limit - overlap, overlap, Places(text, ids, path))
    starts, sizes, strengths = map(list, zip(*parts, strict=True))
    heads = merge(sizes, strengths, limit - overlap)
    out, k = [], 0
    while k < len(heads):
        h, stop = heads[k], heads[k + 1] if k + 1 < len(heads) else len(starts)
        begin, end = starts[h], starts[stop] if stop < len(starts) else len(text)
        lead, led = h, 0
        if k:
            best = None
            while lead > heads[k - 1] and led + sizes[lead - 1] <= overlap:
                lead -= 1
                led += sizes[lead]
                if best is None or strengths[lead] >= best[2]:
                    best = (lead, led, strengths[lead])
            # The overlap begins at the strongest gap within it, at the earliest of those.
            if best and best[2] >= 2:
                lead, led = best[:2]
        while True:
            # The overlap is counted as it is encoded by itself, at the end of the piece before.
            led = len(encode(text[starts[lead] : begin], path)) if lead < h else 0
            n = len(encode(text[starts[lead] : end], path))
            if (n <= limit and led <= overlap) or lead == h:
                break
            lead += 1
        if n > limit:
            heads.insert(k + 1, max(range(h + 1, stop), key=lambda i: (strengths[i], -abs(2 * i - h - stop))))
            continue
        out.append((begin, end, led, n, text[starts[lead] : end]))
        k += 1
    return out


def split_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, directory: str | None = None) -> DataFrame:
    """The pieces of every text longer than ``limit`` tokens, in order."""
    path = rank_path(directory)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *p) for k, t in zip(b["doc_id"], b["text"], strict=True) for i, p in enumerate(split(t, path, limit, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_char", "end_char", "overlap_tokens", "n_tokens", "piece"])

    # A text has at most one token per byte: shorter ones never reach Python.
    long = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    return long.mapInPandas(pieces, SCHEMA)
