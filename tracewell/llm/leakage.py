"""Evaluation items that stand, whole or in part, in the texts of a corpus.

Test items are put into a BM25 inverted index whose postings carry block maxima. Every
passage of every text queries it: passages are windows of words that overlap by one word
less than the shortest run that counts, so each run lies whole in some passage. Retrieval
bounds every block of items by its block maxima, skips the blocks that cannot reach a threshold
and scores the rest, as block-max WAND does with its pivots, and returns every item whose
score reaches that item's own threshold. The threshold is the least score
that any of the item's runs can have (term weights without length normalisation, each term
once), so retrieval loses nothing. What it returns is verified exactly: the passage must
hold ``run`` consecutive words of the item, or all of them if it has fewer.

The index is built on the driver from the items and travels with the tasks; its size is
checked against ``max_items_bytes`` and a larger set of items is refused rather than cut
(index it in several calls: results of disjoint item sets are simply united).

Words are runs of letters and digits; case, accents and invisible characters mean nothing.
Defined results: null or empty texts and items match nothing; rows delivered twice count
once; an item without words is never given away.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, PASSAGE, BLOCK = 12, 64, 8
MAX_ITEMS_BYTES = 64 << 20

_WORD = re.compile(r"[^\W_]+")
_ASCII = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Words without case, accents and invisible characters."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    plain = unicodedata.normalize("NFKD", text.casefold())
    plain = unicodedata.normalize("NFKD", plain.casefold())
    return _WORD.findall("".join(c for c in plain if unicodedata.category(c) not in ("Mn", "Me", "Cf", "Mc") and not 0xFE00 <= ord(c) <= 0xFE0F))


class Bm25Index:
    """Postings with block maxima over a bounded set of items."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, k1: float = 0.1, block: int = BLOCK):
        self.run = run
        self.ids, self.texts = [], []
        for item_id, text in sorted(items, key=lambda x: x[0]):
            if w := words(text):
                self.ids.append(item_id)
                self.texts.append(w)
        n = len(self.ids)
        df = Counter(t for w in self.texts for t in set(w))
        self.idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.least = []
        for i, w in enumerate(self.texts):
            tf = Counter(w)
            for t, f in tf.items():
                self.postings[t].append((i, self.idf[t] * f * (k1 + 1) / (f + k1)))
            weight = {t: self.idf[t] * f * (k1 + 1) / (f + k1) for t, f in tf.items()}
            runs = [w[a : a + run] for a in range(max(1, len(w) - run + 1))]
            self.least.append(min(sum(weight[t] for t in set(r)) for r in runs) - 1e-9)
        self.top = {t: max(x for _, x in p) for t, p in self.postings.items()}
        self.floor = min(self.least, default=math.inf)
        #: Blocks of consecutive items: per term the blocks it stands in and its greatest weight there; per block the least threshold.
        self.blocks = {}
        for t, p in self.postings.items():
            most: dict[int, float] = {}
            for i, x in p:
                most[i // block] = max(most.get(i // block, 0.0), x)
            self.blocks[t] = (np.fromiter(most, dtype=np.int64), np.fromiter(most.values(), dtype=np.float64))
        self.block_floor = np.array([min(self.least[a : a + block]) for a in range(0, n, block)])
        self.block = block
        #: Exact check: the item numbers of each run.
        self.runs: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for i, w in enumerate(self.texts):
            for a in range(max(1, len(w) - run + 1)):
                self.runs[tuple(w[a : a + run])].add(i)

    def retrieve(self, terms: list[str]) -> list[int]:
        """Items whose score for the passage's terms reaches their threshold.

        The upper bounds of all blocks come first; blocks whose bound stays below their least threshold are
        skipped whole, and the terms' postings are opened only in the others.
        """
        where, most = zip(*(self.blocks[t] for t in terms), strict=True)
        bound = np.bincount(np.concatenate(where), np.concatenate(most), minlength=len(self.block_floor))
        found = []
        for k in np.flatnonzero(bound >= self.block_floor).tolist():
            low, high, scores = k * self.block, (k + 1) * self.block, defaultdict(float)
            for t in terms:
                p = self.postings[t]
                for j in range(bisect_left(p, (low,)), len(p)):
                    if p[j][0] >= high:
                        break
                    scores[p[j][0]] += p[j][1]
            found += [i for i, x in scores.items() if x >= self.least[i]]
        return sorted(found)

    def verify(self, passage: list[str], item: int) -> int:
        """Consecutive words of the item in the passage, if enough; else 0."""
        own = self.texts[item]
        need = min(self.run, len(own))
        return next((need for a in range(len(passage) - need + 1) if item in self.runs.get(tuple(passage[a : a + need]), ())), 0)

    def leaks(self, text: str | None, passage: int = PASSAGE) -> set[int]:
        """Item ids given away by a text."""
        w = words(text)
        top = self.top
        known = [t if t in top else "" for t in w]
        if sum(top[t] for t in set(known) if t) < self.floor:
            return set()
        found: set[int] = set()
        passage = max(passage, 2 * self.run)
        step = passage - self.run + 1
        for a in range(0, max(1, len(w) - self.run + 1), step):
            terms = set(known[a : a + passage])
            terms.discard("")
            if sum(map(top.__getitem__, terms)) < self.floor:
                continue
            for i in self.retrieve(sorted(terms)):
                if self.ids[i] not in found and self.verify(w[a : a + passage], i):
                    found.add(self.ids[i])
        return found


def bounded_items(items: DataFrame, key: str, text: str, most: int = MAX_ITEMS_BYTES) -> list[tuple[int, str | None]]:
    """The items on the driver, after a check of their size."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size > most:
        raise ValueError(f"test items of {size} bytes exceed {most}: index them in several calls")
    return [(r[0], r[1]) for r in items.select(key, text).dropDuplicates([key]).collect()]


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, item_id): each document with each item it gives away."""
    held = bounded_items(items, "item_id", "text")
    index = documents.sparkSession.sparkContext.broadcast(held)
    built: dict[str, Bm25Index] = {}

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bm25 = built.get("x") or built.setdefault("x", Bm25Index(index.value, run))
        for b in batches:
            rows = [(d, i) for d, t in zip(b["doc_id"], b["text"], strict=True) for i in sorted(bm25.leaks(t, passage))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype("int64")

    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return docs.mapInPandas(probe, "doc_id bigint, item_id bigint").distinct()
