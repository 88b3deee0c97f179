"""Winnowed fingerprints, their multiset similarity, MinHash bands and classification of pairs.

Fingerprints, minima and bands are built-in expressions on one row each. Equal fingerprints form a class beforehand and
only class representatives meet, so copies cost one row each. Pairs meet in an inverted index of their hashes that loses
none, the rarest asked for; hot hashes are salted. Pairs are verified exactly.

Defined results: null and blank texts and texts under one shingle have no fingerprint and no pairs; repeated rows of a key
count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import let
from tracewell.session import cut

SHINGLE, WINDOW = 5, 15
PERMS, BANDS = 64, 16
PRIME = (1 << 61) - 1
JACCARD, JACCARD_LEAST, CONTAINED, CONTAINED_LEAST = 0.70, 60, 0.80, 120
HOT, SALTS = 64, 16


def code_tokens(text: Column) -> Column:
    """Tokens of code: remarks vanish, string and number literals are 'l', words are in lower case, signs stand alone."""
    t = F.regexp_replace(text, r"(?s)/\*.*?\*/|(?m)(?:^|(?<=\s))(?://|#)[^\n]*", " ")
    t = F.regexp_replace(t, r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*+`", " l ")
    t = F.regexp_replace(t, r"\b[0-9][0-9A-Za-z_.]*\b", " l ")
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}_][\p{L}\p{N}_]*|[^\s\p{L}\p{N}_]"), F.lit(0))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def shingle_hashes(tokens: Column, k: int = SHINGLE) -> Column:
    """A 60-bit hash of every run of k tokens, from the head of its MD5; null if there is none."""
    each = lambda t, i: F.conv(F.left(F.md5(F.array_join(F.slice(t, i, k), " ")), F.lit(15)), 16, 10).cast("bigint")
    return let(tokens, lambda t: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: each(t, i))))


def winnow(hashes: Column, window: int = WINDOW) -> Column:
    """The least hash of every window (one window if there are fewer hashes), repeats in a row once."""
    least = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - window + 1, F.lit(1))), lambda i: F.array_min(F.slice(h, i, window)))
    return let(hashes, lambda h: let(least(h), lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1)))))


def fingerprints(rows: DataFrame, tokens: Column) -> DataFrame:
    """(key, shingles, hashes): the winnowed fingerprint of each text."""
    both = let(shingle_hashes(tokens), lambda h: F.struct(F.size(h).alias("shingles"), winnow(h).alias("hashes"), h.isNotNull().alias("any")))
    return rows.dropDuplicates(["key"]).select("key", F.explode(F.array(both)).alias("f")).where("f.any").select("key", "f.shingles", "f.hashes")


def multiset_counts(hashes: Column) -> Column:
    """A fingerprint as a map from hash to its count."""
    return let(F.array_distinct(hashes), lambda u: F.map_from_arrays(u, F.transform(u, lambda x: F.size(hashes) - F.size(F.array_remove(hashes, x)))))


def common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two count maps."""
    return F.aggregate(F.map_keys(a), F.lit(0), lambda n, k: n + F.least(F.element_at(a, k), F.coalesce(F.try_element_at(b, k), F.lit(0))))


def coefficients(perms: int = PERMS) -> list[tuple[int, int]]:
    """Multipliers and addends of the permutations, from a splitmix sequence."""
    mask, out, x = (1 << 64) - 1, [], 0x9E3779B97F4A7C15
    for _ in range(2 * perms):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        out.append((z ^ (z >> 31)) % (PRIME - 1) + 1)
    return list(zip(out[::2], out[1::2], strict=True))


def mulmod(a: int, h: np.ndarray, b: int) -> np.ndarray:
    """(a*h + b) mod 2**61-1 of 64-bit words, exact: by halves, as 2**61 is 1."""
    u, p = np.uint64, np.uint64(PRIME)
    a0, a1, h0, h1 = u(a & 0xFFFFFFFF), u(a >> 32), h & u(0xFFFFFFFF), h >> u(32)
    low, mid, high = a0 * h0, a1 * h0 + a0 * h1, a1 * h1
    x = (low & p) + (low >> u(61)) + (mid >> u(29)) + ((mid & u((1 << 29) - 1)) << u(32))
    x = (x & p) + (x >> u(61)) + high * u(8) % p + u(b)
    x = (x & p) + (x >> u(61))
    return np.where(x >= p, x - p, x)


def minima(hashes: Column, perms: int = PERMS) -> Column:
    """Per permutation the least of (a*h + b) mod 2**61-1 over hashes below 2**61, exact; in Arrow batches, over all lists of a batch at once. Null for an empty list."""
    pairs = coefficients(perms)

    @F.pandas_udf("array<bigint>")
    def each(lists: pd.Series) -> pd.Series:
        sizes = np.array([0 if x is None else len(x) for x in lists], dtype=np.int64)
        full = np.flatnonzero(sizes)
        out = [None] * len(lists)
        if len(full):
            flat = np.concatenate([np.asarray(lists.iloc[i], dtype=np.int64) for i in full]).astype(np.uint64)
            starts = np.cumsum(sizes[full]) - sizes[full]
            least = np.stack([np.minimum.reduceat(mulmod(a, flat, b), starts) for a, b in pairs], axis=1).astype(np.int64)
            for k, i in enumerate(full):
                out[i] = least[k]
        return pd.Series(out)

    return each(hashes)


def fast_minima(hashes: Column, perms: int = PERMS) -> Column:
    """Per permutation the least seeded 64-bit hash: the same estimate without decimal arithmetic."""
    return F.transform(F.sequence(F.lit(0), F.lit(perms - 1)), lambda p: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, p))))


def band_keys(mins: Column, bands: int = BANDS, perms: int = PERMS) -> Column:
    rows = perms // bands
    return let(mins, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(m, b * rows + 1, rows))))


def least_common(n: Column) -> Column:
    """How many of its n elements the smaller of a pair that classifies has in common: a Jaccard of j is a containment of 2j/(1+j) or more."""
    return F.ceil(n * min(CONTAINED, 2 * JACCARD / (1 + JACCARD)) - 1e-9).cast("int")


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b), a < b: a superset of the pairs that classify, by an inverted index of the multisets' elements.

    Of n elements the smaller multiset shares ``least_common(n)``, so of any n - least_common(n) + 1 it shares one: the
    rarest are asked for, all elements of the larger one are shown. Nothing is lost or capped.
    """
    big = reps.where(F.col("shingles") >= min(JACCARD_LEAST, CONTAINED_LEAST))
    each = big.select("key", F.size("hashes").alias("n"), F.explode(multiset_counts(F.col("hashes"))).alias("h", "c"))
    each = each.select("key", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("c")), lambda i: F.xxhash64("h", i))).alias("e"))
    counted = each.groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    shown = each.join(counted.where("df > 1"), "e", "left")
    rare = shown.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "e"))).alias("es"))
    ask = rare.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.explode(F.slice("es", F.lit(1), F.col("n") - least_common(F.col("n")) + 1)).alias("x")).select("a", "n_a", "x.e", "x.df").where("df > 1")
    salts = lambda df: F.when(df > HOT, SALTS).otherwise(1)
    left = ask.select("a", "n_a", "e", F.explode(F.sequence(F.lit(0), salts(F.col("df")) - 1)).alias("salt"))
    right = shown.where("df > 1").select(F.col("key").alias("b"), F.col("n").alias("n_b"), "e", F.pmod(F.xxhash64("key"), salts(F.col("df"))).cast("int").alias("salt"))
    met = left.join(right, ["e", "salt"]).where("a <> b AND n_a <= n_b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (key, rep), pairs (a, b, jaccard, contain_a, contain_b, n_a, n_b) of representatives, with all that classify."""
    named = cut(fps.withColumn("_p", F.md5(F.to_json(F.struct("hashes")))), "fingerprints")
    reps_of = named.groupBy("_p").agg(F.min("key").alias("rep"))
    members = named.join(reps_of, "_p").select("key", "rep")
    reps = named.join(reps_of.select(F.col("rep").alias("key")), "key", "left_semi").select("key", "shingles", "hashes")
    met = candidates(reps)
    side = lambda k: reps.select(F.col("key").alias(k), F.size("hashes").alias(f"n_{k}"), F.col("shingles").alias(f"s_{k}"), multiset_counts(F.col("hashes")).alias(f"m_{k}"))
    both = met.join(side("a"), "a").join(side("b"), "b").withColumn("_c", common(F.col("m_a"), F.col("m_b")))
    return members, both.select("a", "b", "s_a", "s_b", "n_a", "n_b", (F.col("_c") / (F.col("n_a") + F.col("n_b") - F.col("_c"))).alias("jaccard"), (F.col("_c") / F.col("n_a")).alias("contain_a"), (F.col("_c") / F.col("n_b")).alias("contain_b"))


def classify(pairs: DataFrame) -> DataFrame:
    """'copy' (high Jaccard, both large enough), else 'embeds' with its direction (high containment), else dropped."""
    contained = F.greatest("contain_a", "contain_b")
    kind = F.when((F.col("jaccard") >= JACCARD) & (F.least("s_a", "s_b") >= JACCARD_LEAST), "copy").when(
        (contained >= CONTAINED) & (F.least("s_a", "s_b") >= CONTAINED_LEAST), F.when(F.col("contain_a") >= F.col("contain_b"), "b embeds a").otherwise("a embeds b"))
    return pairs.withColumn("kind", kind).where("kind IS NOT NULL")


def across(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classified pairs of two collections' fingerprints (key, shingles, hashes): the scanned tree ``a`` against the reference ``b``, keys of ``b`` in b.

    Both meet in one inverted index; pairs within a collection are left out. Keys need not differ between the collections.
    """
    both = a.select(F.concat(F.lit("a:"), F.col("key").cast("string")).alias("key"), "shingles", "hashes").unionByName(b.select(F.concat(F.lit("b:"), F.col("key").cast("string")).alias("key"), "shingles", "hashes"))
    members, pairs = similar(both)
    found = classify(pairs)
    # Equal fingerprints are one class: its pairs are with itself.
    same = members.groupBy("rep").agg(F.min(F.when(F.col("key").startswith("a:"), F.col("key"))).alias("x"), F.min(F.when(F.col("key").startswith("b:"), F.col("key"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    sides = members.select("rep", F.left("key", F.lit(1)).alias("side")).distinct()
    has = lambda k, s: sides.where(F.col("side") == s).select(F.col("rep").alias(k))
    flip = {"copy": "copy", "a embeds b": "b embeds a", "b embeds a": "a embeds b"}
    other = F.create_map(*[F.lit(x) for kv in flip.items() for x in kv])
    turned = found.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard", other[F.col("kind")].alias("kind"))
    crossed = found.select("a", "b", "jaccard", "kind").unionByName(turned).join(has("a", "a"), "a", "left_semi").join(has("b", "b"), "b", "left_semi")
    equal = same.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard"), F.lit("copy").alias("kind"))
    return crossed.unionByName(equal)  # representatives; ``members`` tells whom they stand for


def shape_tokens(text: Column) -> Column:
    """Tokens by their class, so that renaming changes nothing: remarks vanish, literals are 'L', words 'W', signs stand for themselves."""
    t = F.regexp_replace(text, r"(?s)/\*.*?\*/|(?m)(?:^|(?<=\s))(?://|#)[^\n]*", " ")
    t = F.regexp_replace(t, r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*+`|\b[0-9][0-9A-Za-z_.]*\b", " \u0001 ")
    t = F.regexp_replace(t, r"[\p{L}_$][\p{L}\p{N}_$]*", "W")
    return F.regexp_extract_all(F.replace(t, F.lit("\u0001"), F.lit("L")), F.lit(r"\S"), F.lit(0))
