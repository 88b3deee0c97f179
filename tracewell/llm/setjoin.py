"""Exact similarity self-join of sets by universe partition and pigeonhole.

Sets are Jaccard-similar at ``t`` only if their symmetric difference is at most
H = (1-t)/(1+t) * (|x|+|y|). Sets are put into size bands; a pair is found in the band of its
larger set, where every token is hashed to one of m segments. Each set shows there, per
segment, the hash of its segment (for partners with equal segments) and the hashes of the
segment less one token (for partners that differ there by one). The larger set asks, in its own
band only, and chooses per segment to skip it, to ask for equality or to allow one difference:
allowances 0, 1, 2 whose sum must exceed H, as then some segment differs by no more than allowed.
The choice takes the cheapest first, by how many sets show each signature, so hot and empty
segments are skipped. The counts are a sketch over all rows whose width follows the number of
signatures; they steer the choice and never lose a pair. A bit map of the asked signatures keeps
shown ones that nobody asks for out of the shuffle. What meets is verified exactly against both sets.

Sets that are equal are one class beforehand; candidates join class representatives only, so a
group of copies that holds a third of all rows costs one row per copy. Signatures whose counter stands far
out of the mean are split over salts, and so are large classes where pairs of ids are asked for. Nothing is capped.

Defined results: null, empty and short sets (under ``least`` tokens) match nothing, repeats of a
token and of a row count once, a list whose length is no multiple of eight bytes is read up to the
last whole token, ids that are null are dropped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut

JACCARD, LEAST = 0.7, 20
#: Segments per unit of allowance; more than 1/2 leaves room to skip hot segments.
SEGMENTS_PER_DIFFERENCE = 0.8
#: Size bands grow by (1/t) ** (1/BANDS): a partner's band is at most BANDS below.
BANDS = 2
#: Signatures a set shows per token, about; parts of the sketches that travel apart; bounds of the sketches.
SHOWN_PER_TOKEN, SLICES, MOST_COUNTERS, MOST_BITS = 4, 64, 1 << 24, 1 << 27
#: A signature is hot that so many sets show, or so many times the mean of the counters if that is more.
SALT_ABOVE, SALTS = 64, 32
#: Rows of a class of equal sets in one bucket; tokens that are worked on at once.
CLASS_ROWS, PART_TOKENS = 256, 400_000

_U = np.uint64
LESS = _U(0x2545F4914F6CDD1D)
#: Values of the byte-wide counters.
DECODED = np.array([*range(129), *(math.floor(128 * 2 ** (i / 8)) for i in range(1, 128))], dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element, with wrap-around."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def tokens_of(fp: Column) -> Column:
    """Distinct 64-bit tokens of a binary list of eight-byte words, as sorted longs."""
    words = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(fp) / 8).cast("int") - 1), lambda i: F.xxhash64(F.substring(fp, i * 8 + 1, F.lit(8))))
    return F.when(F.octet_length(fp) >= 8, F.array_sort(F.array_distinct(words)))


def classes(files: DataFrame, key: str, fp: str, least: int) -> DataFrame:
    """(id, rep, tokens): sets of at least ``least`` tokens; equal sets share the least id as rep, which alone holds the tokens."""
    sets = (
        files.where(F.col(key).isNotNull() & (F.octet_length(fp) >= 8 * least))
        .select(F.col(key).alias("id"), tokens_of(F.col(fp)).alias("tokens"))
        .where(F.size("tokens") >= least)
        .withColumn("_print", F.unhex(F.md5(F.array_join(F.transform("tokens", lambda x: F.hex(x)), ","))))
    )
    reps = sets.groupBy("_print").agg(F.min("id").alias("rep"))
    named = sets.join(reps, "_print").select("id", "rep", F.when(F.col("id") == F.col("rep"), F.col("tokens")).alias("tokens"))
    return named.dropDuplicates(["id"])


def band_of(n: int, t: float) -> int:
    return math.floor(math.log(n) / math.log((1 / t) ** (1 / BANDS)) + 1e-9)


def needed(band: int, t: float) -> int:
    """One more than the greatest symmetric difference of a pair whose larger set lies in ``band``."""
    top = math.ceil((1 / t) ** ((band + 1) / BANDS))
    return math.floor((1 - t) / (1 + t) * 2 * top + 1e-9) + 1


class Flat:
    """The sets of an Arrow batch as one array of tokens, with what each set needs: its band, segments and allowance."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, t: float):
        self.t, self.tokens, self.sizes = t, tokens, sizes
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        found, place = np.unique(sizes, return_inverse=True)
        self.band = np.array([band_of(int(n), t) for n in found], dtype=np.int64)[place]
        self.h = mix(tokens)

    def of(self, band: np.ndarray, values) -> np.ndarray:
        found, place = np.unique(band, return_inverse=True)
        return np.array([values(int(b)) for b in found], dtype=np.int64)[place]

    def signatures(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whole, its set, less, segment of less): a signature per segment, and one per token for its segment without it."""
        m = self.of(band, lambda b: max(1, math.ceil(needed(b, self.t) * SEGMENTS_PER_DIFFERENCE)))
        first = np.cumsum(m) - m
        seg = first[self.row] + (mix(self.h + _U(0x5851F42D4C957F2D)) % m.astype(_U)[self.row]).astype(np.int64)
        sums = np.zeros(int(m.sum()), dtype=_U)
        np.add.at(sums, seg, self.h)
        owner = np.repeat(np.arange(len(m)), m)
        place = mix((np.arange(len(owner)) - first[owner] + band[owner] * 1_000_003 + 17).astype(_U))
        return mix(sums + place), owner, mix(sums[seg] - self.h + place[seg]) ^ LESS, seg

    def shown(self) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, their sets) by which partners find the sets: in their own band and those a larger partner may lie in."""
        sigs, rows = [], []
        for up in range(BANDS + 1):
            whole, owner, less, _ = self.signatures(self.band + up)
            sigs += [whole, less]
            rows += [owner, self.row]
        return np.concatenate(sigs), np.concatenate(rows)

    def asked(self, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, their sets) that the cheapest allowances ask for; those that no other set shows are left out."""
        whole, owner, less, seg = self.signatures(self.band)
        bare, as_less = less ^ LESS, whole ^ LESS
        cost = lambda s: DECODED[counters[(s & _U(len(counters) - 1)).astype(np.int64)]]
        n_whole, n_as_less, n_bare = cost(whole), cost(as_less), cost(bare)
        second = n_as_less + np.bincount(seg, weights=n_bare, minlength=len(whole)).astype(np.int64)
        # The step to one difference never comes before the step to equality: it is priced at no less.
        prices, steps, sets = np.concatenate([n_whole, np.maximum(n_whole, second)]), np.repeat([0, 1], len(whole)), np.concatenate([owner, owner])
        order = np.lexsort((steps, prices, sets))
        counts = np.bincount(sets, minlength=len(self.sizes))
        rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[sets[order]]
        kept = order[rank < self.of(self.band, lambda b: needed(b, self.t))[sets[order]]]
        one, two = kept[kept < len(whole)], kept[kept >= len(whole)] - len(whole)
        wide = np.zeros(len(whole), dtype=bool)
        wide[two] = True
        # A set shows its whole segments itself: a counter of one is its own. The others it does not show.
        one, two, by_token = one[n_whole[one] > 1], two[n_as_less[two] > 0], np.flatnonzero(wide[seg] & (n_bare > 0))
        return np.concatenate([whole[one], as_less[two], bare[by_token]]), np.concatenate([owner[one], owner[two], self.row[by_token]])


def flats(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[tuple[Flat, np.ndarray]]:
    """The sets and ids of Arrow batches, in parts of about ``PART_TOKENS`` tokens."""
    for b in batches:
        lists, ids = b.column("tokens"), b.column("id").to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).view(_U)
        ends = np.cumsum(sizes)
        part = (ends - 1) // PART_TOKENS
        for at in np.flatnonzero(np.diff(part, prepend=-1)) if len(ids) else []:
            last = int(np.searchsorted(part, part[at], side="right"))
            yield Flat(values[ends[at] - sizes[at] : ends[last - 1]], sizes[at:last], t), ids[at:last]


def power_of_two(n: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, math.ceil(n) - 1).bit_length()))


def gathered(reps: DataFrame, t: float, size: int, kind: type, fill, fold, finish=lambda x: x) -> np.ndarray:
    """An array of bytes: filled by every task, folded over the tasks and finished by slices, which travel packed; slices of zeros stay."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=kind)
        for flat, _ in flats(batches, t):
            fill(held, flat)
        slices = held.reshape(SLICES, -1)
        for k in np.flatnonzero(slices.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "packed": pa.array([zlib.compress(slices[k].tobytes(), 1)], pa.binary())})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = None
        for x in b["packed"]:
            one = np.frombuffer(zlib.decompress(x), dtype=kind)
            total = one if total is None else fold(total, one)
        return pd.DataFrame({"slice": b["slice"].iloc[:1], "packed": [zlib.compress(finish(total).tobytes(), 1)]})

    schema = "slice int, packed binary"
    out = np.zeros((SLICES, size // SLICES), dtype=np.uint8)
    for k, packed in reps.select("id", "tokens").mapInArrow(each, schema).groupBy("slice").applyInPandas(add, schema).collect():
        out[k] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    return out.reshape(-1)


def encode_counts(n: np.ndarray) -> np.ndarray:
    """Counts in a byte each: exact up to 128, then within a tenth."""
    return np.searchsorted(DECODED, n, side="right").astype(np.int64).clip(1, 256).__sub__(1).astype(np.uint8)


def candidates(reps: DataFrame, t: float) -> DataFrame:
    """(a, b): pairs of set ids, a < b, that some segment brings together.

    A sketch counts all shown signatures, a bit map holds the asked ones. Both are sized by the number of signatures; at
    their bounds (16 MB each) they tell less and cost more rows, and lose nothing.
    """
    context = reps.sparkSession.sparkContext
    tokens = reps.agg(F.sum(F.size("tokens"))).first()[0] or 0
    width = power_of_two(2 * SHOWN_PER_TOKEN * tokens, SLICES << 4, MOST_COUNTERS)
    bits = power_of_two(8 * tokens, SLICES << 7, MOST_BITS)

    def count(held: np.ndarray, flat: Flat) -> None:
        np.add.at(held, (flat.shown()[0] & _U(width - 1)).astype(np.int64), 1)

    counted = gathered(reps, t, width, np.uint32, count, np.add, encode_counts)
    # Hot is what stands out of the counters' own load, whatever the number of sets.
    hot_above = SALT_ABOVE * max(1.0, float(np.bincount(counted, minlength=256) @ DECODED) / width)
    counters = context.broadcast(counted)

    def mark(held: np.ndarray, flat: Flat) -> None:
        s = bit(flat.asked(counters.value)[0])
        np.bitwise_or.at(held, s >> 3, (1 << (s & 7)).astype(np.uint8))

    def bit(s: np.ndarray) -> np.ndarray:
        return (s >> _U(20) & _U(bits - 1)).astype(np.int64)

    wanted = context.broadcast(gathered(reps, t, bits >> 3, np.uint8, mark, np.bitwise_or))

    def hot(s: np.ndarray) -> np.ndarray:
        return DECODED[counters.value[(s & _U(width - 1)).astype(np.int64)]] > hot_above

    def rows(batches: Iterator[pa.RecordBatch], asks: bool) -> Iterator[pa.RecordBatch]:
        for flat, ids in flats(batches, t):
            sigs, of = flat.asked(counters.value) if asks else flat.shown()
            if asks:
                times = np.where(hot(sigs), SALTS, 1)
                salt = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                sigs, of = np.repeat(sigs, times), np.repeat(of, times)
            else:
                at = bit(sigs)
                met = wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
                sigs, of = sigs[met], of[met]
                salt = np.where(hot(sigs), ids[of] % SALTS, 0)
            yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(ids[of]), pa.array(flat.sizes[of].astype(np.int32))], ["sig", "salt", "id", "n"])

    schema = "sig bigint, salt int, id bigint, n int"
    source = reps.select("id", "tokens")
    a, b = source.mapInArrow(lambda x: rows(x, True), schema).alias("a"), source.mapInArrow(lambda x: rows(x, False), schema).alias("b")
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.id") != F.col("b.id")))
    near = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * t - 1e-9
    return met.where(near).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def similar_sets(files: DataFrame, key: str = "file_id", fp: str = "fp", t: float = JACCARD, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, rep) of every large enough set, pairs (a, b, jaccard) of representatives."""
    held = cut(classes(files, key, fp, least), "sets")
    reps = held.where(F.col("id") == F.col("rep")).select("id", "tokens")
    pairs = candidates(reps, t)
    sets_a, sets_b = reps.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), reps.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    scored = pairs.join(sets_a, "a").join(sets_b, "b").withColumn("_i", both).withColumn("_u", F.size("ta") + F.size("tb") - F.col("_i"))
    exact = scored.where(F.col("_i") >= F.col("_u") * t - 1e-9).select("a", "b", (F.col("_i") / F.col("_u")).alias("jaccard"))
    return held.select("id", "rep"), cut(exact, "similar")


def spread(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join of two frames on ``on``; ``right`` has in ``copies`` how many rows share its key: a large class is cut into buckets
    that the left rows are copied to, so no task gets a whole class and its partners."""
    buckets = F.ceil(F.col("copies") / CLASS_ROWS).cast("int")
    sizes = right.groupBy(on).agg(F.max(buckets).alias("_k")).where("_k > 1")
    l = left.join(sizes, on, "left").withColumn("_b", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    r = right.withColumn("_b", F.when(buckets > 1, F.pmod(F.xxhash64("id"), buckets)).otherwise(0).cast("int"))
    return l.join(r, [on, "_b"]).drop("_b", "copies")


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of ids, from the pairs of representatives and from within the classes; large classes are split on both ways."""
    counted = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    sized = members.join(counted, "rep")
    side = lambda rep: sized.select(F.col("rep").alias(rep), "id", "copies")
    first = spread(pairs.select("a", "b"), side("a"), "a").select("b", F.col("id").alias("x"))
    across = spread(first, side("b"), "b").select(F.least("x", "id").alias("x"), F.greatest("x", "id").alias("y"))
    copies = sized.where("copies > 1")
    within = spread(copies.select("rep", F.col("id").alias("x")), copies, "rep").where("x < id").select("x", F.col("id").alias("y"))
    return across.unionByName(within)


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, group): connected components by alternating star contraction, links and labels kept distributed.

    Each round is two aggregations on the edges; a round's result is written to the shared folder. The number
    of rounds grows with the logarithm of the longest chain.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    links = cut(links, "links")
    before = None
    for _ in range(most_rounds):
        # Large star: neighbours above u take u's least neighbour.
        sym = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Small star: neighbours at or below u, and u itself, take the least.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("_e"))
        links = cut(small.select(F.col("_e.x").alias("u"), F.col("_e.y").alias("v")).where(F.col("u") != F.col("v")).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    label = links.groupBy("u").agg(F.min("v").alias("group"))
    return nodes.join(label, nodes["id"] == label["u"], "left").select("id", F.coalesce("group", "id").alias("group"))
