"""Incremental record linkage of findings: which rows of a new batch repeat earlier ones.

History is kept as tables in a shared folder, each batch in a directory of its own (``batch=k``) that is written once and
never again; a batch that failed is simply written anew:
- ``reps``: one row per distinct issue text (target, rule, words or path+message) with the first scan that delivered it,
- ``keys``: the blocking keys of the issue texts,
- ``order``: how common words are, counted in the first batch and frozen (64 KiB),
- ``patterns``: counts of comparison patterns, from which the weights are learned,
- ``links`` and ``clusters``: near links, and the representative of each issue text whose cluster changed; the latest counts.
Rows are sorted by ``part``, a hash of the target, so a batch reads only the pages of the targets it delivers. A batch
is reduced to its distinct issue texts; those that are new probe ``keys`` by an equi-join; what they meet is scored, what
scores enough is verified, and the clusters that a new link touches are relabelled. History is never compared with itself
again and nothing of it is written again.

Blocking is by prefixes: two excerpts of at most n words that are at most n // 5 edits apart have n - n // 5 words in
common (with repeats), so of the n // 5 + 1 words of each that come first in any one order they share one. The order puts
rare words first; being frozen it is the same for all batches. A text of 400 words has 81 keys. Keys carry target and rule,
those that many texts have are split over salts.

Fields (common words, path, line band, severity, message) are scored with Fellegi-Sunter weights learned by
expectation maximisation from the counts of comparison patterns, at most 32 rows a batch. A pair whose score is below what
any pair within the allowed edits can have is dropped unverified, so the score prunes and loses nothing. What a repeat is,
the exact rule decides: at most one fifth of the longer excerpt's words apart, or, without an excerpt, the same path and message.

Defined results: null target or rule never repeats; an empty excerpt is a text of no words, equal to any
other such; a null excerpt compares by path and message (nulls equal nulls there); rows delivered twice count
once; a scan's own rows never make each other repeats; column names of the input are not reserved.
"""

from __future__ import annotations

import math
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.setjoin import components
from tracewell.session import cut, new_folder

#: Edits allowed: one word in so many of the longer text.
PER_EDIT = 5
SALT_ABOVE, SALTS = 256, 32
#: Parts that targets are hashed to; counters of the frozen order; batches that the queries deliver the scans in.
PARTS, COUNTERS, BATCHES = 4096, 1 << 16, 3

SCHEMAS = {
    "reps": "part int, issue bigint, p1 bigint, p2 bigint, blk bigint, words string, n int, first_scan bigint, path bigint, message bigint, severity string, line int",
    "keys": "part int, key bigint, issue bigint, n int",
    "order": "counters binary",
    "patterns": "bits int, n bigint",
    "links": "part int, a bigint, b bigint, distance int, longer int, score double",
    "clusters": "issue bigint, cluster bigint, batch_no int",
}
FIELDS = ("common", "same_path", "same_message", "same_severity", "near_line")


class History:
    """The tables of the batches so far, in a folder; ``batches`` is how many count (later ones are left over from failures)."""

    def __init__(self, spark: SparkSession, folder: str, batches: int = 0):
        self.spark, self.folder, self.batches = spark, folder, batches

    def read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.schema(SCHEMAS[name]).parquet(*[os.path.join(self.folder, name, f"batch={k}") for k in range(self.batches)])
        return df if parts is None else df.where(F.col("part").isin(parts)) if len(parts) < PARTS else df

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Write the batch's rows of a table and return them read back; they belong to the history once ``batches`` is raised."""
        path = os.path.join(self.folder, name, f"batch={self.batches}")
        rows = df.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in SCHEMAS[name].split(", ")])
        rows = rows.sortWithinPartitions("part") if "part" in rows.columns else rows
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(SCHEMAS[name]).parquet(path)


def normal_text(excerpt: Column) -> Column:
    """The runs of letters, digits and underscores, with one blank between them."""
    return F.trim(F.regexp_replace(excerpt, r"[^\p{L}\p{Nd}\p{Nl}\p{No}_]+", " "))


def plain_path(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./+)+", "")


def issue_texts(findings: DataFrame) -> DataFrame:
    """The issue text of each delivered finding, its 128-bit print (p1, p2) and the fields that are compared."""
    rows = findings.where("finding_id IS NOT NULL AND scan_id IS NOT NULL AND target IS NOT NULL AND rule_id IS NOT NULL")
    path, message = F.xxhash64(F.coalesce(plain_path(F.col("path")), F.lit("\x1e"))), F.xxhash64(F.coalesce("message", F.lit("\x1e")))
    rows = rows.select("finding_id", "scan_id", "target", "rule_id", "line", F.lower("severity").alias("severity"), path.alias("path"), message.alias("message"), normal_text(F.col("excerpt")).alias("words"))
    what = F.coalesce(F.concat(F.lit("E"), F.col("words")), F.concat_ws(" ", F.lit("N"), F.col("path").cast("string"), F.col("message").cast("string")))
    return rows.select(
        "finding_id", "scan_id", F.pmod(F.xxhash64("target"), F.lit(PARTS)).cast("int").alias("part"), F.xxhash64("target", "rule_id").alias("blk"),
        F.xxhash64("target", "rule_id", what).alias("p1"), F.xxhash64(F.lit(1), what, "rule_id", "target").alias("p2"), "words", "path", "message", "severity", "line",
    )


def edits(n: Column) -> Column:
    return F.floor(n / PER_EDIT).cast("int")


def word_list(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def counter_of(word_hash: Column) -> Column:
    return F.pmod(word_hash, F.lit(COUNTERS)).cast("int")


def learn_order(texts: DataFrame) -> bytes:
    """How many issue texts hold a word of each counter, as a byte each: sixteen steps a doubling would be too fine, two are kept."""
    counted = texts.select(F.explode(F.array_distinct(word_list(F.col("words")))).alias("w")).groupBy(counter_of(F.xxhash64("w")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    held = np.zeros(COUNTERS)
    for r in counted.collect():  # at most as many rows as counters
        held[r["c"]] = r["n"]
    return np.minimum(255, np.floor(2 * np.log2(held + 1))).astype(np.uint8).tobytes()


def blocking_keys(texts: DataFrame, order: bytes) -> DataFrame:
    """(part, key, issue, n): the rare-first prefix of each text's words, as keys; the i-th of equal words is the i-th everywhere."""
    commonness = lambda h: F.substring(F.lit(order), counter_of(h) + 1, F.lit(1))
    ranked = F.array_sort(F.transform(F.transform(word_list(F.col("words")), lambda w: F.xxhash64(w)), lambda h: F.struct(commonness(h).alias("c"), h.alias("h"))))
    prefix = texts.where(F.col("n") >= PER_EDIT - 1).select("part", "issue", "blk", "n", F.slice(ranked, F.lit(1), edits(F.col("n")) + 1).alias("p"))
    keys = F.transform("p", lambda x, i: F.xxhash64("blk", x["h"], i + 1 - F.array_position("p", x)))
    return prefix.select("part", F.explode(keys).alias("key"), "issue", "n")


def word_distance(a: Column, b: Column) -> Column:
    """Edits of words between two word lists: both are spelled as strings with one character per distinct word.

    Characters are code points from U+0100 on, those of surrogates left out, as pairs of surrogates beyond U+FFFF: a pair of
    texts may have a million distinct words.
    """
    def letter(i: Column) -> Column:
        point = i + 255 + F.when(i + 255 >= 0xD800, 0x800).otherwise(0)
        wide = point - 0x10000
        return F.when(point < 0x10000, F.lpad(F.hex(point), 4, "0")).otherwise(F.concat(F.hex(F.shiftright(wide, 10) + 0xD800), F.hex(wide.bitwiseAND(0x3FF) + 0xDC00)))

    # The words are bound to a lambda's variable, which is computed once. Levenshtein counts characters, not surrogates.
    spell = lambda known, ws: F.decode(F.unhex(F.array_join(F.transform(ws, lambda w: letter(F.array_position(known, w))), "")), "UTF-16BE")
    return F.get(F.transform(F.array(F.array_distinct(F.concat(a, b))), lambda known: F.levenshtein(spell(known, a), spell(known, b))), F.lit(0))


def met_pairs(asked: DataFrame, shown: DataFrame) -> DataFrame:
    """(part, a, b): issue texts that share a key and whose lengths allow a link; keys shown by many are salted."""
    hot = shown.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SALT_ABOVE).select("key", F.lit(SALTS).alias("_hot"))
    s = shown.join(hot, "key", "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("issue"), F.lit(SALTS))).otherwise(0).cast("int"))
    q = asked.join(hot, "key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_hot", F.lit(1)) - 1)))
    s, q = s.select("key", "_salt", F.col("issue").alias("b"), F.col("n").alias("nb")), q.select("part", "key", "_salt", F.col("issue").alias("a"), F.col("n").alias("na"))
    near = F.abs(F.col("na") - F.col("nb")) <= edits(F.greatest("na", "nb"))
    return q.join(s, ["key", "_salt"]).where((F.col("a") != F.col("b")) & near).select("part", "a", "b").distinct()


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, a, b, wa, wb, longer, bits): pairs with their words and which fields agree, as bits in the order of ``FIELDS``."""
    side = lambda k: texts.select(F.col("issue").alias(k), F.struct(word_list(F.col("words")).alias("w"), "path", "message", "severity", "line").alias(f"t{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("longer", F.greatest(F.size("ta.w"), F.size("tb.w")))
    k = edits(F.col("longer"))
    agree = [
        (F.size(F.array_except("ta.w", "tb.w")) <= k) & (F.size(F.array_except("tb.w", "ta.w")) <= k),
        F.col("ta.path") == F.col("tb.path"), F.col("ta.message") == F.col("tb.message"), F.col("ta.severity").eqNullSafe(F.col("tb.severity")),
        F.coalesce(F.abs(F.col("ta.line") - F.col("tb.line")) <= 20, F.lit(False)),
    ]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(agree)), F.lit(0))
    return both.select("part", "a", "b", F.col("ta.w").alias("wa"), F.col("tb.w").alias("wb"), "longer", bits.cast("int").alias("bits"))


def learn_weights(patterns: list[tuple[tuple[bool, ...], int]], rounds: int = 30) -> dict[str, tuple[float, float]]:
    """Fellegi-Sunter weights (agree, disagree) per field, by EM over counted comparison patterns (at most 2**fields)."""
    k = len(FIELDS)
    m, u, p = [0.9] * k, [0.2] * k, 0.5
    for _ in range(rounds):
        s, su, gm, gu = 0.0, 0.0, [0.0] * k, [0.0] * k
        for bits, n in patterns:
            lm = p * math.prod(m[i] if b else 1 - m[i] for i, b in enumerate(bits))
            lu = (1 - p) * math.prod(u[i] if b else 1 - u[i] for i, b in enumerate(bits))
            g = lm / (lm + lu) if lm + lu else 0.5
            s, su = s + n * g, su + n * (1 - g)
            for i, b in enumerate(bits):
                gm[i] += n * g * b
                gu[i] += n * (1 - g) * b
        total = s + su
        if not total:
            break
        p = min(max(s / total, 1e-4), 1 - 1e-4)
        m = [min(max(x / s if s else 0.5, 1e-4), 1 - 1e-4) for x in gm]
        u = [min(max(x / su if su else 0.5, 1e-4), 1 - 1e-4) for x in gu]
    return {f: (math.log2(m[i] / u[i]), math.log2((1 - m[i]) / (1 - u[i]))) for i, f in enumerate(FIELDS)}


def score_of(bits: int, weights: dict[str, tuple[float, float]]) -> float:
    return sum(weights[f][0 if bits >> i & 1 else 1] for i, f in enumerate(FIELDS))


def least_score(weights: dict[str, tuple[float, float]]) -> float:
    """The least score of a pair within the allowed edits: such a pair agrees in its common words, the other fields may do as they like."""
    return weights["common"][0] + sum(min(weights[f]) for f in FIELDS[1:])


def link_batch(history: History, batch: DataFrame) -> DataFrame:
    """(finding_id, scan_id, issue, first_earlier_scan) of the batch's rows; the history has the batch afterwards.

    The batch may hold several scans; repeats among them count in the order of scan_id, and batches may
    come in any cut as long as later batches have greater scan_ids per target. An issue text is known by the least
    finding_id of the batch that brought it.
    """
    rows = issue_texts(batch)
    parts = sorted(r[0] for r in rows.select("part").distinct().collect()) if history.batches else []  # at most PARTS numbers
    fields = F.struct("finding_id", "words", "part", "blk", "path", "message", "severity", "line")
    delivered = rows.groupBy("p1", "p2").agg(F.min("scan_id").alias("first_scan"), F.min_by(fields, F.struct("scan_id", "finding_id")).alias("f"), F.min("finding_id").alias("issue"))
    known = history.read("reps", parts).select("p1", "p2", F.col("issue").alias("old_issue"), F.col("first_scan").alias("old_first"))
    new = delivered.join(known, ["p1", "p2"], "left_anti").select("issue", "p1", "p2", "first_scan", "f.part", "f.blk", "f.words", F.coalesce(F.size(word_list(F.col("f.words"))), F.lit(0)).alias("n"), "f.path", "f.message", "f.severity", "f.line")
    fresh = history.append("reps", new)

    held = history.read("order").first()
    order = bytes(held["counters"]) if held else learn_order(fresh)
    history.append("order", history.spark.createDataFrame([] if held else [(bytearray(order),)], SCHEMAS["order"]).coalesce(1))

    # Texts new to the history are the only ones that probe it.
    keys = history.append("keys", blocking_keys(fresh, order))
    texts = history.read("reps", parts).unionByName(fresh)
    # Of two new texts the one with the greater issue asks; an old one is only asked.
    both = met_pairs(keys, history.read("keys", parts).withColumn("_old", F.lit(True)).unionByName(keys.withColumn("_old", F.lit(False))))
    pairs = cut(compared(both, texts), "compared")
    seen = {r["bits"]: r["n"] for r in pairs.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 32 rows
    history.append("patterns", history.spark.createDataFrame(list(seen.items()), SCHEMAS["patterns"]).coalesce(1))
    for r in history.read("patterns").collect():
        seen[r["bits"]] = seen.get(r["bits"], 0) + r["n"]
    weights = learn_weights([(tuple(bool(b >> i & 1) for i in range(len(FIELDS))), n) for b, n in sorted(seen.items())])
    least = least_score(weights) - 1e-9
    scores = {b: score_of(b, weights) for b in range(1 << len(FIELDS))}
    hopeful = pairs.where(F.col("bits").isin([b for b, x in scores.items() if x >= least]))
    close = hopeful.withColumn("distance", word_distance(F.col("wa"), F.col("wb"))).where(F.col("distance") * PER_EDIT <= F.col("longer"))
    score = F.element_at(F.array(*[F.lit(round(scores[b], 6)) for b in range(1 << len(FIELDS))]), F.col("bits") + 1)
    history.append("links", close.select("part", "a", "b", "distance", "longer", score.alias("score")))
    history.batches += 1
    return marks(batch, history, parts if history.batches > 1 else None)


def marks(findings: DataFrame, history: History, parts: list[int] | None = None) -> DataFrame:
    """(finding_id, scan_id, issue, first_earlier_scan) of delivered findings, from the history that has them.

    Only the links of a text's own first batch, where it asked, can hold its first repeat by a near one: later on a text
    repeats itself. Links of two texts new in one batch stand there both ways.
    """
    texts = history.read("reps", parts)
    near = history.read("links", parts).join(texts.select(F.col("issue").alias("b"), "first_scan"), "b").groupBy("a").agg(F.min("first_scan").alias("near_first"))
    firsts = texts.join(near, texts["issue"] == near["a"], "left").select("p1", "p2", "issue", F.least("first_scan", "near_first").alias("first_earlier_scan"))
    return issue_texts(findings).select("finding_id", "scan_id", "p1", "p2").join(firsts, ["p1", "p2"]).select("finding_id", "scan_id", "issue", "first_earlier_scan")


def latest_clusters(history: History) -> DataFrame:
    """(issue, cluster) of the issue texts that were ever relabelled; the others are clusters of their own."""
    return history.read("clusters").groupBy("issue").agg(F.max_by("cluster", "batch_no").alias("cluster"))


def update_clusters(history: History) -> None:
    """After a batch: union-find over representatives. Only clusters that its links join are relabelled, by new rows."""
    history.batches -= 1
    now = latest_clusters(history)
    links = history.spark.read.schema(SCHEMAS["links"]).parquet(os.path.join(history.folder, "links", f"batch={history.batches}"))
    of = lambda k: now.select(F.col("issue").alias(k), F.col("cluster").alias(f"c{k}"))
    rooted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = cut(rooted.where("a <> b").distinct(), "cluster-edges")
    roots = components(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges).withColumnRenamed("group", "root")
    changed = roots.where("id <> root")
    members = now.join(changed, now["cluster"] == changed["id"]).select("issue", "root")
    history.append("clusters", members.unionByName(changed.select(F.col("id").alias("issue"), "root")).groupBy("issue").agg(F.min("root").alias("cluster")).withColumn("batch_no", F.lit(history.batches)))
    history.batches += 1


def cuts(findings: DataFrame, batches: int) -> list[Column]:
    """Conditions that cut the scans, in the order of scan_id, into batches of about as many findings each."""
    bounds = findings.agg(F.percentile_approx("scan_id", [k / batches for k in range(1, batches)])).first()[0] or []
    edges = [None, *sorted(set(bounds)), None]
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col("scan_id") > lo) & (F.lit(True) if hi is None else F.col("scan_id") <= hi)
    return [inside(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]


def deliver(findings: DataFrame, batches: int = BATCHES, clusters: bool = False, folder: str | None = None) -> History:
    """All scans delivered in batches through a persisted history."""
    history = History(findings.sparkSession, folder or new_folder(findings.sparkSession, "history"))
    for inside in cuts(findings, batches):
        link_batch(history, findings.where(inside))
        if clusters:
            update_clusters(history)
    return history


def repeats(findings: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(finding_id, scan_id): findings that some smaller scan_id of the target already delivered, exactly or nearly."""
    marked = marks(findings, deliver(findings, batches))
    return marked.where(F.col("first_earlier_scan") < F.col("scan_id")).select("finding_id", "scan_id").distinct()


def clustered(findings: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(finding_id, issue, cluster) of every finding; a cluster is known by its least issue."""
    history = deliver(findings, batches, clusters=True)
    return marks(findings, history).select("finding_id", "issue").distinct().join(latest_clusters(history), "issue", "left").select("finding_id", "issue", F.coalesce("cluster", "issue").alias("cluster"))


def scored_links(findings: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(a, b, distance, longer, score): links between issue texts, a < b, with the score they had when they were found."""
    history = deliver(findings, batches)
    ends = history.read("links").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", "longer", "score")
    return ends.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.min("longer").alias("longer"), F.max("score").alias("score"))
