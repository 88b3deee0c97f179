"""Findings after the scan: order, threshold, summaries, fingerprints, ignore lists, VEX, baselines, trends.

Anti-joins against rule lists are on keys where they can be and broadcast only by Spark's own size check otherwise.
Defined results: a null excerpt or line is a value of its own in every fingerprint; an empty table gives an empty result
(summaries: one row of zeros); severities compare without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import text as X
from tracewell.functions.codecs import fnv1a_hex
from tracewell.rules.model import SEVERITIES


#: Patterns of an ignore file that hold for every rule, at most.
MOST_PATTERNS = 10_000


def rank_of(severity: Column) -> Column:
    """0 (info) to 4 (critical) in any case; null for other words."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(F.trim(severity))).cast("int"), F.lit(0)) - 1


def once(findings: DataFrame) -> DataFrame:
    """Rows delivered twice once, the one recorded last."""
    w = Window.partitionBy("finding_id").orderBy(F.desc_nulls_last("recorded_at"))
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def in_report_order(findings: DataFrame, least: str = "info") -> DataFrame:
    """Severity downwards, then path, line (none first), target, rule, excerpt, message."""
    kept = findings.where(rank_of(F.col("severity")) >= SEVERITIES.index(least))
    return kept.orderBy(rank_of(F.col("severity")).desc(), "path", F.asc_nulls_first("line"), "target", "rule_id", F.asc_nulls_first("excerpt"), "message")


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings per severity, total, worst rank (-1 if none)."""
    r = rank_of(F.col("severity"))
    return findings.agg(*[F.count_if(r == i).alias(s) for i, s in enumerate(SEVERITIES)], F.count(F.lit(1)).alias("total"), F.coalesce(F.max(r), F.lit(-1)).alias("worst"))


def by_target(findings: DataFrame) -> DataFrame:
    r = rank_of(F.col("severity"))
    return findings.groupBy("target").agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("findings"), F.max(r).alias("worst"))


def base_fingerprint() -> Column:
    """Identity of a finding by rule, path and excerpt: 16 digits."""
    return F.left(F.sha2(F.concat_ws("|", "rule_id", X.plain_path(F.col("path")), F.coalesce("excerpt", F.lit(""))), 256), F.lit(16))


def content_fingerprint() -> Column:
    """Identity that survives a move of the file: rule and excerpt."""
    return F.left(F.sha2(F.concat_ws("|", "rule_id", F.coalesce("excerpt", F.lit(""))), 256), F.lit(16))


def portable_fingerprint() -> Column:
    """The identity that baselines of other tools hold: FNV-1a over rule, path and trimmed excerpt, 16 digits."""
    return fnv1a_hex(F.concat_ws("|", "rule_id", F.coalesce("path", F.lit("")), F.regexp_replace(F.coalesce("excerpt", F.lit("")), r"^\s+|\s+$", "")))


def portable_content_fingerprint() -> Column:
    """The identity of those baselines that survives a move: SHA-256 over rule, trimmed excerpt and severity."""
    return F.sha2(F.concat_ws("|", "rule_id", F.regexp_replace(F.coalesce("excerpt", F.lit("")), r"^\s+|\s+$", ""), F.lower("severity")), 256)


def trend_fingerprint() -> Column:
    """Identity of a finding in a trend: rule, path, line, excerpt and severity."""
    parts = ["rule_id", X.plain_path(F.col("path")), F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce("excerpt", F.lit("")), F.lower("severity")]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def apply_ignore(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Findings without those a pattern (rule_id or '*', path_re or null) takes out; rule ids in any case.

    Patterns of a rule meet its findings in an equi-join; those of every rule are one expression, as an ignore file is written by hand:
    more than ``MOST_PATTERNS`` of them are refused.
    """
    named = patterns.select(F.upper("rule_id").alias("rule"), "path_re").distinct()
    every = [r[0] for r in named.where("rule = '*'").select("path_re").limit(MOST_PATTERNS + 1).collect()]
    if len(every) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns for every rule")
    kept = findings
    if None in every:
        kept = kept.where("false")
    elif every:
        kept = kept.where(~F.coalesce(F.col("path").rlike("|".join(f"(?:{x})" for x in sorted(every))), F.lit(False)))
    hit = (F.upper("f.rule_id") == F.col("p.rule")) & (F.col("p.path_re").isNull() | F.expr("rlike(f.path, p.path_re)"))
    return kept.alias("f").join(named.where("rule <> '*'").alias("p"), hit, "left_anti")


def ignore_patterns(spark, lines: list[str]) -> DataFrame:
    """Lines 'RULE [glob]', '#' for remarks."""
    rows = []
    for raw in lines:
        line = raw.split("#", 1)[0].strip()
        if line:
            rule, _, glob = line.partition(" ")
            rows.append((rule, X.glob_regex(glob.strip()) if glob.strip() else None))
    return spark.createDataFrame(rows, "rule_id string, path_re string")


def apply_vex(findings: DataFrame, statements: DataFrame) -> DataFrame:
    """Findings with the status of the first statement (idx) about them: by rule id, in the message, or as the excerpt.

    The rule-id match is an equi-join; only statements whose id stands in a message need the theta join, which is keyed by
    the ids that the message holds.
    """
    ids = F.array_distinct(F.concat(F.array("rule_id"), F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9._:-]*[A-Za-z0-9]"), F.lit(0)), F.filter(F.array("excerpt"), lambda x: x.isNotNull())))
    # What decides are the ids a finding holds: findings of equal rule, message and excerpt have one status, so those are the key.
    what = F.xxhash64("rule_id", "message", "excerpt")
    met = findings.select(what.alias("_k"), F.explode(ids).alias("vuln")).distinct().join(statements, "vuln").groupBy("_k").agg(F.min_by("status", "idx").alias("vex_status"))
    return findings.withColumn("_k", what).join(met, "_k", "left").drop("_k")


def partition_by_baseline(findings: DataFrame, baseline: DataFrame, now: Column | None = None, portable: bool = False) -> DataFrame:
    """Findings with ``known``: accepted by fp, else by fp_content; never if critical or if the entry has expired.

    ``portable`` baselines are those of other tools, with their identities.
    """
    live = baseline if now is None else baseline.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    fp = live.select("fp").where("fp IS NOT NULL").distinct().withColumn("_a", F.lit(True))
    fc = live.select("fp_content").where("fp_content IS NOT NULL").distinct().withColumn("_b", F.lit(True))
    joined = findings.withColumns({"fp": portable_fingerprint() if portable else base_fingerprint(), "fp_content": portable_content_fingerprint() if portable else content_fingerprint()}).join(fp, "fp", "left").join(fc, "fp_content", "left")
    known = (F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))) & (F.coalesce(rank_of(F.col("severity")), F.lit(0)) < 4)
    return joined.withColumn("known", known).drop("_a", "_b")


def latest_two(scans: DataFrame) -> DataFrame:
    """(root, scan_id, age): of each root the latest scan (age 1) and the one before (2), by time and id."""
    w = Window.partitionBy("root").orderBy(F.desc("ts"), F.desc("scan_id"))
    return scans.select("root", "scan_id", "ts").distinct().withColumn("age", F.row_number().over(w)).where("age <= 2").select("root", "scan_id", "age")


def trend(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """(root, new, fixed, persistent) between the two latest scans of each root that has two."""
    two = latest_two(scans)
    fps = findings.select("scan_id", trend_fingerprint().alias("fp")).join(two, "scan_id").groupBy("root", "fp").agg(F.max(F.col("age") == 1).alias("cur"), F.max(F.col("age") == 2).alias("prev"))
    counted = fps.groupBy("root").agg(F.count_if(F.col("cur") & ~F.col("prev")).alias("new"), F.count_if(~F.col("cur") & F.col("prev")).alias("fixed"), F.count_if(F.col("cur") & F.col("prev")).alias("persistent"))
    both = two.groupBy("root").count().where("count = 2").select("root")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.join(counted, "root", "left").select("root", zero("new"), zero("fixed"), zero("persistent"))


def digests(findings: DataFrame) -> DataFrame:
    """One row: digest over the sorted fingerprints, folded in 256 ranges so that no task holds them all, and counts."""
    part = findings.select(base_fingerprint().alias("fp")).distinct().groupBy(F.left("fp", F.lit(2)).alias("range")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fp")), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("fingerprints"))
