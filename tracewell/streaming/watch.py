"""Watches as streams: what is new since the last look.

A watch is a ``foreachBatch`` over delivered snapshots with its state in a table of the shared folder: each batch joins the new rows
with the state by key, emits the differences and writes the next state as a new version. A batch that is run again finds the version
it wrote and gives the same result, so output is written once. The first sight of a key is its baseline and emits nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Differ = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


class VersionedState:
    """A state table by batch number."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def path(self, batch: int) -> str:
        return os.path.join(self.folder, f"v{batch:010d}")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def before(self, batch: int) -> DataFrame:
        """The state that the batches before this one left."""
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        done = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(root) else []
        past = [b for b in done if b < batch]
        return self.spark.read.schema(self.schema).parquet(self.path(past[-1])) if past else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.path(batch))


def watch(stream: DataFrame, differ: Differ, state: VersionedState, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a watch; events are written under ``out`` by batch, so a repeated batch overwrites itself."""

    def each(rows: DataFrame, batch: int) -> None:
        events, after = differ(state.before(batch), rows)
        events.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch}"))
        state.write(after, batch)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def latest(rows: DataFrame, key: list[str], ts: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*dict.fromkeys([ts, *rest]))).alias("_r")).select(*key, *[f"_r.{c}" for c in rest])


def head_changes(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repositories (repo, head, ts) whose head moved since the last look."""
    now = latest(rows, ["repo"], "ts")
    old = state.select("repo", F.col("head").alias("old"))
    events = now.join(old, "repo").where("head <> old").select("repo", "old", "head", "ts")
    return events, state.join(now.select("repo"), "repo", "left_anti").unionByName(now)


def new_findings(mode: str = "replace") -> Differ:
    """Fingerprints (repo, fp) not known before; the known set is replaced by each look or united with it."""

    def differ(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        now = rows.select("repo", "fp").distinct()
        seen = state.select("repo").distinct()
        events = now.join(state, ["repo", "fp"], "left_anti").join(seen, "repo", "left_semi")
        if mode == "replace":
            return events, state.join(now.select("repo").distinct(), "repo", "left_anti").unionByName(now)
        return events, state.unionByName(now).distinct()

    return differ


def dep_changes(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies (repo, ecosystem, name, version) added, removed or changed; a repository's first set is silent."""
    now, key = rows.select("repo", "ecosystem", "name", "version").distinct(), ["repo", "ecosystem", "name"]
    looked = now.select("repo").distinct()
    old = state.join(looked, "repo", "left_semi")
    both = now.join(old.withColumnRenamed("version", "old"), key, "full_outer").join(state.select("repo").distinct(), "repo", "left_semi")
    change = F.when(F.col("old").isNull(), "DEPD-001").when(F.col("version").isNull(), "DEPD-002").when(F.col("old") != F.col("version"), "DEPD-003")
    events = both.withColumn("id", change).where("id IS NOT NULL").select(*key, "old", "version", "id")
    return events, state.join(looked, "repo", "left_anti").unionByName(now)


def list_changes(column: str, id: str) -> Differ:
    """What a key's list (key, items, ts) gained and lost; null lists are failed look-ups and change nothing."""

    def differ(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        now = latest(rows.where(F.col(column).isNotNull()).select("key", column, "ts"), ["key"], "ts")
        both = now.join(state.select("key", F.col(column).alias("old")), "key")
        diff = both.select("key", F.array_except(column, "old").alias("gained"), F.array_except("old", column).alias("lost"), F.lit(id).alias("id"))
        return diff.where("size(gained) + size(lost) > 0"), state.join(now.select("key"), "key", "left_anti").unionByName(now)

    return differ


def chain_breaks(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pushes (repo, ref, before, head, ts) that do not follow the last head; the heads outlive the batches."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("repo", "ref").orderBy("ts", "head")
    steps = rows.where("head IS NOT NULL AND head <> ''").withColumn("prev", F.lag("head").over(w)).join(state.select("repo", "ref", F.col("head").alias("kept")), ["repo", "ref"], "left").withColumn("expected", F.coalesce("prev", "kept"))
    events = steps.where(F.col("expected").isNotNull() & ~F.col("before").eqNullSafe(F.col("expected"))).select("repo", "ref", "before", "expected", "head", "ts")
    now = latest(rows.where("head IS NOT NULL AND head <> ''").select("repo", "ref", "head", "ts"), ["repo", "ref"], "ts")
    return events, state.join(now.select("repo", "ref"), ["repo", "ref"], "left_anti").unionByName(now)


def seen_once(key: str) -> Differ:
    """Rows whose key was never seen: lists of exploited advisories, code-search hits, feed entries."""

    def differ(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        now = rows.select(key).distinct()
        fresh = now.join(state, key, "left_anti")
        silent = state.limit(1).count() == 0
        return (fresh.limit(0) if silent else fresh), state.unionByName(fresh)

    return differ


def unchanged(files: DataFrame, cache: DataFrame, rules_fp: str) -> tuple[DataFrame, DataFrame]:
    """(to scan, cached): files (root, path, mtime, size) against a cache of the same rules; vanished ones drop out."""
    key = ["root", "path", "mtime", "size"]
    valid = cache.where(F.col("rules_fp") == rules_fp)
    return files.join(valid.select(*key), key, "left_anti"), valid.join(files.select(*key), key, "left_semi")


def windowed_counts(stream: DataFrame, ts: str, kind: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: counts in tumbling or sliding windows with a watermark."""
    window: Column = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def live_lookalikes(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look-alike names (name, candidate, addrs ARRAY) that did not answer before and do now: DWATCH-010; the first look is silent."""
    live = rows.where("size(addrs) > 0").select("name", "candidate").distinct()
    looked = state.select("name").distinct()
    events = live.join(state.where("candidate IS NOT NULL"), ["name", "candidate"], "left_anti").join(looked, "name", "left_semi").withColumn("id", F.lit("DWATCH-010"))
    return events, state.unionByName(live).unionByName(rows.select("name", F.lit(None).cast("string").alias("candidate"))).distinct()


# What a change of an agent's file is called by its path (id, severity, pattern).
TRIPWIRES = [
    ("AW-001", "high", r"(?i)(?:^|/)hooks?(?:\.json|/)|settings[^/]*\.json$"), ("AW-002", "high", r"(?i)(?:^|/)\.?mcp[^/]*\.json$"), ("AW-003", "medium", r"(?i)(?:^|/)(?:skills?|plugins?)/"), ("AW-004", "medium", r"(?i)(?:^|/)(?:AGENTS|CLAUDE|GEMINI|SKILL|RULES)\.md$|\.cursorrules$"),
    ("AW-005", "medium", r"(?i)(?:^|/)commands?/"), ("AW-006", "medium", r"(?i)\.(?:sh|py|js|ts|ps1)$"), ("AW-008", "medium", r"(?i)(?:^|/)permissions?"),
]


def tripwire(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agent files (root, path, sha256) added, removed or changed since the last look: (root, path, change, id, severity); a root's first look is silent.

    A row without a digest could not be read: it is AW-011 and leaves the state as it was.
    """
    now = rows.groupBy("root", "path").agg(F.max("sha256").alias("sha256"))
    known = state.select("root").distinct()
    both = now.join(state.withColumnRenamed("sha256", "old"), ["root", "path"], "full_outer").join(rows.select("root").distinct(), "root", "left_semi").join(known, "root", "left_semi")
    seen = both.join(now.select("root", "path", F.lit(True).alias("_here")), ["root", "path"], "left")
    change = F.when(F.col("_here").isNull(), "removed").when(F.col("sha256").isNull(), "unreadable").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("sha256"), "changed")
    id, severity = F.lit("AW-010"), F.lit("info")
    for i, s, rx in reversed(TRIPWIRES):
        id, severity = F.when(F.col("path").rlike(rx), i).otherwise(id), F.when(F.col("path").rlike(rx), s).otherwise(severity)
    plain = F.when(F.col("change") == "unreadable", "AW-011").when(F.col("change") == "removed", "AW-009").otherwise(id)
    events = seen.withColumn("change", change).where("change IS NOT NULL").select("root", "path", "change", plain.alias("id"), F.when(F.col("change").isin("removed", "unreadable"), "low").otherwise(severity).alias("severity"))
    kept = now.join(state.withColumnRenamed("sha256", "old"), ["root", "path"], "left").select("root", "path", F.coalesce("sha256", "old").alias("sha256"))
    return events, state.join(rows.select("root").distinct(), "root", "left_anti").unionByName(kept)


def posture_once(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Warnings (domain, id, value) that were not given before with this value: an expiry is warned of once a date."""
    now = rows.select("domain", "id", "value").distinct()
    fresh = now.join(state, ["domain", "id", "value"], "left_anti")
    return fresh, state.unionByName(fresh)


def index_files(state: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to fingerprint, kept, vanished): files (root, path, mtime, size) against a similarity index with the same columns and its fingerprints."""
    key = ["root", "path", "mtime", "size"]
    kept = state.join(files.select(*key).distinct(), key, "left_semi")
    vanished = state.join(files.select("root").distinct(), "root", "left_semi").join(files.select("root", "path").distinct(), ["root", "path"], "left_anti")
    return files.join(state.select(*key), key, "left_anti"), kept, vanished


def hourly_events(spark: SparkSession, folder: str, needle: str, schema: str) -> DataFrame:
    """A stream of the events in compressed hour files (JSON lines) whose line holds the needle in any case; lines are parsed behind that test."""
    lines = spark.readStream.text(folder)
    return lines.where(F.contains(F.lower("value"), F.lit(needle.lower()))).select(F.from_json("value", schema).alias("e")).where("e IS NOT NULL").select("e.*")


def union_of_scans(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of pushed repositories (repo, fp): all that were ever found are known; new ones come out, a first scan's as well."""
    now = rows.select("repo", "fp").distinct()
    return now.join(state, ["repo", "fp"], "left_anti"), state.unionByName(now).distinct()
