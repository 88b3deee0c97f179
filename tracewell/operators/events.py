"""Events: selection, kinds, facets, chains, bursts, gaps, sessions; rotation of tokens; provenance scores.

Windows are partitioned by an actor, a repository or a token, and ordered; those over whole tables first aggregate. Defined
results: events without a time are left out of ordered operators, ties are broken by id, empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of evidence tiers, the cap of the lowest tier, and the verdict bands.
TIERS = {"high": 40, "medium": 15, "low": 4}
LOW_CAP = 30
BANDS = ((70, "likely"), (40, "possible"), (15, "weak"))


def kind(c: Column) -> Column:
    """An event's kind in one spelling: 'push', 'PushEvent' and 'push_event' are 'pushevent'."""
    flat = F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    return F.when(flat.endswith("event"), flat).otherwise(F.concat(flat, F.lit("event")))


def select_events(events: DataFrame, selector: str, value: str) -> DataFrame:
    """Events of an org (owner of the repository, actor's org), a user (actor or owner) or a repository; any case."""
    v, owner = value.lower(), F.lower(F.substring_index("repo", "/", 1))
    cond = {"org": (owner == v) | (F.lower("org") == v), "user": (F.lower("actor") == v) | (owner == v), "repo": F.lower("repo") == v}[selector]
    return events.where(F.coalesce(cond, F.lit(False)))


def prefiltered_json(lines: DataFrame, needle: str, schema: str) -> DataFrame:
    """JSON lines parsed only where the needle stands in them in any case."""
    kept = lines.where(F.contains(F.lower("value"), F.lit(needle.lower())))
    return kept.select(F.from_json("value", schema).alias("e")).select("e.*")


def by_kind(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def chain_breaks(pushes: DataFrame) -> DataFrame:
    """Pushes whose ``before`` is not the head of the previous push on the same repository and ref."""
    w = Window.partitionBy("repo", "ref").orderBy("created", "event_id")
    prev = F.lag("head").over(w)
    return pushes.where("head IS NOT NULL AND head <> ''").withColumn("expected", prev).where(F.col("expected").isNotNull() & ~F.col("before").eqNullSafe(F.col("expected")))


def burst(events: DataFrame, key: str, seconds: str, span: int = 86_400) -> DataFrame:
    """(key, most): most events of a key in any span that starts at one of its events, both ends included."""
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(0, span)
    return events.withColumn("_n", F.count(F.lit(1)).over(w)).groupBy(key).agg(F.max("_n").alias("most"))


def upper_median(values: Column) -> Column:
    """The upper middle of a sorted list; 0 if it is empty."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0))


def gap_medians(events: DataFrame, key: str, seconds: str) -> DataFrame:
    """(key, median_gap): upper median of the gaps between a key's events, by rank, so that no group is collected."""
    w = Window.partitionBy(key).orderBy(seconds, "event_id")
    gaps = events.withColumn("gap", F.col(seconds) - F.lag(seconds).over(w)).where("gap IS NOT NULL")
    n = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    r = Window.partitionBy(key).orderBy("gap", "event_id")
    return gaps.withColumn("r", F.row_number().over(r) - 1).join(n, key).where(F.col("r") == F.floor(F.col("n") / 2)).select(key, F.col("gap").alias("median_gap"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Extension: session windows that end after a gap."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rotation(lines: DataFrame, at_head: DataFrame | None = None) -> DataFrame:
    """(fp, state, ts, sha): Live, Removed or Reappeared of each token.

    ``lines`` (fp, ts, sha, sign) are added and removed lines; in one commit an addition wins over a removal. A token added again
    after an absence has reappeared (the last time counts); one at the head is live whatever its history says.
    """
    per = lines.groupBy("fp", "ts", "sha").agg(F.max(F.col("sign") == "+").alias("present"))
    w = Window.partitionBy("fp").orderBy("ts", "sha")
    steps = per.withColumn("was", F.lag("present").over(w))
    again = F.col("present") & ~F.coalesce("was", F.lit(True))
    out = steps.groupBy("fp").agg(
        F.max_by(F.struct("present", "ts", "sha"), F.struct("ts", "sha")).alias("last"),
        F.max_by(F.when(again, F.struct("ts", "sha")), F.when(again, F.struct("ts", "sha"))).alias("again"),
    )
    state = F.when(~F.col("last.present"), "Removed").when(F.col("again").isNotNull(), "Reappeared").otherwise("Live")
    pick = lambda f: F.when(F.col("last.present") & F.col("again").isNotNull(), F.col(f"again.{f}")).otherwise(F.col(f"last.{f}"))
    done = out.select("fp", state.alias("state"), pick("ts").alias("ts"), pick("sha").alias("sha"))
    if at_head is None:
        return done
    head = at_head.select("fp").distinct().withColumn("_h", F.lit(True))
    return done.join(head, "fp", "left").select("fp", F.when(F.col("_h") & (F.col("state") == "Removed"), "Live").otherwise(F.col("state")).alias("state"), "ts", "sha")


def provenance(evidence: DataFrame) -> DataFrame:
    """(subject, score, verdict) from evidence (subject, tier): weights summed, the low tier capped, the total at most 100."""
    low = F.least(F.sum(F.when(F.col("tier") == "low", TIERS["low"]).otherwise(0)), F.lit(LOW_CAP))
    rest = F.sum(F.when(F.col("tier") == "high", TIERS["high"]).when(F.col("tier") == "medium", TIERS["medium"]).otherwise(0))
    score = evidence.groupBy("subject").agg(F.least(low + rest, F.lit(100)).cast("int").alias("score"))
    verdict = F.lit("none")
    for least, word in reversed(BANDS):
        verdict = F.when(F.col("score") >= least, word).otherwise(verdict)
    return score.withColumn("verdict", verdict)


def in_windows(rows: DataFrame, ts: str, windows: DataFrame) -> DataFrame:
    """Rows within a compromise window (id, start, end; both ends included), keyed by day so that the join is an equi-join."""
    days = windows.select("id", "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_day"))
    return rows.withColumn("_day", F.to_date(ts)).join(days, "_day").where(F.col(ts).between(F.col("start"), F.col("end"))).drop("_day")


def first_seen(rows: DataFrame, key: str, value: str, ts: str, most: int | None = None) -> DataFrame:
    """(key, value, first, place): distinct values of each key in the order they were first seen; of a report at most ``most`` a key."""
    w = Window.partitionBy(key).orderBy("first", value)
    out = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(ts).alias("first")).withColumn("place", F.row_number().over(w))
    return out if most is None else out.where(F.col("place") <= most)


def after_cursor(events: DataFrame, cursors: DataFrame, key: str, id: str) -> DataFrame:
    """Events newer than the cursor (key, cursor) of their key; a key without one is looked at for the first time and gives none."""
    return events.join(cursors.select(key, F.col("cursor").alias("_c")), key).where(F.col(id) > F.col("_c")).drop("_c")


def capped(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """A report's rows, at most ``most`` a key in an order, with whether more were left out of it."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"_r": F.row_number().over(w), "truncated": F.count(F.lit(1)).over(Window.partitionBy(key)) > most}).where(F.col("_r") <= most).drop("_r")
