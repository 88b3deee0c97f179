"""Typed changes between consecutive full snapshots.

Snapshots are range-partitioned and sorted by (owner, key, snapshot, delivery): one exchange, of the delivered rows
themselves, after which every range is merged on its own. In that order the deliveries of one key and snapshot are
neighbours, and then the rows of neighbouring snapshots; two streaming passes (``lead`` picks the last delivery, ``lag`` and
``lead`` are the two pointers of the merge) see which keys were added, removed or changed, without another exchange
or sort. The exchange is by owner *and* key: an owner that holds a third of all rows is spread over many
ranges, and one key has at most its deliveries per snapshot. Only rows that may be changes meet the calendar of their owner's
snapshots: those whose neighbours are not snapshots of the same key one number before and after, with the same content.

``keep_ranged`` writes snapshots in that layout, and ``merge_ranged`` merges a stored one with the next range by range.

Defined results: duplicate deliveries of (owner, key, snapshot) count once, the
row loaded last wins (ties: the greater content); a null content never gives
'changed'; a null owner or key is dropped; the first snapshot of an owner reports
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_delivery(df: DataFrame, keys: Sequence[str], loaded: str, values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the delivery loaded last (partial aggregation, no window)."""
    best = F.max_by(F.struct(*values), F.struct(F.coalesce(F.col(loaded), F.timestamp_seconds(F.lit(0))), F.to_json(F.struct(*values))))
    return df.groupBy(*keys).agg(best.alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def newest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows delivered twice the one that is last by ``order`` (nulls first)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def ranged(rows: DataFrame, compared: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows (owner, rec, snap_no, loaded_at, *compared) in ranges of (owner, rec), each sorted, the last delivery of each key and snapshot."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("owner"), F.col("rec"), F.col("snap_no"), F.asc_nulls_first("loaded_at"), *[F.asc_nulls_first(c) for c in compared]]
    laid = rows.repartitionByRange(n, "owner", "rec").sortWithinPartitions(*order)
    w = Window.partitionBy("owner", "rec").orderBy(*order[2:])
    return laid.withColumn("_next", F.lead("snap_no").over(w)).where(~F.col("_next").eqNullSafe(F.col("snap_no"))).drop("_next")


def diff_snapshots(
    rows: DataFrame,
    compared: Sequence[str],
    calendar: DataFrame | None = None,
    consecutive: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Changes of ``rows`` (owner, rec, snap_no, loaded_at, *compared), delivered in any order and number.

    Returns (owner, rec, snap_no, column, change): 'added' and 'removed' with a null
    column, 'changed' once per compared column whose values differ, both not null.
    ``calendar`` (owner, snap_no) lists the snapshots; by default those seen in rows.
    A calendar of the owner '*' holds for every owner. ``consecutive`` compares with snap_no - 1 only.
    """
    w = Window.partitionBy("owner", "rec").orderBy("snap_no")
    seen = ranged(rows, compared, partitions).withColumns({"_before": F.lag("snap_no").over(w), "_after": F.lead("snap_no").over(w), **{f"_was_{c}": F.lag(c).over(w) for c in compared}})
    differ = F.filter(F.array(*[F.when(F.col(c) != F.col(f"_was_{c}"), F.lit(c)) for c in compared]), lambda x: x.isNotNull())
    # Neighbours by number are neighbours in every calendar: such rows of unchanged content need none.
    steady = (F.size("_differ") == 0) & F.col("_before").eqNullSafe(F.col("snap_no") - 1) & F.col("_after").eqNullSafe(F.col("snap_no") + 1)
    maybe = seen.withColumn("_differ", differ).where(~steady).select("owner", "rec", "snap_no", "_before", "_after", "_differ")

    # One row per owner: its snapshots in order. There are as many as were ever delivered.
    everyone = calendar is not None
    cal = (calendar if everyone else rows.select("owner", "snap_no")).groupBy("owner").agg(F.array_sort(F.collect_set("snap_no")).alias("_cal"))
    met = maybe.withColumn("_all", F.lit("*")).join(F.broadcast(cal.withColumnRenamed("owner", "_all")), "_all") if everyone else maybe.join(cal, "owner")  # a calendar for all is one row
    at = F.array_position("_cal", F.col("snap_no")).cast("int")
    known = met.withColumns({"_prev": F.get("_cal", at - 2), "_next": F.get("_cal", at)})
    prev, nxt = F.col("_prev"), F.col("_next")
    if consecutive:
        prev, nxt = F.when(prev == F.col("snap_no") - 1, prev), F.when(nxt == F.col("snap_no") + 1, nxt)
    event = lambda cond, snap, column, change: F.when(cond, F.struct(snap.cast("bigint").alias("at"), column.alias("column"), F.lit(change).alias("change")))
    null_s, follows = F.lit(None).cast("string"), prev.isNotNull() & F.col("_before").eqNullSafe(prev)
    events = F.concat(
        F.array(event(prev.isNotNull() & ~F.col("_before").eqNullSafe(prev), F.col("snap_no"), null_s, "added"), event(nxt.isNotNull() & ~F.col("_after").eqNullSafe(nxt), nxt, null_s, "removed")),
        F.transform("_differ", lambda c: event(follows, F.col("snap_no"), c, "changed")),
    )
    out = known.select("owner", "rec", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("_e"))
    return out.select("owner", "rec", F.col("_e.at").alias("snap_no"), F.col("_e.column").alias("column"), F.col("_e.change").alias("change"))


def keep_ranged(rows: DataFrame, compared: Sequence[str], folder: str, bounds: Sequence[tuple[str, str]] | None = None, partitions: int = 64) -> list[tuple[str, str]]:
    """Write one snapshot's rows in ranges of (owner, rec), sorted, one folder a range (``range=k``); returns the upper bounds of the ranges.

    The first snapshot sets the bounds (as many as partitions, from approximate quantiles of a hash-free sample of keys: the
    bound of the sample is Spark's own for range partitioning); later ones are given them, so that ranges correspond.
    """
    last = latest_delivery(rows, ["owner", "rec", "snap_no"], "loaded_at", list(compared))
    if bounds is None:
        laid = last.repartitionByRange(partitions, "owner", "rec").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("owner", "rec")).alias("top")).orderBy("p").collect()  # one row a range
        bounds = [(r["top"]["owner"], r["top"]["rec"]) for r in laid][:-1]
    tops = F.array(*[F.struct(F.lit(a).alias("owner"), F.lit(b).alias("rec")) for a, b in bounds]) if bounds else None
    place = F.size(F.filter(tops, lambda t: t < F.struct("owner", "rec"))) if bounds else F.lit(0)
    ranged_rows = last.withColumn("range", place).repartition(max(1, len(bounds) + 1), "range").sortWithinPartitions("range", "owner", "rec")
    ranged_rows.write.mode("overwrite").partitionBy("range").parquet(folder)
    return list(bounds)


def merge_ranged(spark, before: str, after: str, compared: Sequence[str]) -> DataFrame:
    """(owner, rec, column, change) between two stored snapshots: each range is merged by two pointers over its sorted rows.

    A range is a task of its own; it reads both sides in batches and holds one row of each.
    """
    from collections.abc import Iterator

    import pandas as pd

    names = list(compared)
    side = lambda folder, s: spark.read.parquet(folder).select("range", "owner", "rec", F.struct(*names).alias("v"), F.lit(s).alias("s"))
    both = side(before, 0).unionByName(side(after, 1)).repartition("range").sortWithinPartitions("range", "owner", "rec", "s")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            out = []
            for o, r, v, s in zip(b["owner"], b["rec"], b["v"], b["s"], strict=True):
                if held and s and held[:2] == (o, r):
                    out += [(o, r, n, "changed") for n in names if v[n] is not None and held[2][n] is not None and v[n] != held[2][n]]
                    held = None
                    continue
                if held:
                    out.append((held[0], held[1], None, "removed"))
                    held = None
                if s:
                    out.append((o, r, None, "added"))
                else:
                    held = (o, r, v)
            yield pd.DataFrame(out, columns=["owner", "rec", "column", "change"])
        if held:
            yield pd.DataFrame([(held[0], held[1], None, "removed")], columns=["owner", "rec", "column", "change"])

    return both.select("owner", "rec", "v", "s").mapInPandas(merge, "owner string, rec string, column string, change string")


def dns_name(c: Column) -> Column:
    """Lower case, without outer blanks and without a final dot."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")


def dns_set(c: Column, preference: bool = False) -> Column:
    """A list of DNS names as a sorted set in one string; null stays null, blanks and nulls in it vanish."""
    names = F.transform(c, lambda x: dns_name(F.regexp_replace(x, r"\s+", " ") if preference else x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))), "\n")


def plain_path(c: Column) -> Column:
    """'/' for separators, no leading './' (repeated or not)."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./+)+", "")


def hex_number(c: Column) -> Column:
    """A hexadecimal digest as a number's canonical text."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^0x", ""), r"^0+(?=.)", "")


def packed_number(c: Column) -> Column:
    """A hexadecimal digest as a number, in half the bytes; what is no hexadecimal number stays its text, behind a zero byte that no number begins with."""
    text = hex_number(c)
    return F.coalesce(F.unhex(text), F.encode(F.concat(F.lit("\x00"), text), "UTF-8"))


def domain_changes(domain_snaps: DataFrame) -> DataFrame:
    """Records and their certs, ns and mx sets that changed between snapshots snap_no-1 and snap_no."""
    named = domain_snaps.where(F.col("domain_name").isNotNull() & F.col("snap_no").isNotNull()).select(
        dns_name(F.col("domain_name")).alias("owner"), F.col("snap_no").cast("bigint").alias("snap_no"), "loaded_at",
        dns_set(F.col("certs")).alias("certs"), dns_set(F.col("ns")).alias("ns"), dns_set(F.col("mx"), True).alias("mx"),
    )
    calendar = named.select(F.lit("*").alias("owner"), "snap_no")
    out = diff_snapshots(named.withColumn("rec", F.lit("")), ["certs", "ns", "mx"], calendar=calendar, consecutive=True)
    return out.select(F.lit("domain").alias("kind"), "owner", F.coalesce("column", F.lit("record")).alias("rec_key"), "snap_no", "change")


def file_changes(file_sigs: DataFrame) -> DataFrame:
    """Files added, removed or changed between a root's snapshot and the previous one that this root has."""
    named = file_sigs.where(F.col("root").isNotNull() & F.col("path").isNotNull() & F.col("snap_no").isNotNull()).select(
        F.col("root").alias("owner"), plain_path(F.col("path")).alias("rec"), F.col("snap_no").cast("bigint").alias("snap_no"), "loaded_at",
        packed_number(F.col("sha256")).alias("sha256"),
    )
    out = diff_snapshots(named, ["sha256"])
    return out.select(F.lit("file").alias("kind"), "owner", F.col("rec").alias("rec_key"), "snap_no", "change")
