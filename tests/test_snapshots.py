from datetime import datetime

from pyspark.sql import functions as F

from tracewell.operators.snapshots import domain_changes, file_changes

T = [datetime(2025, 1, d) for d in range(1, 20)]
DOM = "snap_no int, domain_name string, certs array<string>, ns array<string>, mx array<string>, loaded_at timestamp, extra string"
SIG = "snap_no int, root string, path string, sha256 string, loaded_at timestamp, snap_count int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_domains_added_removed_changed(spark):
    df = spark.createDataFrame([
        (1, "A.test.", ["a.test", "B.test."], ["n1"], ["10 m.test"], T[0], None),
        (2, "a.test", [" b.test", "a.test", "a.test"], None, ["20 m.test."], T[1], None),
        (2, "a.test", ["late.test"], None, ["20 m.test"], T[5], "x"),  # loaded last
        (2, "new.test", [], [], [], T[1], None),
        (3, "new.test", [], [None, "n9"], [], None, None),
        (4, None, [], [], [], T[3], None),
    ], DOM)
    assert rows(domain_changes(df)) == [
        ("domain", "a.test", "certs", 2, "changed"), ("domain", "a.test", "mx", 2, "changed"), ("domain", "a.test", "record", 3, "removed"),
        ("domain", "new.test", "ns", 3, "changed"), ("domain", "new.test", "record", 2, "added"), 
    ]


def test_a_missing_snapshot_number_gives_no_pair(spark):
    df = spark.createDataFrame([(1, "a.test", ["x"], [], [], T[0], None), (3, "a.test", ["y"], [], [], T[0], None)], DOM)
    assert rows(domain_changes(df)) == []


def test_files_compare_with_the_roots_previous_snapshot(spark):
    df = spark.createDataFrame([
        (1, "r", "./a/b.md", "0A", T[0], 1), (3, "r", "a\\b.md", "a", T[0], 1), (4, "r", "a/b.md", None, T[0], 1), (6, "r", "a/b.md", "0b", T[0], 1), (7, "r", "a/b.md", "c", T[0], 1),
        (3, "r", "c", "1", T[0], 1), (1, "other", "z", "1", T[0], 1),
    ], SIG)
    assert rows(file_changes(df)) == [("file", "r", "a/b.md", 7, "changed"), ("file", "r", "c", 3, "added"), ("file", "r", "c", 4, "removed")]


def test_empty_tables(spark):
    assert rows(domain_changes(spark.createDataFrame([], DOM))) == []
    assert rows(file_changes(spark.createDataFrame([], SIG))) == []


def test_one_hot_root(spark):
    df = spark.range(2000).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("snap_no"), F.lit("hot").alias("root"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("ff").alias("sha256"), F.lit(T[0]).alias("loaded_at"))
    assert file_changes(df).count() == 0
    assert file_changes(df.where("NOT (snap_no = 2 AND path = 'p7')")).collect()[0]["change"] == "removed"


SIGS = [
    # a's own latest snapshot is 2, b's is 8; c moved its file away before its latest
    (1, 0, "a", "x/one", "AA01"), (2, 0, "a", "x/two", "bb02"), (2, 0, "a", "x/twin", "bb02"), (1, 0, "b", "y/old", "0xBB02"), (8, 0, "b", ".\\y\\new", "00aa01"), (8, 0, "b", "y/late", "cc03"), (8, 1, "b", "y/late", "dd04"), (8, 0, "b", "y/late", "cc03"),
    (3, 0, "c", "z/gone", "dd04"), (5, 0, "c", "z/gone", None), (5, 0, "c", "z/only", "ee05"), (7, 0, "d", "k/two", "bb02"), (4, 0, None, "k", "bb02"), (4, 0, "a", None, "bb02"),
]


def test_digests_of_all_snapshots_meet_the_latest_of_other_roots(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    made = [(n, f"2025-01-0{at + 1}", r, p, s) for n, at, r, p, s in SIGS]
    df = spark.createDataFrame(made, "snap_no int, loaded_at string, root string, path string, sha256 string").selectExpr("snap_no", "CAST(loaded_at AS timestamp_ntz) AS loaded_at", "root", "path", "sha256")
    df.coalesce(1).write.parquet(str(tmp_path / "file_sigs.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["q_hash_ioc_all"](spark, str(tmp_path)).collect())
    want = [("a", "x/one", "aa01", 1), ("a", "x/twin", "bb02", 1), ("a", "x/two", "bb02", 1), ("b", "y/old", "bb02", 2), ("c", "z/gone", "dd04", 1), ("d", "k/two", "bb02", 1)]
    assert got == want
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW file_sigs AS SELECT * FROM '{tmp_path}/file_sigs.parquet/*.parquet'")
    assert sorted(duckdb.sql(entry.oracle_sql()["q_hash_ioc_all"]).fetchall()) == want


def test_kept_ranges_merge_to_the_same_changes(spark, tmp_path):
    from tracewell.operators.snapshots import keep_ranged, merge_ranged

    made = [(1, f"r{i % 3}", f"p{i}", f"{i % 5}", T[0], None) for i in range(60)] + [(2, f"r{i % 3}", f"p{i}", None if i == 7 else f"{(i + (i % 11 == 0)) % 5}", T[0], None) for i in range(3, 66)]
    df = spark.createDataFrame(made, "snap_no int, owner string, rec string, sha string, loaded_at timestamp, extra string").drop("extra")
    a, b = df.where("snap_no = 1"), df.where("snap_no = 2")
    bounds = keep_ranged(a, ["sha"], str(tmp_path / "a"), partitions=4)
    assert len(bounds) == 3 and keep_ranged(b, ["sha"], str(tmp_path / "b"), bounds) == bounds
    got = sorted((r.owner, r.rec, r.change) for r in merge_ranged(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["sha"]).collect())
    old, new = {(r[1], r[2]): r[3] for r in made if r[0] == 1}, {(r[1], r[2]): r[3] for r in made if r[0] == 2}
    want = [(*k, "removed") for k in old.keys() - new.keys()] + [(*k, "added") for k in new.keys() - old.keys()] + [(*k, "changed") for k in old.keys() & new.keys() if old[k] is not None and new[k] is not None and old[k] != new[k]]
    assert got == sorted(want)
    empty = spark.createDataFrame([], df.schema)
    assert keep_ranged(empty, ["sha"], str(tmp_path / "c")) == []
