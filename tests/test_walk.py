import io
import gzip
import os
import tarfile

from pyspark.sql import functions as F

from tracewell.operators import audits as A
from tracewell.operators import report as R
from tracewell.operators import supply as P
from tracewell.sources import readers as I
from tracewell.sources.walk import ignored, ignore_rules, scan_tree, walk


def test_walk_sees_hidden_names_and_keeps_to_ignore_files(spark, tmp_path):
    made = {"a.py": b"x", ".env": b"K=1", "_under.txt": b"u", "build/out.js": b"o", "build/key.pem": b"p", "node_modules/m/i.js": b"n", ".git/config": b"g", "src/.hidden/b.go": b"b", "src/x.log": b"l", "src/keep.log": b"k", "src/sub/x.log": b"l", "bin": b"\x00\x01hello world\x02", "e": b""}
    for p, c in made.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    (tmp_path / ".gitignore").write_text("# c\nbuild/\n*.log\n!keep.log\n.env\n")
    os.symlink("/etc/hostname", tmp_path / "out")
    os.symlink(tmp_path / "a.py", tmp_path / "in")
    os.symlink(tmp_path / "src", tmp_path / "dirlink")
    got = {r.path for r in walk(spark, str(tmp_path)).collect()}
    assert got == {"a.py", ".env", "_under.txt", "build/key.pem", "src/.hidden/b.go", "src/keep.log", "bin", "e", ".gitignore", "in"}
    assert ".git/config" in {r.path for r in walk(spark, f"file://{tmp_path}", git=True, ignore_files=False).collect()}
    rows = {r.path: r for r in scan_tree(spark, str(tmp_path)).collect()}
    assert rows["bin"].is_binary and rows["bin"].text == "hello world" and rows["a.py"].text == "x" and rows["e"].text == ""
    (tmp_path / "none").mkdir()
    assert walk(spark, str(tmp_path / "none")).count() == 0 and walk(spark, str(tmp_path / "missing")).count() == 0


def test_ignore_rules():
    rules = ignore_rules("/top\na/b\n*.o\nd/\n!x.o\n", "base")
    for path, is_dir, want in [("base/top", False, True), ("base/q/top", False, False), ("base/a/b", False, True), ("base/z.o", False, True), ("base/q/z.o", False, True), ("base/x.o", False, False), ("base/d", True, True), ("base/d", False, False), ("other/z.o", False, False)]:
        assert ignored(path, is_dir, rules) == want, path


def test_sockets_of_both_kinds(spark):
    t = "  sl  local_address\n   0: 0100007F:1F90 00000000:0000 0A 00000000:00000000 00:00000000 00000000     0        0 12345 1\n   1: B80D01200000000067452301EFCDAB89:0035 00000000000000000000000000000000:0000 07 00000000:00000000 00:00000000 00000000     0        0 77 1\n   2: 0000000000000000FFFF00000100007F:0050 00000000000000000000000000000000:0000 0A 0:0 0:0 0 0 0 78 1"
    got = {r.inode: (r.local_ip, r.local_port) for r in I.sockets(spark.createDataFrame([(1, t), (2, None)], "key int, text string")).collect()}
    assert got == {12345: ("127.0.0.1", 8080), 77: ("2001:0db8:0000:0000:0123:4567:89ab:cdef", 53), 78: ("127.0.0.1", 80)}


def test_signature_archives_and_json_feeds(spark):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        data = b"aabb:12:Mal.A\nccdd:*:Mal.B\nbroken\n"
        info = tarfile.TarInfo("x.hdb")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    df = spark.createDataFrame([(1, b"H" * 512 + gzip.compress(b.getvalue())), (2, b"x"), (3, None)], "key int, content binary")
    assert sorted(tuple(r) for r in I.signature_archives(df).collect()) == [(1, "aabb", 12, "Mal.A"), (1, "ccdd", None, "Mal.B")]
    feed = spark.createDataFrame([(1, '{"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "a", "title": "T"}, {"id": "b"}]}'), (2, '{"items": []}'), (3, None)], "key int, text string")
    assert sorted(tuple(r) for r in A.feed_entries(feed).collect()) == [(1, 0, "a", "T"), (1, 1, "b", None)]


def test_two_edits_and_ignore_patterns(spark):
    names = spark.createDataFrame([("lodsh",), ("ldoahs",), ("zzzz",)], "name string")
    got = sorted(tuple(r) for r in P.typosquats(names, spark.createDataFrame([("lodash", 0)], "name string, pos int"), most=2).collect())
    assert got == [("ldoahs", "lodash", 2), ("lodsh", "lodash", 1)]
    f = spark.createDataFrame([("A-1", "x/a"), ("A-2", "y"), ("A-3", None)], "rule_id string, path string")
    assert [r.rule_id for r in R.apply_ignore(f, R.ignore_patterns(spark, ["* x/*", "a-2"])).collect()] == ["A-3"]
    assert R.apply_ignore(f, R.ignore_patterns(spark, ["*"])).count() == 0
    lists = spark.createDataFrame([("A-1", "x", None)], "rule_id string, path string, excerpt string").select(R.portable_fingerprint().alias("f")).first()
    from tracewell.functions.codecs import fnv1a

    assert lists.f == f"{fnv1a(b'A-1|x|'):016x}"
    many = spark.createDataFrame([(x,) for x in ["", "a", "abc" * 50, None, "é"]], "s string")
    from tracewell.functions.codecs import fnv1a_hex

    assert [r[0] for r in many.select(fnv1a_hex(F.col("s"))).collect()] == [None if x is None else f"{fnv1a(x.encode()):016x}" for x in ["", "a", "abc" * 50, None, "é"]]
