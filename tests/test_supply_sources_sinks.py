import json
import sqlite3
from datetime import datetime

from pyspark.sql import functions as F

from tracewell.functions.deps import parse
from tracewell.operators import audits as A
from tracewell.operators import events as E
from tracewell.operators import similarity as S
from tracewell.operators import supply as P
from tracewell.sinks import renderers as O
from tracewell.sources import readers as I
from tracewell.sources.sqlite import SqliteSource
from tracewell.streaming import watch as W


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_manifest_parsers():
    assert parse("package-lock.json", '{"packages": {"": {}, "node_modules/@a/b": {"version": "1.0.0"}}}') == [("npm", "@a/b", "1.0.0")]
    assert parse("a/package-lock.json", '{"dependencies": {"x": {"version": "1", "dependencies": {"y": {"version": "2"}}}}}') == [("npm", "x", "1"), ("npm", "y", "2")]
    assert parse("package.json", '{"dependencies": {"x": "^1.2", "l": "file:../l"}}') == [("npm", "x", "1.2")]
    assert parse("requirements-dev.txt", "a==1.0 # c\nb>=2\nc[x]==3") == [("PyPI", "a", "1.0"), ("PyPI", "c", "3")]
    assert parse("Cargo.lock", '[[package]]\nname = "s"\nversion = "1.1"\n') == [("crates.io", "s", "1.1")]
    assert parse("go.sum", "h.test/m v1.2.3 h1:x=\nh.test/m v1.2.3/go.mod h1:y=") == [("Go", "h.test/m", "1.2.3")]
    assert parse("yarn.lock", '"@a/b@^1.0.0":\n  version "1.0.4"\nc@1:\n  version "1.1"') == [("npm", "@a/b", "1.0.4"), ("npm", "c", "1.1")]
    assert parse("Gemfile.lock", "GEM\n  specs:\n    rake (13.0.1)\n      dep (>= 1)") == [("RubyGems", "rake", "13.0.1")]
    assert parse("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>") == [("Maven", "g:a", "1")]
    assert parse("pyproject.toml", '[project]\ndependencies = ["a>=1.0", "b"]') == [("PyPI", "a", "1.0")]
    assert parse("package.json", "not json") == [] and parse("a.py", "x==1") == [] and parse("go.sum", None) == []


def test_version_ranges(spark):
    inst = spark.createDataFrame([(1, "Nginx", "1.30"), (2, "nginx", "1.30.0"), (3, "nginx", "1.29.9"), (4, "nginx", None), (5, "nginx", "abc"), (6, None, "1")], "key int, product string, version string")
    adv = spark.createDataFrame([("A", "nginx", [">=1.30 <1.31"]), ("B", "nginx", ["<1.30"]), ("C", "nginx", ["bad", ""]), ("D", "nginx", None), ("E", "nginx", ["=1.29.9", ">2"])], "id string, product string, affected array<string>")
    assert rows(P.affected(inst, adv), "key", "advisory") == [(1, "A"), (2, "A"), (3, "B"), (3, "E")]


def test_names(spark):
    names = spark.createDataFrame([("recat",), ("raect",), ("react",), ("reac",), ("vue",), (None,)], "name string")
    popular = spark.createDataFrame([("react", 0), ("preact", 1)], "name string, pos int")
    assert rows(P.typosquats(names, popular)) == [("raect", "react", 1), ("reac", "react", 1), ("recat", "react", 1)]
    like = rows(P.lookalikes(spark.createDataFrame([("ab.test",)], "name string")), "candidate")
    assert ("ba.test",) in like and ("a-b.test",) in like and ("a.test",) in like and ("ab.com",) in like and ("4b.test",) in like


def test_dep_delta_keeps_scoped_names(spark):
    mk = lambda *r: spark.createDataFrame(list(r), "name string, version string")
    got = P.dep_delta(mk(("@a/x", "1"), ("@a/y", "1")), mk(("@a/x", "2"), ("@b/y", "1")), ["name"])
    assert rows(got, "name", "change") == [("@a/x", "changed"), ("@a/y", "removed"), ("@b/y", "added")]


def test_dep_delta_by_root_and_delivery(spark, tmp_path):
    import __spark_entry__ as entry

    lock = lambda **v: '{"packages": {' + ", ".join(f'"node_modules/{k}": {{"version": "{x}"}}' for k, x in v.items()) + "}}"
    made = [
        (2, "a", "package-lock.json", lock(x="1.0.0", gone="2.0.0", same="3.0.0"), "2025-01-01"), (2, "a", ".\\package-lock.json", lock(x="1.1.0", new="1.0.0", same="3.0.0"), "2025-01-03"), (4, "a", "sub/requirements.txt", "x==9.0\n", "2025-01-02"),
        (3, "b", "package-lock.json", lock(x="7.0.0"), "2025-02-01"), (5, "b", "src/a.py", "pass", "2025-02-05"), (7, "c", "package-lock.json", lock(x="5.0.0"), "2025-03-01"),
    ]
    df = spark.createDataFrame(made, "file_id bigint, root string, path string, text string, indexed_at string").withColumn("indexed_at", F.col("indexed_at").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "files.parquet"))
    got = rows(entry.queries()["q_dep_delta_roots"](spark, str(tmp_path)), "root", "name", "old", "new", "change")
    assert sorted(got) == [("a", "gone", "2.0.0", None, "removed"), ("a", "new", None, "1.0.0", "added"), ("a", "x", "1.0.0", "1.1.0", "changed"), ("c", "x", None, "5.0.0", "added")]


def test_license_ladder(spark):
    df = spark.createDataFrame([("MIT ... GNU Affero General Public License",), ("SPDX-License-Identifier: MIT",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(P.license_of(F.col("t"))).collect()] == ["AGPL-3.0", "MIT", None, None]


def test_audits(spark):
    web = spark.createDataFrame([(1, "https://x.test", {"Access-Control-Allow-Origin": "*", "access-control-allow-credentials": "true", "Content-Security-Policy": "default-src 'self'"}, "<form action='http://x'>"), (2, "http://x.test", None, None)], "resp_id int, url string, headers map<string,string>, body string")
    got = rows(A.web_audit(web), "resp_id", "id")
    # credentials to any origin, a plain form, a policy that is there and one that is not, transport security of a plain address
    assert (1, "WEB-017") in got and (1, "WEB-025") in got and (1, "WEB-010") not in got and (2, "WEB-010") in got and (2, "WEB-015") not in got
    docker = spark.createDataFrame([(1, "Dockerfile", "FROM a\nADD https://x.test/y /y\nENV API_KEY=abc\nRUN curl x | sh\nEXPOSE 2222"), (2, "b/Dockerfile", "FROM reg.test:5000/a:1.2\nUSER app\nENV TOKEN=$T")], "key int, path string, text string")
    assert rows(A.dockerfile_audit(docker), "key", "id") == [(1, "CNT-001"), (1, "CNT-002"), (1, "CNT-003"), (1, "CNT-004"), (1, "CNT-005"), (1, "CNT-010")]
    mail = spark.createDataFrame([("a", ["v=spf1 include:x -all"]), ("b", ["v=spf1", "v=spf1 all"]), ("c", None), ("d", []), ("e", ["v=spf1 " + "a:x " * 11 + "all"])], "domain string, txt array<string>")
    assert rows(A.spf(mail)) == [("a", "confirmed", "-all", 1), ("b", "error", None, None), ("c", "inconclusive", None, None), ("d", "absent", None, None), ("e", "error", "+all", 11)]
    tree = spark.createDataFrame([("a", "v=spf1 include:b mx"), ("b", "v=spf1 a include:a"), ("c", "v=spf1 -all")], "domain string, record string")
    assert dict(rows(A.spf_tree(tree, 3))) == {"a": 6, "b": 6, "c": 0}
    dm = spark.createDataFrame([("a", ["v=DMARC1; p=Reject; p=none"]), ("b", ["v=DMARC1; p=odd"]), ("c", None)], "domain string, txt array<string>")
    assert rows(A.dmarc(dm)) == [("a", "confirmed", "reject"), ("b", "inconclusive", "odd"), ("c", "inconclusive", None)]
    flows = spark.createDataFrame([(1, "10.1.2.3", 443), (2, "10.1.2.3", 80), (3, "169.254.169.254", 443), (4, "8.8.8.8", 22)], "id int, ip string, port int")
    allow = spark.createDataFrame([("10.0.0.0/8", 443), ("169.254.0.0/16", None), (None, 22)], "cidr string, port int")
    assert rows(A.unexpected_flows(flows, allow), "id") == [(2,), (3,)]
    blobs = spark.createDataFrame([(1, "a.pdf.exe", b"MZ" + b"UPX!"), (2, "a.png", b"\x89PNG\r\n\x1a\n" + b"IEND1234<?php"), (3, "a", None)], "key int, path string, content binary")
    assert rows(A.binary_findings(blobs)) == [(1, "BIN-001"), (1, "BIN-002"), (2, "BIN-003"), (2, "BIN-004")]


def test_rotation_and_provenance(spark):
    lines = [("a", 1, "s1", "+"), ("a", 2, "s2", "-"), ("a", 3, "s3", "+"), ("b", 1, "s1", "+"), ("b", 2, "s2", "-"), ("c", 1, "s1", "+"), ("c", 1, "s1", "-")]
    df = spark.createDataFrame(lines, "fp string, ts int, sha string, sign string")
    assert rows(E.rotation(df), "fp", "state", "ts") == [("a", "Reappeared", 3), ("b", "Removed", 2), ("c", "Live", 1)]
    assert dict(rows(E.rotation(df, spark.createDataFrame([("b",)], "fp string")), "fp", "state"))["b"] == "Live"
    ev = spark.createDataFrame([("x", "low")] * 20 + [("x", "high"), ("y", "medium")], "subject string, tier string")
    assert rows(E.provenance(ev)) == [("x", 70, "likely"), ("y", 15, "weak")]
    assert spark.range(1).select(E.upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2))), E.upper_median(F.array().cast("array<int>")), E.kind(F.lit("push")) == E.kind(F.lit("PushEvent"))).first() == (3, 0, True)


def test_similarity_against_brute_force(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [(1, base), (2, base), (3, base.replace("word50", "other")), (4, "tiny"), (5, None), (6, " ".join(f"x{i}" for i in range(300))), (7, " ".join(f"word{i}" for i in range(220)))]
    fp = S.fingerprints(spark.createDataFrame(texts, "key int, text string"), S.word_tokens(F.col("text")))
    h = {r.key: r.hashes for r in fp.collect()}
    assert set(h) == {1, 2, 3, 6, 7} and h[1] == h[2]
    members, pairs = S.similar(fp)
    assert dict(rows(members)) == {1: 1, 2: 1, 3: 3, 6: 6, 7: 7}
    got = {(r.a, r.b): r for r in S.classify(pairs).collect()}
    want = len(set(h[1]) & set(h[3])) / len(set(h[1]) | set(h[3]))
    assert abs(got[1, 3].jaccard - want) < 1e-9 and got[1, 3].kind == "copy" and not any(6 in k for k in got)


def test_similar_pairs_are_complete(spark):
    from collections import Counter
    from random import Random

    r = Random(5)
    text = lambda n, words=4000: " ".join(f"w{r.randrange(words)}" for _ in range(n))
    parts = [text(n) for n in (130, 150, 200, 260, 90, 70)]
    texts = [*parts, *(text(k) + " " + p + " " + text(k) for p in parts for k in (0, 20, 150, 600, 2500)), "go go " * 200, "go go " * 400 + text(100), *(text(200, 3) for _ in range(4))]
    fp = S.fingerprints(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), S.word_tokens(F.col("text")))
    held = {x.key: (x.shingles, Counter(x.hashes)) for x in fp.collect()}
    members, pairs = S.similar(fp)
    want = {}
    for a in (reps := sorted({x.rep for x in members.collect()})):
        for b in reps[reps.index(a) + 1 :]:
            (sa, ca), (sb, cb) = held[a], held[b]
            na, nb, c = ca.total(), cb.total(), (ca & cb).total()
            if c / (na + nb - c) >= 0.7 and min(sa, sb) >= 60:
                want[a, b] = "copy"
            elif c / min(na, nb) >= 0.8 and min(sa, sb) >= 120:
                want[a, b] = "b embeds a" if c / na >= c / nb else "a embeds b"
    assert sum("embeds" in k for k in want.values()) >= 12
    assert {(x.a, x.b): x.kind for x in S.classify(pairs).collect()} == want


def test_minima_of_all_permutations(spark, tmp_path):
    import __spark_entry__ as entry

    texts = [(1, " ".join(f"word{i}" for i in range(90))), (2, "one two three four five"), (3, "tiny"), (4, None), (1, " ".join(f"word{i}" for i in range(90)))]
    df = spark.createDataFrame(texts, "file_id bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "files.parquet"))
    held = {r.key: r.hashes for r in S.fingerprints(df.withColumnRenamed("file_id", "key"), S.word_tokens(F.col("text"))).collect()}
    want = {k: [min((a * h + b) % S.PRIME for h in hs) for a, b in S.coefficients()] for k, hs in held.items()}
    got = {r.file_id: r.minima for r in entry.queries()["q_minhash_64"](spark, str(tmp_path)).collect()}
    assert got == want and {len(x) for x in got.values()} == {64} and set(got) == {1, 2}


def test_file_sources(spark, tmp_path):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    (tmp_path / "a/x.py").write_text("hi")
    (tmp_path / "a/node_modules/y.js").write_text("no")
    (tmp_path / "a/node_modules/id_rsa").write_text("K=1")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01printable run\x02")
    got = {r.path: r for r in I.tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/x.py", "a/node_modules/id_rsa", "b.bin"} and got["b.bin"].is_binary and got["b.bin"].text == "printable run" and got["a/x.py"].text == "hi"
    (tmp_path / "t.csv").write_text('a,b\n1,"x ""q"" y"\n')
    assert rows(I.delimited(spark, str(tmp_path / "t.csv"), "b")) == [('x "q" y',)]
    (tmp_path / "t.jsonl").write_text('{"a": {"b": "v"}}\nplain\n')
    assert rows(I.json_lines(spark, str(tmp_path / "t.jsonl"), "a.b")) == [("plain",), ("v",)]
    (tmp_path / "t.json").write_text('[{"a": 1}, "s"]')
    assert len(rows(I.json_array(spark, str(tmp_path / "t.json")))) == 2
    con = sqlite3.connect(tmp_path / "d.db")
    con.execute("CREATE TABLE t (n INTEGER, s TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None), (3, "y")])
    con.commit()
    spark.dataSource.register(SqliteSource)
    db = spark.read.format("sqlite").option("path", str(tmp_path / "d.db")).load()
    assert rows(db) == [("t", "s", 1, "x"), ("t", "s", 3, "y")] and rows(db.where("value = 'y'"), "row_id") == [(3,)]


def test_text_sources(spark):
    one = lambda t: spark.createDataFrame([(1, t)], "key int, text string")
    assert rows(I.stanzas(one("Package: a\nVersion: 1\n\nPackage: b\nVersion: 2\n"))) == [(1, "a", "1"), (1, "b", "2")]
    assert rows(I.sockets(one("  sl local\n   0: 0100007F:1F90 08080808:01BB 01 0:0 0:0 0 1000 0 4242 1")))[0][1:] == ("127.0.0.1", 8080, "8.8.8.8", 443, 1, 4242)
    ind = spark.createDataFrame([("1.2.3[.]4",), ("hxxp://a.test/x",), ("a[.]test",), ("f" * 64,), ("# c",), ("d" * 32,), ("/tmp/x",)], "value string")
    assert sorted(r.kind for r in I.indicators(ind).collect()) == ["domain", "hash", "ip", "path", "sha256", "url"]
    assert rows(A.feed_entries(one("<feed><entry><id>a</id><title>T</title></entry></feed>")), "id", "title") == [("a", "T")]


def test_sinks(spark):
    f = spark.createDataFrame([("R|1", "HIGH", "t", "p:1", None, "a|b\nc", None), ("R2", "info", "t", "q", 3, "m", "<x>")], "rule_id string, severity string, target string, path string, line int, message string, excerpt string")
    sarif = [json.loads(r.value) for r in O.sarif_results(f).collect()]
    assert [s["level"] for s in sarif] == ["error", "note"] and sarif[0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert json.loads(O.code_climate(f).first().value)["severity"] == "critical" and len(O.sarif_rules(f).collect()) == 2
    assert O.annotations(f).first().value == "::error file=p%3A1,line=1,title=R|1::a|b%0Ac" and "a\\|b c" in O.markdown_rows(f).first().value
    assert "&lt;x&gt;" in O.html_rows(f).collect()[1].value and O.text_report(f, 1).endswith("...")
    assert O.baseline(f).count() == 2 and len(O.vex_statements(f).collect()) == 2
    d = spark.createDataFrame([("npm", "@a/b", "1")] * 2, "ecosystem string, name string, version string")
    assert json.loads(O.cyclonedx_components(d).first().value)["purl"] == "pkg:npm/%40a/b@1" and O.spdx_packages(d).count() == 1
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert rows(O.upsert(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")] and rows(O.insert_ignore(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, "w")]


def test_watch_over_batches(spark, tmp_path):
    src, schema = tmp_path / "in", "repo string, head string, ts timestamp"
    src.mkdir()
    state = W.VersionedState(spark, f"file://{tmp_path}/state", schema)

    def deliver(*heads):
        spark.createDataFrame([(r, h, datetime(2025, 1, d)) for r, h, d in heads], schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        W.watch(spark.readStream.schema(schema).parquet(f"file://{src}"), W.head_changes, state, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()

    deliver(("a", "1", 1), ("b", "1", 1))
    deliver(("a", "2", 2), ("b", "1", 2), ("c", "9", 2))
    deliver(("b", "5", 3))
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert rows(out, "repo", "old", "head") == [("a", "1", "2"), ("b", "1", "5")]


def test_differs(spark):
    st = spark.createDataFrame([("r", "f1")], "repo string, fp string")
    now = spark.createDataFrame([("r", "f2"), ("new", "f3")], "repo string, fp string")
    ev, after = W.new_findings("replace")(st, now)
    assert rows(ev) == [("r", "f2")] and rows(after) == [("new", "f3"), ("r", "f2")]
    assert rows(W.new_findings("union")(st, now)[1]) == [("new", "f3"), ("r", "f1"), ("r", "f2")]
    d = "repo string, ecosystem string, name string, version string"
    ev, _ = W.dep_changes(spark.createDataFrame([("r", "npm", "a", "1"), ("r", "npm", "b", "1")], d), spark.createDataFrame([("r", "npm", "a", "2"), ("r", "npm", "c", "1"), ("s", "npm", "z", "1")], d))
    assert rows(ev, "name", "id") == [("a", "DEPD-003"), ("b", "DEPD-002"), ("c", "DEPD-001")]
    p = "repo string, ref string, before string, head string, ts int"
    ev, _ = W.chain_breaks(spark.createDataFrame([("r", "m", "h0", 0)], "repo string, ref string, head string, ts int"), spark.createDataFrame([("r", "m", "h0", "h1", 1), ("r", "m", "x", "h2", 2)], p))
    assert rows(ev, "before", "expected") == [("x", "h1")]
    files = spark.createDataFrame([("r", "a", 1, 1), ("r", "b", 2, 1)], "root string, path string, mtime int, size int")
    cache = spark.createDataFrame([("r", "a", 1, 1, "F"), ("r", "gone", 1, 1, "F"), ("r", "b", 2, 1, "old")], "root string, path string, mtime int, size int, rules_fp string")
    todo, kept = W.unchanged(files, cache, "F")
    assert rows(todo, "path") == [("b",)] and rows(kept, "path") == [("a",)]


def test_every_query_has_a_unique_name_and_sql_only_for_queries():
    import __spark_entry__ as entry
    from tracewell.plans import catalogue

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(catalogue.QUERIES) <= set(q) and len(catalogue.QUERIES) == sum(len(p.QUERIES) for p in catalogue._PARTS)


def test_the_core_does_not_import_the_text_package():
    from pathlib import Path

    import tracewell

    root = Path(tracewell.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "tracewell.llm" in p.read_text()]


def test_minima_of_odd_lists(spark):
    df = spark.createDataFrame([(1, [5, 7, (1 << 60) - 1]), (2, []), (3, None), (4, [0])], "key int, hashes array<bigint>")
    got = {r.key: r.m for r in df.select("key", S.minima(F.col("hashes"), 3).alias("m")).collect()}
    assert got[2] is None and got[3] is None
    assert got[1] == [min((a * h + b) % S.PRIME for h in (5, 7, (1 << 60) - 1)) for a, b in S.coefficients(3)] and got[4] == [b % S.PRIME for _, b in S.coefficients(3)]
