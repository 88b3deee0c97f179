"""Queries of the rule scan and of what follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators import report as R
from tracewell.operators.flows import RISKY
from tracewell.operators.scan import entropy_findings, raw_hits, scan
from tracewell.operators.snapshots import hex_number, latest_delivery
from tracewell.rules.model import Rule, load
from tracewell.session import table


def documents_as_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("unknown")).alias("target"), X.plain_path(F.col("path")).alias("path"), "text")


def excerpts_as_files(spark: SparkSession, d: str) -> DataFrame:
    return R.once(table(spark, d, "findings")).select(F.col("finding_id").alias("key"), "target", X.plain_path(F.col("path")).alias("path"), F.col("excerpt").alias("text"))


def _rules(*ids: str):
    return [r for r in load() if not ids or r.id in ids]


def q_scan_documents(spark, d):
    """Flagship: all built-in rules over all documents, capped, deduplicated, masked."""
    return scan(documents_as_files(spark, d), load()).select(F.col("key").alias("doc_id"), "ruleset", "rule_id", "severity", "severity_rank", "path", "line", "excerpt")


def q_scan_core(spark, d):
    """The whole scan (capped, deduplicated) with those of its rules that SQL can say."""
    rules = _rules("TW-DOC-001", "TW-DOC-002", "TW-DOC-003", "TW-DOC-004", "TW-DOC-005", "TW-DOC-006", "TW-DOC-008", "TW-PATH-001", "TW-PATH-002")
    return scan(documents_as_files(spark, d), rules).select(F.col("key").alias("doc_id"), "rule_id", "severity", "line", "excerpt")


def q_content_rule_hits(spark, d):
    """Hits per content rule, uncapped."""
    rules = _rules("TW-DOC-001", "TW-DOC-002", "TW-DOC-003", "TW-DOC-004", "TW-DOC-005", "TW-DOC-006")
    names = F.array(*[F.lit(r.id) for r in rules])
    return raw_hits(documents_as_files(spark, d), rules).groupBy(F.element_at(names, F.col("rule_idx") + 1).alias("rule_id")).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("key").alias("docs"))


def q_line_numbers(spark, d):
    """Advisory references with their lines."""
    return raw_hits(documents_as_files(spark, d), _rules("TW-DOC-005")).select(F.col("key").alias("doc_id"), "hit_idx", "line", "excerpt", "token")


def q_contains_all(spark, d):
    return raw_hits(documents_as_files(spark, d), _rules("TW-DOC-008")).select(F.col("key").alias("doc_id"), "line", "token")


def q_keyword_gate(spark, d):
    """Hits of a rule that stand within 250 bytes of a keyword."""
    return raw_hits(excerpts_as_files(spark, d), _rules("TW-DOC-007")).select(F.col("key").alias("finding_id"), "line", "token")


def q_dataflow(spark, d):
    return raw_hits(excerpts_as_files(spark, d), _rules("TW-FLOW-001")).select(F.col("key").alias("finding_id"), "line", "token")


def q_path_rules(spark, d):
    ids = ["TW-PATH-001", "TW-PATH-002"]
    return raw_hits(documents_as_files(spark, d), _rules(*ids)).select(F.col("key").alias("doc_id"), F.element_at(F.array(*map(F.lit, ids)), F.col("rule_idx") + 1).alias("rule_id"))


def q_secret_candidates(spark, d):
    """Masked token literals of enough entropy."""
    return scan(excerpts_as_files(spark, d), _rules("TW-SEC-001"), max_hits=1_000_000).select(F.col("key").alias("finding_id"), "line", "excerpt")


def q_entropy_tokens(spark, d):
    return entropy_findings(documents_as_files(spark, d)).select(F.col("key").alias("doc_id"), "line", "i", "token", "entropy")


def q_taint(spark, d):
    """Outside data that reaches an execution, in the findings' excerpts."""
    rule = Rule("TW-TAINT-001", "flow", "high", "taint", "Outside data reaches a call", path=".", source=r"\$_GET\b|\batob\(", sink=r"\b(?:eval|system)\s*\(", sanitizers=("escape(", "quote("))
    return raw_hits(excerpts_as_files(spark, d), [rule]).select(F.col("key").alias("finding_id"), "line")


def q_python_ast(spark, d):
    """Risky calls in the syntax trees of excerpts that are Python."""
    rule = Rule("TW-AST-001", "flow", "high", "ast", "Risky call", path=r"\.py$", calls=RISKY, shell=True)
    rows = excerpts_as_files(spark, d).withColumn("path", F.lit("excerpt.py"))
    return raw_hits(rows, [rule]).select(F.col("key").alias("finding_id"), "line", F.col("excerpt").alias("call"))


def files_as_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("file_id IS NOT NULL").dropDuplicates(["file_id"])
    return f.select(F.col("file_id").alias("key"), F.col("root").alias("target"), X.plain_path(F.col("path")).alias("path"), "text")


def q_files_taint(spark, d):
    """Outside data that reaches an execution over the lines of whole files; no SQL, as the flow is a fold over lines."""
    rule = Rule("TW-TAINT-001", "flow", "high", "taint", "Outside data reaches a call", path=".", source=r"\b(?:argv|stdin|request|input|params|environ|env)\b|\$_GET\b|\batob\(", sink=r"\b(?:exec|system|eval|popen|write|put|push)\s*\(", sanitizers=("escape(", "quote("))
    return raw_hits(files_as_files(spark, d), [rule]).select(F.col("key").alias("file_id"), "line", "excerpt")


def q_files_python_ast(spark, d):
    """Risky calls in the syntax trees of the Python files that parse; no SQL."""
    rule = Rule("TW-AST-001", "flow", "high", "ast", "Risky call", path=r"\.pyi?$", calls=RISKY, shell=True)
    return raw_hits(files_as_files(spark, d), [rule]).select(F.col("key").alias("file_id"), "line", F.col("excerpt").alias("call"))


def q_hash_ioc_all(spark, d):
    """Agent files of any snapshot whose digest stands in the latest snapshot of another root, with how many such roots: an equi-join on hashes."""
    named = table(spark, d, "file_sigs").where("root IS NOT NULL AND path IS NOT NULL AND snap_no IS NOT NULL").select("root", X.plain_path(F.col("path")).alias("path"), "snap_no", "loaded_at", hex_number(F.col("sha256")).alias("sha256"))
    rows = latest_delivery(named, ["root", "path", "snap_no"], "loaded_at", ["sha256"])
    last = rows.groupBy("root").agg(F.max("snap_no").alias("snap_no"))
    wanted = rows.join(last, ["root", "snap_no"]).where("sha256 IS NOT NULL").select("root", "sha256").distinct()
    spread = wanted.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    files = rows.where("sha256 IS NOT NULL").select("root", "path", "sha256").distinct()
    held = files.join(spread, "sha256").join(wanted.withColumn("own", F.lit(1)), ["root", "sha256"], "left").withColumn("roots", F.col("n") - F.coalesce("own", F.lit(0)))
    return held.where("roots > 0").select("root", "path", "sha256", "roots")


def q_finalize_order(spark, d):
    """Findings of at least high severity in report order, numbered."""
    from pyspark.sql.window import Window

    f = R.once(table(spark, d, "findings")).where(R.rank_of(F.col("severity")) >= 3)
    w = Window.partitionBy("target").orderBy(R.rank_of(F.col("severity")).desc(), "path", F.asc_nulls_first("line"), "rule_id", F.asc_nulls_first("excerpt"), "message", "finding_id")
    return f.select("finding_id", "target", F.row_number().over(w).alias("position"))


def q_severity_summary(spark, d):
    return R.summary(R.once(table(spark, d, "findings")))


def q_target_stats(spark, d):
    return R.by_target(R.once(table(spark, d, "findings")))


def q_rule_rollup(spark, d):
    """Extension: counts by ruleset and rule with subtotals."""
    f = R.once(table(spark, d, "findings"))
    return f.rollup("ruleset", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def q_cap_and_dedupe(spark, d):
    """Of each rule and file at most three findings, after duplicates of (rule, line, excerpt) in a scan are one."""
    from pyspark.sql.window import Window

    f = R.once(table(spark, d, "findings"))
    first = f.groupBy("scan_id", "target", "path", "rule_id", "line", "excerpt").agg(F.min("finding_id").alias("finding_id"))
    w = Window.partitionBy("scan_id", "target", "path", "rule_id").orderBy("finding_id")
    return first.withColumn("_n", F.row_number().over(w)).where("_n <= 3").select("finding_id")


def q_ignore(spark, d):
    pats = R.ignore_patterns(spark, ["MAL-001", "* **/generated/**", "JS-002 src/**", "py-00? tests/*"])
    return R.apply_ignore(R.once(table(spark, d, "findings")).withColumn("path", X.plain_path(F.col("path"))), pats).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def q_vex(spark, d):
    s = spark.createDataFrame([(0, "PHP-001", "not_affected"), (1, "PHP-001", "affected"), (2, "GO-004", "fixed"), (3, "shell", "under_investigation")], "idx int, vuln string, status string")
    return R.apply_vex(R.once(table(spark, d, "findings")), s).groupBy("vex_status").agg(F.count(F.lit(1)).alias("n"))


def q_fingerprints(spark, d):
    return R.once(table(spark, d, "findings")).select("finding_id", R.base_fingerprint().alias("fp_base"), R.content_fingerprint().alias("fp_content"), R.trend_fingerprint().alias("fp_trend"))


def q_baseline(spark, d):
    """Findings known from a target's first scan, by scan."""
    f = R.once(table(spark, d, "findings"))
    firsts = f.groupBy("target").agg(F.min("scan_id").alias("scan_id"))
    base = f.join(firsts, ["target", "scan_id"]).select(R.base_fingerprint().alias("fp"), R.content_fingerprint().alias("fp_content"))
    return R.partition_by_baseline(f, base).groupBy("scan_id").agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("new"))


def q_trend(spark, d):
    return R.trend(R.once(table(spark, d, "findings")), table(spark, d, "scans"))


def q_scan_counts(spark, d):
    return table(spark, d, "scans").groupBy("root").agg(F.countDistinct("scan_id").alias("scans"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_FP = "regexp_replace(replace({}, chr(92), '/'), '^(\\./+)+', '')"
_ONCE = "f AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY recorded_at DESC NULLS LAST) = 1)"
_RANK = "list_position(['info','low','medium','high','critical'], lower(trim(severity))) - 1"
# Lines of every document; the hits of a pattern in a line, in order.
_LINES = "l AS (SELECT doc_id, path, CAST(n AS INTEGER) AS line, s[n] AS txt FROM (SELECT DISTINCT doc_id, path, text, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) t(n))"
_CONTENT = {
    "TW-DOC-001": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}", "contact", "info", 0, None),
    "TW-DOC-002": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "network", "low", 1, r"^(?:0|10|127)\."),
    "TW-DOC-003": (r"https?://[A-Za-z0-9./_?=&%#:~+-]+", "network", "info", 0, None),
    "TW-DOC-004": (r"SPDX-License-Identifier:", "license", "info", 0, None),
    "TW-DOC-005": (r"\b[a-z]{4,10}-(?:19|20)[0-9]{2}-[0-9]{1,5}\b", "advisory", "medium", 2, None),
    "TW-DOC-006": (r"curl [^\n|]{1,200}\| *(?:ba)?sh\b", "malware", "high", 3, None),
}


def _hits_sql(rule: str) -> str:
    rx, ruleset, severity, rank, exclude = _CONTENT[rule]
    kept = f"list_filter(regexp_extract_all(txt, '{rx}'), lambda x: NOT regexp_matches(x, '{exclude}'))" if exclude else f"regexp_extract_all(txt, '{rx}')"
    return f"SELECT doc_id, path, line, txt, unnest({kept}) AS token, unnest(range(len({kept}))) AS k, '{rule}' AS rule_id, '{ruleset}' AS ruleset, '{severity}' AS severity, {rank} AS severity_rank FROM l"


_ALL_HITS = " UNION ALL ".join(f"({_hits_sql(r)})" for r in _CONTENT)
_EXC = "left(trim({}), 200)"
_ENT = "round(list_sum(list_transform(list_distinct(string_split({t}, '')), lambda c: -((length({t}) - length(replace({t}, c, ''))) / CAST(length({t}) AS DOUBLE)) * log2((length({t}) - length(replace({t}, c, ''))) / CAST(length({t}) AS DOUBLE)))), 6)"

ORACLE = {
    "q_content_rule_hits": f"WITH {_LINES} SELECT rule_id, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM ({_ALL_HITS}) GROUP BY rule_id",
    "q_scan_core": f"""WITH {_LINES}, h AS (SELECT * FROM ({_ALL_HITS}) QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY line, k) <= 3)
        SELECT DISTINCT doc_id, rule_id, severity, line, {_EXC.format('txt')} AS excerpt FROM h
        UNION ALL SELECT doc_id, 'TW-DOC-008', 'info', line, {_EXC.format('txt')} FROM (SELECT doc_id, line, txt FROM l WHERE contains(txt, 'Upgrade ') AND doc_id IN (SELECT doc_id FROM documents WHERE contains(text, 'Upgrade ') AND contains(text, 'or later')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) = 1)
        UNION ALL SELECT doc_id, rule_id, severity, NULL, NULL FROM (SELECT DISTINCT doc_id, {_FP.format('path')} AS path FROM documents) CROSS JOIN (VALUES ('TW-PATH-001', '^commit/', 'info'), ('TW-PATH-002', '(?:^|/)log/|\\.log$', 'low')) r(rule_id, rx, severity) WHERE regexp_matches(path, rx)""",
    "q_secret_candidates": f"""WITH {_ONCE}, t AS (SELECT finding_id, left(trim(excerpt), 200) AS e, unnest(regexp_extract_all(excerpt, '(?i)(?:secret|token|api[_-]?key|passw(?:or)?d|kennwort|clave)[A-Za-z0-9_.-]{{0,20}}["'']? *[:=]+ *["''`]?([A-Za-z0-9+/_-]{{20,}})', 1)) AS x FROM f WHERE NOT contains(excerpt, chr(10)))
        SELECT DISTINCT finding_id, CAST(1 AS INTEGER) AS line, replace(e, x, left(x, 4) || '...' || right(x, 3)) AS excerpt FROM t
        WHERE length(x) >= 20 AND len(list_distinct(string_split(x, ''))) > 4 AND NOT regexp_matches(x, '(?i)(?:example|dummy|changeme|placeholder|your[_-]|xxxx|todo|redacted|sample|fixme|insert[_-])') AND {_ENT.format(t='x')} >= 3.8""",
    "q_line_numbers": f"WITH {_LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1 AS INTEGER) AS hit_idx, line, {_EXC.format('txt')} AS excerpt, token FROM ({_hits_sql('TW-DOC-005')})",
    "q_contains_all": f"WITH {_LINES} SELECT doc_id, min(line) AS line, 'Upgrade ' AS token FROM l WHERE contains(txt, 'Upgrade ') AND doc_id IN (SELECT doc_id FROM documents WHERE contains(text, 'Upgrade ') AND contains(text, 'or later')) GROUP BY doc_id",
    "q_keyword_gate": f"""WITH {_ONCE}, h AS (SELECT finding_id, excerpt, unnest(regexp_extract_all(excerpt, 'verify *= *False')) AS token FROM f WHERE NOT contains(excerpt, chr(10)))
        SELECT finding_id, CAST(1 AS INTEGER) AS line, token FROM h WHERE regexp_matches(lower(excerpt), 'request|http')""",
    "q_dataflow": f"WITH {_ONCE} SELECT finding_id, CAST(1 AS INTEGER) AS line, regexp_extract(excerpt, '(exec|eval|system|curl)', 1) AS token FROM f WHERE regexp_matches(excerpt, '(?:process\\.env|os\\.environ|getenv|atob|\\$_GET)') AND regexp_matches(excerpt, '(exec|eval|system|curl)')",
    "q_taint": f"WITH {_ONCE} SELECT finding_id, CAST(1 AS INTEGER) AS line FROM f WHERE regexp_matches(excerpt, '\\$_GET\\b|\\batob\\(') AND regexp_matches(excerpt, '\\b(?:eval|system)\\s*\\(') AND NOT contains(excerpt, chr(10))",
    "q_path_rules": f"""SELECT doc_id, rule_id FROM (SELECT DISTINCT doc_id, {_FP.format('path')} AS path FROM documents) CROSS JOIN (VALUES ('TW-PATH-001', '^commit/'), ('TW-PATH-002', '(?:^|/)log/|\\.log$')) r(rule_id, rx) WHERE regexp_matches(path, rx)""",
    "q_entropy_tokens": f"""WITH {_LINES}, t AS (SELECT doc_id, line, unnest(regexp_extract_all(txt, '[A-Za-z0-9+/=_.-]{{24,}}')) AS token, unnest(range(len(regexp_extract_all(txt, '[A-Za-z0-9+/=_.-]{{24,}}')))) AS i FROM l
          WHERE length(txt) >= 24 AND NOT regexp_matches(lower(txt), 'sha256|sha512|integrity|https?:|data:') AND NOT coalesce(regexp_matches(path, '(?i)(?:\\.lock|-lock\\.json|\\.sum|\\.min\\.js)$'), false)),
        e AS (SELECT *, {_ENT.format(t='token')} AS entropy FROM t WHERE NOT regexp_matches(token, '^[0-9a-fA-F]+$') AND NOT regexp_matches(token, '^[A-Z0-9]+$'))
        SELECT doc_id, line, CAST(i AS INTEGER) AS i, token, entropy FROM e WHERE entropy >= 4.5 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) <= 8""",
    "q_hash_ioc_all": f"""WITH n AS (SELECT root, {_FP.format('path')} AS path, snap_no, loaded_at, regexp_replace(regexp_replace(lower(trim(sha256)), '^0x', ''), '^0+(.)', '\\1') AS sha256
          FROM file_sigs WHERE root IS NOT NULL AND path IS NOT NULL AND snap_no IS NOT NULL),
        s AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY root, path, snap_no ORDER BY loaded_at DESC NULLS LAST, sha256 DESC) = 1),
        w AS (SELECT root, sha256 FROM s QUALIFY snap_no = max(snap_no) OVER (PARTITION BY root))
        SELECT s.root, s.path, s.sha256, count(DISTINCT w.root) AS roots FROM s JOIN w ON w.sha256 = s.sha256 AND w.root <> s.root GROUP BY ALL""",
    "q_finalize_order": f"WITH {_ONCE} SELECT finding_id, target, CAST(row_number() OVER (PARTITION BY target ORDER BY {_RANK} DESC, path, line NULLS FIRST, rule_id, excerpt NULLS FIRST, message, finding_id) AS INTEGER) AS position FROM f WHERE {_RANK} >= 3",
    "q_severity_summary": f"WITH {_ONCE} SELECT " + ", ".join(f"count(*) FILTER ({_RANK} = {i}) AS {s}" for i, s in enumerate(["info", "low", "medium", "high", "critical"])) + f", count(*) AS total, CAST(coalesce(max({_RANK}), -1) AS INTEGER) AS worst FROM f",
    "q_target_stats": f"WITH {_ONCE} SELECT target, count(DISTINCT path) AS files, count(*) AS findings, CAST(max({_RANK}) AS INTEGER) AS worst FROM f GROUP BY target",
    "q_rule_rollup": f"WITH {_ONCE} SELECT ruleset, rule_id, count(*) AS n FROM f GROUP BY ROLLUP (ruleset, rule_id)",
    "q_cap_and_dedupe": f"""WITH {_ONCE}, g AS (SELECT scan_id, target, path, rule_id, line, excerpt, min(finding_id) AS finding_id FROM f GROUP BY ALL)
        SELECT finding_id FROM g QUALIFY row_number() OVER (PARTITION BY scan_id, target, path, rule_id ORDER BY finding_id) <= 3""",
    "q_ignore": f"""WITH {_ONCE}, g AS (SELECT rule_id, {_FP.format('path')} AS path FROM f)
        SELECT rule_id, count(*) AS n FROM g WHERE NOT (rule_id = 'MAL-001' OR coalesce(path LIKE '%/generated/%' OR path LIKE 'generated/%', false) OR (rule_id = 'JS-002' AND path LIKE 'src/%')) GROUP BY rule_id""",
    "q_vex": f"""WITH {_ONCE}, g AS (SELECT *, CASE WHEN rule_id = 'PHP-001' THEN 'not_affected' WHEN rule_id = 'GO-004' THEN 'fixed' WHEN regexp_matches(message, '(^|[^A-Za-z0-9._:-])shell($|[^A-Za-z0-9._:-])') THEN 'under_investigation' END AS vex_status FROM f)
        SELECT vex_status, count(*) AS n FROM g GROUP BY vex_status""",
    "q_fingerprints": f"""WITH {_ONCE} SELECT finding_id, left(sha256(rule_id || '|' || {_FP.format('path')} || '|' || coalesce(excerpt, '')), 16) AS fp_base, left(sha256(rule_id || '|' || coalesce(excerpt, '')), 16) AS fp_content,
        left(sha256(rule_id || '|' || {_FP.format('path')} || '|' || coalesce(CAST(line AS VARCHAR), '') || '|' || coalesce(excerpt, '') || '|' || lower(severity)), 16) AS fp_trend FROM f""",
    "q_baseline": f"""WITH {_ONCE}, g AS (SELECT *, rule_id || '|' || {_FP.format('path')} || '|' || coalesce(excerpt, '') AS a, rule_id || '|' || coalesce(excerpt, '') AS b FROM f),
        b AS (SELECT g.a, g.b FROM g JOIN (SELECT target, min(scan_id) AS scan_id FROM f GROUP BY target) USING (target, scan_id)),
        k AS (SELECT scan_id, (a IN (SELECT a FROM b) OR b IN (SELECT b FROM b)) AND coalesce({_RANK}, 0) < 4 AS known FROM g)
        SELECT scan_id, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS new FROM k GROUP BY scan_id""",
    "q_trend": f"""WITH {_ONCE}, s AS (SELECT root, scan_id, row_number() OVER (PARTITION BY root ORDER BY ts DESC, scan_id DESC) AS age FROM (SELECT DISTINCT root, scan_id, ts FROM scans) QUALIFY age <= 2),
        p AS (SELECT root, rule_id || '|' || {_FP.format('path')} || '|' || coalesce(CAST(line AS VARCHAR), '') || '|' || coalesce(excerpt, '') || '|' || lower(severity) AS fp, bool_or(age = 1) AS cur, bool_or(age = 2) AS prev FROM f JOIN s USING (scan_id) GROUP BY ALL),
        c AS (SELECT root, count(*) FILTER (cur AND NOT prev) AS new, count(*) FILTER (NOT cur AND prev) AS fixed, count(*) FILTER (cur AND prev) AS persistent FROM p GROUP BY root)
        SELECT root, coalesce(new, 0) AS new, coalesce(fixed, 0) AS fixed, coalesce(persistent, 0) AS persistent FROM (SELECT root FROM s GROUP BY root HAVING count(*) = 2) LEFT JOIN c USING (root)""",
    "q_scan_counts": "SELECT root, count(DISTINCT scan_id) AS scans FROM scans GROUP BY root",
}
