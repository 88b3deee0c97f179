"""Queries of sources, stores, report rows and watches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import text as X
from tracewell.functions.deps import extract
from tracewell.operators import audits as A
from tracewell.operators.report import latest_two, once
from tracewell.operators.snapshots import hex_number, latest_delivery
from tracewell.plans.posture_queries import _texts
from tracewell.session import table
from tracewell.sinks import renderers as O
from tracewell.sources import readers as I
from tracewell.streaming import watch as W


def _findings(spark, d):
    return once(table(spark, d, "findings"))


def q_lines(spark, d):
    """Lines of each document that are not over the cap, with their number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return I.lines(docs).groupBy(F.col("key").alias("doc_id")).agg(F.count(F.lit(1)).alias("lines"), F.max("line").alias("last"), F.sum(F.length("text")).alias("chars"))


def q_file_kinds(spark, d):
    """Indexed files and findings' paths by the kind of their extension."""
    p = table(spark, d, "files").select("path").unionByName(table(spark, d, "findings").select("path")).where("path IS NOT NULL").distinct()
    return p.groupBy(I.kind_of(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def q_selected(spark, d):
    """Indexed files that findings name, as a list of changed files selects them."""
    f = table(spark, d, "files").where("file_id IS NOT NULL").select("file_id", X.plain_path(F.col("path")).alias("path")).distinct()
    named = table(spark, d, "findings").where("path IS NOT NULL").select(X.plain_path(F.col("path")).alias("path"))
    return I.selected(f, named).select("file_id", "path")


def q_indicators(spark, d):
    """Digests, addresses and domains as an indicator list, by kind."""
    v = table(spark, d, "file_sigs").select(F.lower("sha256").alias("value")).unionByName(table(spark, d, "domain_snaps").select(F.explode("addrs").alias("value"))).unionByName(table(spark, d, "responses").select(F.col("url").alias("value")))
    return I.indicators(v.where("value IS NOT NULL")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def q_grep(spark, d):
    """The first hundred findings whose excerpt matches: a report of that length."""
    f = _findings(spark, d).where("excerpt IS NOT NULL").select("finding_id", "excerpt")
    return I.grep(f, "excerpt", pattern=r"curl|wget", most=100, order=["finding_id"]).select("finding_id", "shown")


def q_search_records(spark, d):
    """The newest fifty findings that hold a word, as records of a store."""
    r = _findings(spark, d).where("recorded_at IS NOT NULL").select(F.col("finding_id").alias("id"), F.col("rule_id").alias("key"), F.col("message").alias("body"), F.col("recorded_at").alias("ts"))
    return O.search_records(r, "Shell", 50).select("id", "key")


def q_upsert(spark, d):
    """Scans as they were, with those counted as known put over them."""
    s = table(spark, d, "scans").groupBy("scan_id").agg(F.max("root").alias("root"), F.max("baselined").alias("known"))
    new = s.where("known IS NOT NULL").select("scan_id", F.lit("counted").alias("root"), (F.col("known") + 1).alias("known"))
    return O.upsert(s, new, ["scan_id"])


def q_insert_ignore(spark, d):
    """Edges from targets to rules: known ones stay."""
    f = table(spark, d, "findings")
    old = f.where("severity_rank >= 3").select(F.col("target").alias("a"), F.col("rule_id").alias("b")).distinct().withColumn("since", F.lit("old"))
    new = f.select(F.col("target").alias("a"), F.col("rule_id").alias("b"), F.lit("new").alias("since"))
    return O.insert_ignore(old, new, ["a", "b"]).groupBy("since").agg(F.count(F.lit(1)).alias("n"))


def q_override(spark, d):
    """Messages of rules: the latest finding's, at the place of the first."""
    f = _findings(spark, d).select("rule_id", "finding_id", "message")
    return I.override(f, "rule_id", "finding_id").select("rule_id", F.col("finding_id").alias("place"), "message")


def q_cyclonedx(spark, d):
    """Components of the lock files, as an inventory holds them."""
    return O.cyclonedx_components(extract(table(spark, d, "files").select(F.col("file_id").alias("key"), "path", "text"))).select("value")


def q_code_climate(spark, d):
    """Findings by the severity and identity they have in Code Climate reports."""
    v = O.code_climate(_findings(spark, d)).select(F.get_json_object("value", "$.severity").alias("severity"), F.get_json_object("value", "$.fingerprint").alias("fingerprint"))
    return v.groupBy("severity", "fingerprint").agg(F.count(F.lit(1)).alias("n"))


def q_vex_statements(spark, d):
    return O.vex_statements(_findings(spark, d))


def q_baseline_rows(spark, d):
    """Accepted fingerprints."""
    return O.baseline(_findings(spark, d)).select("fp", "fp_content")


def q_dmarc(spark, d):
    return A.dmarc(_texts(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _latest_and_before(spark, d):
    """Agent files (root, path, sha256) of each root's latest snapshot and of the one before."""
    named = table(spark, d, "file_sigs").where("root IS NOT NULL AND path IS NOT NULL AND snap_no IS NOT NULL").select("root", X.plain_path(F.col("path")).alias("path"), "snap_no", "loaded_at", hex_number(F.col("sha256")).alias("sha256"))
    rows = latest_delivery(named, ["root", "path", "snap_no"], "loaded_at", ["sha256"])
    w = Window.partitionBy("root").orderBy(F.desc("snap_no"))
    age = rows.select("root", "snap_no").distinct().withColumn("age", F.row_number().over(w)).where("age <= 2")
    both = rows.join(age, ["root", "snap_no"])
    return [both.where(F.col("age") == k).select("root", "path", "sha256") for k in (1, 2)]


def q_tripwire(spark, d):
    """What a watch of agent files tells at each root's latest snapshot."""
    now, before = _latest_and_before(spark, d)
    events, _ = W.tripwire(before.where("sha256 IS NOT NULL"), now)
    return events.groupBy("change", "id", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_new_findings(spark, d):
    """What a watch of findings tells at each target's latest scan: fingerprints that the scan before did not have."""
    two = latest_two(table(spark, d, "scans"))
    f = _findings(spark, d).where("fp IS NOT NULL").select("scan_id", "fp").join(two, "scan_id").select(F.col("root").alias("repo"), "fp", "age")
    events, _ = W.new_findings()(f.where("age = 2").select("repo", "fp").distinct(), f.where("age = 1").select("repo", "fp"))
    return events.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def q_known_union(spark, d):
    """How many fingerprints are known of each target after all its scans, as a daemon unites them."""
    f = _findings(spark, d).where("fp IS NOT NULL AND target IS NOT NULL").select(F.col("target").alias("repo"), "fp", "scan_id")
    lo = f.groupBy("repo").agg(F.min("scan_id").alias("first"))
    g = f.join(lo, "repo")
    events, after = W.union_of_scans(g.where("scan_id = first").select("repo", "fp").distinct(), g.where("scan_id > first").select("repo", "fp"))
    return after.groupBy("repo").agg(F.count(F.lit(1)).alias("known")).join(events.groupBy("repo").agg(F.count(F.lit(1)).alias("new")), "repo", "left")


def q_report_top(spark, d):
    """The first two hundred findings in report order: a report of that length."""
    from tracewell.operators.report import in_report_order

    return in_report_order(_findings(spark, d).withColumn("message", F.concat_ws(" ", "message", F.lpad(F.col("finding_id").cast("string"), 12, "0")))).limit(200).select("finding_id")


def q_digests(spark, d):
    """The digest over all fingerprints of the findings, and their number."""
    from tracewell.operators.report import digests

    return digests(_findings(spark, d))


def q_first_seen(spark, d):
    """The kinds of events of each user in the order they were first seen."""
    from tracewell.operators.events import first_seen

    return first_seen(table(spark, d, "events"), "user_id", "event_type", "ts").select("user_id", "event_type", "place")


def q_inventory(spark, d):
    """Packages, names and files of each ecosystem in the indexed files."""
    from tracewell.functions.deps import inventory

    return inventory(table(spark, d, "files").dropDuplicates(["file_id"]).select(F.col("file_id").alias("key"), "path", "text"))


def q_redacted_config(spark, d):
    """Findings whose excerpt changes when it is redacted as a configuration."""
    f = _findings(spark, d).where("excerpt IS NOT NULL").select("finding_id", "excerpt", X.redact_config(F.col("excerpt")).alias("redacted"))
    return f.where("excerpt <> redacted").select("finding_id", "redacted")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_ONCE = "f AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY recorded_at DESC NULLS LAST) = 1)"
_PATH = "regexp_replace(replace(path, chr(92), '/'), '^(\\./+)+', '')"
_RANK = "list_position(['info','low','medium','high','critical'], lower(trim(severity)))"
_TXT = "t AS (SELECT regexp_replace(lower(trim(domain_name)), '\\.$', '') AS domain, snap_no, min(txt) AS txt FROM domain_snaps GROUP BY ALL)"
_DEPS = """WITH f AS (SELECT file_id, any_value(replace(path, chr(92), '/')) AS path, any_value(text) AS text FROM files GROUP BY file_id),
  x AS (SELECT unnest(regexp_extract_all(text, '"([a-z]+)": \\{"version": "[^"]+"', 1)) AS name, unnest(regexp_extract_all(text, '"[a-z]+": \\{"version": "([^"]+)"', 1)) AS version FROM f WHERE regexp_matches(path, '(?:package-lock\\.json|go\\.sum|uv\\.lock|Cargo\\.lock)$'))"""
_WIRE = " ".join("WHEN regexp_matches(path, '{}') THEN '{}'".format(rx, i) for i, _, rx in W.TRIPWIRES)
_WSEV = " ".join("WHEN regexp_matches(path, '{}') THEN '{}'".format(rx, s) for _, s, rx in W.TRIPWIRES)

ORACLE = {
    "q_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, count(*) AS lines, CAST(max(n) AS INTEGER) AS last, CAST(sum(length(l)) AS BIGINT) AS chars FROM l WHERE strlen(l) <= 1048576 GROUP BY doc_id""",
    "q_file_kinds": """WITH p AS (SELECT path FROM files UNION SELECT path FROM findings), e AS (SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM p WHERE path IS NOT NULL)
        SELECT CASE WHEN x IN ('csv', 'tsv', 'json') THEN x WHEN x IN ('jsonl', 'ndjson') THEN 'jsonl' WHEN x IN ('sqlite', 'sqlite3', 'db') THEN 'sqlite' ELSE 'text' END AS kind, count(*) AS n FROM e GROUP BY 1""",
    "q_selected": f"SELECT DISTINCT file_id, {_PATH} AS path FROM files WHERE file_id IS NOT NULL AND {_PATH} IN (SELECT {_PATH} FROM findings WHERE path IS NOT NULL)",
    "q_indicators": """WITH v AS (SELECT lower(sha256) AS v FROM file_sigs UNION ALL SELECT unnest(addrs) FROM domain_snaps UNION ALL SELECT url FROM responses),
        t AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(regexp_replace(v, '\\[\\.\\]|\\(\\.\\)', '.', 'g'), '(?i)^hxxp', 'http'), '#.*$', '')) AS v FROM v WHERE v IS NOT NULL)
        SELECT CASE WHEN regexp_matches(v, '^[0-9a-fA-F]{64}$') THEN 'sha256' WHEN regexp_matches(v, '^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$') THEN 'ip' WHEN regexp_matches(v, '^https?://') THEN 'url' WHEN regexp_matches(v, '^(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}$') THEN 'domain'
          WHEN regexp_matches(v, '^[0-9a-fA-F]{32}$|^[0-9a-fA-F]{40}$') THEN 'hash' WHEN contains(v, '/') THEN 'path' ELSE 'string' END AS kind, count(*) AS n FROM t WHERE v <> '' GROUP BY 1""",
    "q_grep": f"""WITH {_ONCE}, g AS (SELECT finding_id, trim(regexp_replace(excerpt, '\\s+', ' ', 'g')) AS s FROM f WHERE regexp_matches(excerpt, 'curl|wget') ORDER BY finding_id LIMIT 100)
        SELECT finding_id, CASE WHEN length(s) > 240 THEN left(s, 240) || '...' ELSE s END AS shown FROM g""",
    "q_search_records": f"WITH {_ONCE} SELECT finding_id AS id, rule_id AS key FROM f WHERE recorded_at IS NOT NULL AND (contains(lower(rule_id), 'shell') OR contains(lower(message), 'shell')) ORDER BY recorded_at DESC, finding_id LIMIT 50",
    "q_upsert": "SELECT scan_id, CASE WHEN max(baselined) IS NULL THEN max(root) ELSE 'counted' END AS root, max(baselined) + 1 AS known FROM scans GROUP BY scan_id",
    "q_insert_ignore": "WITH e AS (SELECT target, rule_id, max(severity_rank) AS r FROM findings GROUP BY ALL) SELECT CASE WHEN r >= 3 THEN 'old' ELSE 'new' END AS since, count(*) AS n FROM e GROUP BY 1",
    "q_override": f"WITH {_ONCE} SELECT rule_id, min(finding_id) AS place, arg_max(message, finding_id) AS message FROM f GROUP BY rule_id",
    "q_cyclonedx": _DEPS + """ SELECT DISTINCT '{"type":"library","name":"' || name || '","version":"' || version || '","purl":"pkg:generic/' || name || '@' || version || '"}' AS value FROM x""",
    "q_code_climate": f"""WITH {_ONCE} SELECT ['info', 'minor', 'major', 'critical', 'blocker'][{_RANK}] AS severity, left(sha256(concat_ws('|', rule_id, path, coalesce(CAST(line AS VARCHAR), ''))), 16) AS fingerprint, count(*) AS n FROM f GROUP BY ALL""",
    "q_vex_statements": """SELECT DISTINCT '{"vulnerability":{"name":"' || rule_id || '"},"status":"under_investigation"}' AS value FROM findings WHERE rule_id IS NOT NULL""",
    "q_baseline_rows": f"""WITH {_ONCE}, g AS (SELECT left(sha256(rule_id || '|' || {_PATH} || '|' || coalesce(excerpt, '')), 16) AS fp, left(sha256(rule_id || '|' || coalesce(excerpt, '')), 16) AS c FROM f) SELECT fp, min(c) AS fp_content FROM g GROUP BY fp""",
    "q_dmarc": f"WITH {_TXT} SELECT CASE WHEN txt IS NULL THEN 'inconclusive' WHEN len(list_filter(txt, lambda x: regexp_matches(lower(trim(x)), '^v=dmarc1(?:\\s*;|\\s*$)'))) = 0 THEN 'absent' ELSE 'confirmed' END AS status, count(*) AS n FROM t GROUP BY 1",
    "q_tripwire": f"""WITH n AS (SELECT root, {_PATH} AS path, snap_no, loaded_at, regexp_replace(regexp_replace(lower(trim(sha256)), '^0x', ''), '^0+(.)', '\\1') AS sha FROM file_sigs WHERE root IS NOT NULL AND path IS NOT NULL AND snap_no IS NOT NULL),
        s AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY root, path, snap_no ORDER BY loaded_at DESC NULLS LAST, sha DESC) = 1), a AS (SELECT root, snap_no, row_number() OVER (PARTITION BY root ORDER BY snap_no DESC) AS age FROM (SELECT DISTINCT root, snap_no FROM s)),
        c AS (SELECT s.* FROM s JOIN a USING (root, snap_no) WHERE age = 1), p AS (SELECT s.* FROM s JOIN a USING (root, snap_no) WHERE age = 2 AND sha IS NOT NULL),
        j AS (SELECT coalesce(c.root, p.root) AS root, coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN 'removed' WHEN c.sha IS NULL THEN 'unreadable' WHEN p.path IS NULL THEN 'added' WHEN c.sha <> p.sha THEN 'changed' END AS change FROM c FULL JOIN p ON p.root = c.root AND p.path = c.path)
        SELECT change, CASE change WHEN 'unreadable' THEN 'AW-011' WHEN 'removed' THEN 'AW-009' ELSE CASE {_WIRE} ELSE 'AW-010' END END AS id, CASE WHEN change IN ('removed', 'unreadable') THEN 'low' ELSE CASE {_WSEV} ELSE 'info' END END AS severity, count(*) AS n
        FROM j WHERE change IS NOT NULL AND root IN (SELECT root FROM c) AND root IN (SELECT root FROM p) GROUP BY ALL""",
    "q_new_findings": f"""WITH {_ONCE}, s AS (SELECT root, scan_id, row_number() OVER (PARTITION BY root ORDER BY ts DESC, scan_id DESC) AS age FROM (SELECT DISTINCT root, scan_id, ts FROM scans)),
        g AS (SELECT DISTINCT root, age, fp FROM f JOIN s USING (scan_id) WHERE fp IS NOT NULL AND age <= 2)
        SELECT root AS repo, count(*) AS n FROM g WHERE age = 1 AND root IN (SELECT root FROM g WHERE age = 2) AND (root, fp) NOT IN (SELECT (root, fp) FROM g WHERE age = 2) GROUP BY root""",
    "q_report_top": f"WITH {_ONCE}, g AS (SELECT *, concat_ws(' ', message, lpad(CAST(finding_id AS VARCHAR), 12, '0')) AS m FROM f WHERE {_RANK} IS NOT NULL) SELECT finding_id FROM g ORDER BY {_RANK} DESC, path NULLS FIRST, line NULLS FIRST, target NULLS FIRST, rule_id NULLS FIRST, excerpt NULLS FIRST, m LIMIT 200",
    "q_digests": f"""WITH {_ONCE}, g AS (SELECT DISTINCT left(sha256(rule_id || '|' || {_PATH} || '|' || coalesce(excerpt, '')), 16) AS fp FROM f), p AS (SELECT left(fp, 2) AS r, sha256(string_agg(fp, chr(10) ORDER BY fp)) AS d, count(*) AS n FROM g GROUP BY 1)
        SELECT sha256(string_agg(d, chr(10) ORDER BY r)) AS digest, CAST(sum(n) AS BIGINT) AS fingerprints FROM p""",
    "q_first_seen": "SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min(ts), event_type) AS INTEGER) AS place FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type",
    "q_inventory": _DEPS.replace("SELECT unnest(", "SELECT file_id, unnest(", 1) + " SELECT e.ecosystem, count(DISTINCT (name, version)) AS packages, count(DISTINCT name) AS names, count(DISTINCT file_id) AS files FROM x CROSS JOIN (VALUES ('generic'), ('*')) e(ecosystem) GROUP BY e.ecosystem",
    "q_redacted_config": f"""WITH {_ONCE}, r AS (SELECT finding_id, excerpt, regexp_replace(regexp_replace(regexp_replace(excerpt, '([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@\\s:]+(?::[^/@\\s]*)?@', '\\1***@', 'g'), '(?im)^(\\s*[\\w.\\-]*(?:password|passwd|secret|token|api_?key|_auth(?:token)?)[\\w.\\-]*\\s*[=:]\\s*)\\S.*$', '\\1***', 'g'), '(?i)(authorization:\\s*\\w+\\s+)\\S+', '\\1***', 'g') AS redacted FROM f WHERE excerpt IS NOT NULL)
        SELECT finding_id, redacted FROM r WHERE redacted <> excerpt""",
    "q_known_union": f"""WITH {_ONCE}, g AS (SELECT target, fp, min(scan_id) AS s, max(scan_id) AS m FROM f WHERE fp IS NOT NULL AND target IS NOT NULL GROUP BY ALL), lo AS (SELECT target, min(s) AS first FROM g GROUP BY target)
        SELECT target AS repo, count(*) AS known, nullif(count(*) FILTER (s > first), 0) AS new FROM g JOIN lo USING (target) GROUP BY target""",
}
