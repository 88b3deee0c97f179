"""Queries of reachability, commits, posture, remediations and report formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators import commits as C
from tracewell.operators import containers as K
from tracewell.operators import fixes as R
from tracewell.operators import posture as P
from tracewell.operators import reach as H
from tracewell.operators import similarity as S
from tracewell.operators import style as Y
from tracewell.operators.report import once
from tracewell.operators.supply import imports
from tracewell.session import table
from tracewell.sinks import renderers as O


def _files(spark, d):
    f = table(spark, d, "files").where("file_id IS NOT NULL").dropDuplicates(["file_id"])
    return f.select(F.col("file_id").alias("key"), X.plain_path(F.col("path")).alias("path"), "text", "root")


def _commits(spark, d):
    """Commit texts as commits: the signer, the first line, the rest; a source stands for a repository."""
    c = table(spark, d, "documents").where("kind = 'commit' AND text IS NOT NULL")
    signer = lambda g: F.regexp_extract("text", r"Signed-off-by: (.*?) <([^<>]*)>", g)
    return c.select(
        F.coalesce("source", F.lit("unknown")).alias("repo"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("sha"), signer(1).alias("name"), signer(2).alias("email"),
        F.coalesce(F.unix_seconds(F.col("created_at").cast("timestamp")), F.lit(0)).alias("ts"), F.trim(F.substring_index("text", "\n", 1)).alias("subject"), F.col("text").alias("body"),
        F.length("text").cast("long").alias("changed"), F.lit(1).cast("long").alias("files"),
    )


def q_release_gaps(spark, d):
    """Days between the two latest orders of a customer in a priority, as releases of a package."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("ecosystem"), F.col("o_custkey").cast("string").alias("name"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("version"), F.col("o_orderdate").alias("published"))
    return H.release_gaps(o)


def q_symbols_used(spark, d):
    """In how many indexed files some identifiers stand."""
    s = spark.createDataFrame([("A-1", "pkg.cursor"), ("A-1", "strlen"), ("A-2", "IllegalStateException"), ("A-3", "memcpy"), ("A-3", "no_such_symbol"), ("A-4", None)], "advisory string, symbol string")
    return H.symbols_used(s, _files(spark, d).select(F.col("key").alias("path"), "text"))


def q_exploited_products(spark, d):
    """Part names that equal, hold or lie in a product known to be exploited."""
    kev = spark.createDataFrame([("C-1", "Red Widget"), ("C-2", "ring"), ("C-3", "small steel ring pro"), ("C-4", "abc"), ("C-5", None)], "cve string, product string")
    return H.exploited_products(table(spark, d, "part").select(F.col("p_name").alias("name")), kev)


def q_runs_in_window(spark, d):
    """Scans as workflow runs within the days of two compromises of every root."""
    s = table(spark, d, "scans").select(F.col("root").alias("repo"), F.col("scan_id").alias("run_id"), "ts").distinct()
    win = spark.createDataFrame([("ACT-1", "2025-01-05", "2025-01-25"), ("ACT-2", "2025-03-01", "2025-03-01")], "rule_id string, a string, b string")
    f = s.select("repo").distinct().join(F.broadcast(win)).select("repo", "rule_id", F.to_timestamp_ntz("a", F.lit("yyyy-MM-dd")).alias("start"), F.to_timestamp_ntz("b", F.lit("yyyy-MM-dd")).alias("end"))
    return H.runs_in_window(f, s).distinct()


def q_commit_authors(spark, d):
    return C.authors(_commits(spark, d).where("name <> ''"))


def q_self_review(spark, d):
    """Repositories whose commits follow the same author's with a bare verb of repair; the limits are low, as the texts are few."""
    return C.self_review(_commits(spark, d), least=1, hits=0, share=0.0)


def q_ghosts(spark, d):
    return C.ghosts(_commits(spark, d).withColumn("name", F.lower("name")), least=1, authors_least=1, share=0.1)


def q_commit_evidence(spark, d):
    """What the commit texts of each source tell about how it was made."""
    return C.evidence(_commits(spark, d))


def q_hour_stats(spark, d):
    """Lines, bytes and soundness of each hour of events, as hour files."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd-HH").alias("file"), F.col("props").alias("value"))
    return e.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value")).alias("bytes"), F.min(F.get_json_object("value", "$.k").isNotNull()).alias("parsed"))


def q_registrable(spark, d):
    """Responses by the registrable domain of their address."""
    r = table(spark, d, "responses").dropDuplicates(["resp_id"]).select(P.registrable(F.col("url")).alias("domain"))
    return r.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def q_publish(spark, d):
    """Indexed files that should not be published."""
    return P.publish_findings(_files(spark, d)).groupBy("id", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_settings(spark, d):
    """Registry answers read as settings: how many were refused."""
    b = table(spark, d, "raw_bodies").dropDuplicates(["body_id"]).where(F.col("text").rlike(r"^\s*\{") & F.try_parse_json("text").isNotNull())
    return P.settings_findings(b.select(F.col("body_id").alias("key"), F.col("text").alias("json"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _texts(spark, d):
    s = table(spark, d, "domain_snaps").select(F.regexp_replace(F.lower(F.trim("domain_name")), r"\.$", "").alias("domain"), "snap_no", "txt")
    return s.groupBy("domain", "snap_no").agg(F.min("txt").alias("txt"))


def q_bimi(spark, d):
    return P.bimi(_texts(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_dkim(spark, d):
    return P.dkim(_texts(spark, d).withColumn("selector", F.lit("s1"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_host_facts(spark, d):
    """Events as facts of users against a table of checks."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("host"), F.col("event_type").alias("key"), F.round(F.col("value"), 2).cast("string").alias("value"))
    one = e.groupBy("host", "key").agg(F.max("value").alias("value"))
    checks = [("C-1", "high", "click", "gt", "50"), ("C-2", "low", "view", "lt", "10"), ("C-3", "info", "purchase", "missing", ""), ("C-4", "medium", "click", "like", "^9"), ("C-5", "low", "view", "unlike", "[0-4]")]
    return P.host_findings(one, checks).groupBy("id", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_remediations(spark, d):
    """Rewrites of the findings' lines."""
    f = once(table(spark, d, "findings")).select(F.col("finding_id").alias("key"), F.col("excerpt").alias("text"))
    return R.remediations(f).select(F.col("key").alias("finding_id"), "id", "after")


def q_style_report(spark, d):
    return Y.style_report(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "kind")).groupBy("reliability", "code").agg(F.count(F.lit(1)).alias("n"))


def q_annotations(spark, d):
    """Findings as CI annotations."""
    f = once(table(spark, d, "findings")).where("path IS NOT NULL AND message IS NOT NULL")
    return O.annotations(f.withColumn("message", F.concat(F.col("finding_id").cast("string"), F.lit(" "), F.col("message")))).select("value")


def q_markdown(spark, d):
    """Findings as rows of a table, with how often each stands."""
    return O.markdown_rows(once(table(spark, d, "findings"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def q_sarif_levels(spark, d):
    """Findings by the level and rule they have in SARIF."""
    r = O.sarif_results(once(table(spark, d, "findings"))).select(F.get_json_object("value", "$.level").alias("level"), F.get_json_object("value", "$.ruleId").alias("rule_id"))
    return r.groupBy("level", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def q_reachability(spark, d):
    """Packages of fixed names by how the indexed files import them."""
    deps = spark.createDataFrame([("npm", "react"), ("npm", "@a/b"), ("PyPI", "PyYAML"), ("Go", "example.com/m")], "ecosystem string, name string")
    f = _files(spark, d).where("path IS NOT NULL").select(F.col("path").alias("key"), "path", "text")
    return H.reachability(deps, imports(f).withColumnRenamed("key", "path"))


def q_container_documents(spark, d):
    """Findings of workflows, compose files and cluster objects among the fetched bodies; the documents are parsed."""
    b = table(spark, d, "raw_bodies").dropDuplicates(["body_id"])
    return K.audit(b.select(F.col("body_id").alias("key"), "text")).select(F.col("key").alias("body_id"), "id", "severity", "place")


def q_vendored(spark, d):
    """Files outside vendored directories against those inside: which are copies of, hold or lie in one (representatives of equal fingerprints)."""
    f = _files(spark, d)
    inside = F.coalesce(F.col("path").rlike(r"(?:^|/)(?:node_modules|vendor|third_party|site-packages|deps)/"), F.lit(False))
    fps = S.fingerprints(f, S.shape_tokens(F.col("text"))).join(f.select("key", inside.alias("v")), "key")
    return S.across(fps.where("NOT v").drop("v"), fps.where("v").drop("v")).select("a", "b", "kind", F.round("jaccard", 6).alias("jaccard"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_F1 = "(SELECT file_id, any_value(replace(path, chr(92), '/')) AS path, any_value(text) AS text FROM files WHERE file_id IS NOT NULL GROUP BY file_id)"
_ONCE = "f AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY recorded_at DESC NULLS LAST) = 1)"
_RANK = "list_position(['info','low','medium','high','critical'], lower(trim(severity)))"
_COMMITS = """c AS (SELECT coalesce(source, 'unknown') AS repo, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS sha, regexp_extract(text, 'Signed-off-by: (.*?) <([^<>]*)>', 1) AS name, regexp_extract(text, 'Signed-off-by: (.*?) <([^<>]*)>', 2) AS email,
  coalesce(CAST(floor(epoch(created_at)) AS BIGINT), 0) AS ts, trim(string_split(text, chr(10))[1]) AS subject, text AS body FROM documents WHERE kind = 'commit' AND text IS NOT NULL)"""
_BARE = "regexp_matches(lower(subject), '^(?:" + "|".join(C.LOOP_VERBS) + ")\\b') AND NOT contains(subject, '(')"
_TXT = "t AS (SELECT regexp_replace(lower(trim(domain_name)), '\\.$', '') AS domain, snap_no, min(txt) AS txt FROM domain_snaps GROUP BY ALL)"


def _fix(i: str, rx: str, to: str) -> str:
    to = to.replace("$1", "\\1").replace("'", "''")
    rx = rx.replace("'", "''")
    return f"SELECT finding_id, '{i}' AS id, regexp_replace(l, '{rx}', '{to}', 'g') AS after, l FROM l WHERE regexp_matches(l, '{rx}')"


ORACLE = {
    "q_release_gaps": """WITH o AS (SELECT DISTINCT o_orderpriority AS ecosystem, CAST(o_custkey AS VARCHAR) AS name, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS version, o_orderdate AS p FROM orders WHERE o_orderdate IS NOT NULL),
        w AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY p DESC, version DESC) AS r, lead(p) OVER (PARTITION BY ecosystem, name ORDER BY p DESC, version DESC) AS q FROM o)
        SELECT ecosystem, name, version, CAST(date_diff('day', CAST(q AS DATE), CAST(p AS DATE)) AS INTEGER) AS gap_days FROM w WHERE r = 1 AND q IS NOT NULL""",
    "q_symbols_used": f"""WITH w AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(text, '[A-Za-z_$][\\w$]*')) AS w FROM {_F1}), s AS (SELECT * FROM (VALUES ('A-1', 'pkg.cursor', 'cursor'), ('A-1', 'strlen', 'strlen'), ('A-2', 'IllegalStateException', 'IllegalStateException'), ('A-3', 'memcpy', 'memcpy'), ('A-3', 'no_such_symbol', 'no_such_symbol')) t(advisory, symbol, w))
        SELECT advisory, symbol, count(DISTINCT file_id) AS files FROM s JOIN w USING (w) GROUP BY ALL""",
    "q_exploited_products": """WITH a AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS x FROM part), b AS (SELECT cve, regexp_replace(lower(product), '[^a-z0-9]', '', 'g') AS y FROM (VALUES ('C-1', 'Red Widget'), ('C-2', 'ring'), ('C-3', 'small steel ring pro'), ('C-4', 'abc')) t(cve, product))
        SELECT DISTINCT name, cve FROM a, b WHERE length(x) >= 4 AND length(y) >= 4 AND (contains(x, y) OR contains(y, x))""",
    "q_runs_in_window": """WITH w AS (SELECT * FROM (VALUES ('ACT-1', TIMESTAMP '2025-01-05', TIMESTAMP '2025-01-25'), ('ACT-2', TIMESTAMP '2025-03-01', TIMESTAMP '2025-03-01')) t(rule_id, a, b))
        SELECT DISTINCT root AS repo, scan_id AS run_id, rule_id, 'RUNCHECK-001' AS id FROM scans, w WHERE ts BETWEEN a AND b""",
    "q_commit_authors": f"WITH {_COMMITS} SELECT name, lower(email) AS email, count(*) AS commits FROM c WHERE name <> '' GROUP BY ALL",
    "q_self_review": f"WITH {_COMMITS}, s AS (SELECT *, {_BARE} AND lag(email) OVER (PARTITION BY repo ORDER BY ts, sha) = email AS l FROM c) SELECT repo, count(*) AS commits, count(*) FILTER (l) AS loops FROM s GROUP BY repo",
    "q_ghosts": f"""WITH {_COMMITS}, p AS (SELECT repo, lower(name) AS name, count(*) AS n, max(ts) - min(ts) AS span FROM c GROUP BY ALL)
        SELECT repo, CAST(sum(n) AS BIGINT) AS commits, count(*) AS authors, count(*) FILTER (regexp_matches(name, '^[a-z0-9_-]+$') AND span <= 30 * 86400) AS ghosts FROM p GROUP BY repo HAVING ghosts >= 0.1 * authors""",
    "q_hour_stats": "SELECT strftime(ts, '%Y-%m-%d-%H') AS file, count(*) AS lines, CAST(sum(strlen(props)) AS BIGINT) AS bytes, bool_and(json_extract(props, '$.k') IS NOT NULL) AS parsed FROM events GROUP BY 1",
    "q_registrable": """WITH h AS (SELECT regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://', ''), '[/:?#].*$', ''), '\\.$', '') AS h FROM (SELECT resp_id, any_value(url) AS url FROM responses GROUP BY resp_id))
        SELECT nullif(CASE WHEN regexp_matches(h, '^[\\d.]+$') THEN '' WHEN regexp_matches(h, '[^.]+\\.(co|com|net|org|gov|edu|ac|or|ne|go)\\.[a-z]{2}$') THEN regexp_extract(h, '([^.]+\\.(?:co|com|net|org|gov|edu|ac|or|ne|go)\\.[a-z]{2})$', 1) ELSE regexp_extract(h, '([^.]+\\.[a-z][a-z0-9\\-]*)$', 1) END, '') AS domain, count(*) AS n FROM h GROUP BY 1""",
    "q_publish": f"""WITH p AS (SELECT regexp_replace(path, '^(\\./+)+', '') AS p FROM {_F1}), i AS (
          SELECT unnest([CASE WHEN (regexp_matches(p, '(?i)(?:^|/)(?:\\.env(?:\\.[\\w-]+)?|id_(?:rsa|dsa|ecdsa|ed25519)|[^/]+\\.(?:pem|p12|pfx|keystore)|\\.npmrc|\\.netrc|\\.pypirc)$') AND NOT regexp_matches(p, '(?i)\\.env\\.(?:example|sample|template)$')) THEN 'PUB-001' END,
            CASE WHEN regexp_matches(p, '(?i)(?:^|/)(?:\\.git|\\.svn|\\.hg)/|\\.(?:sqlite3?|db|sql|bak|dump)$') THEN 'PUB-002' END, CASE WHEN regexp_matches(p, '(?i)(?:^|/)(?:\\.DS_Store|Thumbs\\.db|npm-debug\\.log|\\.idea/.*|\\.vscode/.*)$') THEN 'PUB-003' END]) AS id FROM p)
        SELECT id, CASE id WHEN 'PUB-001' THEN 'critical' WHEN 'PUB-002' THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM i WHERE id IS NOT NULL GROUP BY ALL""",
    "q_settings": "WITH b AS (SELECT body_id, any_value(text) AS text FROM raw_bodies GROUP BY body_id) SELECT 'RST-000' AS id, count(*) AS n FROM b WHERE json_valid(text) AND regexp_matches(text, '^\\s*\\{') AND json_extract_string(text, '$.message') IS NOT NULL HAVING count(*) > 0",
    "q_bimi": f"WITH {_TXT} SELECT CASE WHEN txt IS NULL THEN 'inconclusive' WHEN len(list_filter(txt, lambda x: starts_with(lower(trim(x)), 'v=bimi1'))) = 0 THEN 'absent' ELSE 'confirmed' END AS status, count(*) AS n FROM t GROUP BY 1",
    "q_dkim": f"WITH {_TXT} SELECT CASE WHEN txt IS NULL THEN 'inconclusive' WHEN len(list_filter(txt, lambda x: regexp_matches(lower(x), '(?:^|;)\\s*(?:v=dkim1|k=|p=)'))) = 0 THEN 'absent' ELSE 'confirmed' END AS status, count(*) AS n FROM t GROUP BY 1",
    "q_host_facts": """WITH o AS (SELECT user_id, event_type, max(CAST(CAST(round(value, 2) AS DOUBLE) AS VARCHAR)) AS v FROM events GROUP BY ALL),
        x AS (SELECT 'C-1' AS id, 'high' AS severity FROM o WHERE event_type = 'click' AND CAST(v AS DOUBLE) > 50 UNION ALL SELECT 'C-2', 'low' FROM o WHERE event_type = 'view' AND CAST(v AS DOUBLE) < 10 UNION ALL SELECT 'C-3', 'info' FROM (SELECT DISTINCT user_id FROM o) WHERE user_id NOT IN (SELECT user_id FROM o WHERE event_type = 'purchase')
          UNION ALL SELECT 'C-4', 'medium' FROM o WHERE event_type = 'click' AND starts_with(v, '9') UNION ALL SELECT 'C-5', 'low' FROM o WHERE event_type = 'view' AND NOT regexp_matches(v, '[0-4]'))
        SELECT id, severity, count(*) AS n FROM x GROUP BY ALL""",
    "q_remediations": f"WITH {_ONCE}, l AS (SELECT finding_id, unnest(string_split(excerpt, chr(10))) AS l FROM f WHERE excerpt IS NOT NULL) SELECT finding_id, id, after FROM (" + " UNION ALL ".join(_fix(*r) for r in R.REWRITES) + ") WHERE after <> l",
    "q_style_report": """WITH x AS (SELECT len(regexp_extract_all(text, '[\\p{L}]+')) AS w, len(string_split(text, chr(10))) AS l, coalesce(kind = 'code', false) AS code FROM documents WHERE text IS NOT NULL)
        SELECT CASE WHEN (CASE WHEN code THEN l ELSE w END) < (CASE WHEN code THEN 40 ELSE 200 END) THEN 'too short' WHEN (CASE WHEN code THEN l ELSE w END) < (CASE WHEN code THEN 150 ELSE 1000 END) THEN 'fair' ELSE 'good' END AS reliability, code, count(*) AS n FROM x GROUP BY ALL""",
    "q_annotations": f"""WITH {_ONCE}, g AS (SELECT ['notice', 'notice', 'warning', 'error', 'error'][{_RANK}] AS l, replace(replace(replace(replace(replace(path, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS p, coalesce(line, 1) AS n,
          replace(replace(replace(replace(replace(rule_id, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS r, replace(replace(replace(CAST(finding_id AS VARCHAR) || ' ' || message, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS m FROM f WHERE path IS NOT NULL AND message IS NOT NULL)
        SELECT '::' || l || ' file=' || p || ',line=' || n || ',title=' || r || '::' || m AS value FROM g""",
    "q_markdown": f"""WITH {_ONCE}, c AS (SELECT lower(severity) AS s, rule_id AS r, regexp_replace(replace(coalesce(path, '') || coalesce(':' || line, ''), '|', '\\|'), '[\\r\\n]+', ' ', 'g') AS p, left(regexp_replace(replace(coalesce(message, ''), '|', '\\|'), '[\\r\\n]+', ' ', 'g'), 200) AS m FROM f)
        SELECT '| ' || s || ' | ' || r || ' | ' || p || ' | ' || m || ' |' AS value, count(*) AS n FROM c GROUP BY 1""",
    "q_sarif_levels": f"WITH {_ONCE} SELECT ['note', 'warning', 'warning', 'error', 'error'][{_RANK}] AS level, rule_id, count(*) AS n FROM f GROUP BY ALL",
}
