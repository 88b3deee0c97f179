"""Queries of supply chain, audits and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.deps import extract
from tracewell.operators import audits as A
from tracewell.operators import supply as P
from tracewell.plans import snapshot_queries
from tracewell.plans.snapshot_queries import p1_found
from tracewell.session import table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")


def _once(df, key):
    return df.dropDuplicates([key])


def _each(rows, values, name):
    return rows.select(F.col("key").alias("doc_id"), F.explode(values).alias(name))


def q_extract_emails(spark, d):
    return _each(_docs(spark, d), X.emails(F.col("text")), "value")


def q_extract_urls(spark, d):
    return _each(_docs(spark, d), X.urls(F.col("text")), "value")


def q_extract_ipv4(spark, d):
    rows = table(spark, d, "domain_snaps").select(F.col("snap_no").alias("key"), F.array_join("addrs", ", ").alias("text"))
    return rows.select(F.col("key").alias("snap_no"), F.explode(X.ipv4s(F.col("text"))).alias("value")).distinct()


def q_extract_hashes(spark, d):
    return _each(_docs(spark, d), X.hashes(F.col("text")), "value")


def q_extract_wallets(spark, d):
    return _each(_docs(spark, d), X.wallets(F.col("text")), "value")


def q_public_addresses(spark, d):
    """Addresses of watched domains with their number and whether they are public."""
    a = table(spark, d, "domain_snaps").select(F.explode("addrs").alias("a")).select(F.trim("a").alias("ip")).distinct()
    return a.select("ip", X.ip_number(F.col("ip")).alias("n"), X.public_ip(F.col("ip")).alias("public"))


def q_zero_width(spark, d):
    return _docs(spark, d).select(F.col("key").alias("doc_id"), X.zero_width(F.col("text")).alias("n")).where("n > 0")


def q_string_forms(spark, d):
    """Names in the forms that lookups use."""
    p = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("s"))
    return p.select("p_partkey", X.package_name(F.col("s")).alias("normal"), X.camelize(F.col("s")).alias("camel"), X.purl(F.lit("npm"), F.col("s"), F.lit("1.0.0")).alias("purl"), X.mask(F.col("s")).alias("masked"), X.entropy(F.col("s")).alias("entropy"))


def q_version_ranges(spark, d):
    """Versions found in registry answers against ranges over the first letters of names."""
    inst = A.registry_bodies(_once(table(spark, d, "raw_bodies"), "body_id").select(F.col("body_id").alias("key"), "text")).where("form = 'package'").select("key", F.left("name", F.lit(1)).alias("product"), "version")
    adv = spark.createDataFrame([("A-1", "v", [">=2.0 <5.1.3", "=7.0.0"]), ("A-2", "m", ["<3"]), ("A-3", "n", [">9.20", "bad range"]), ("A-4", "k", [])], "id string, product string, affected array<string>")
    return P.affected(inst, adv)


def q_dep_delta_roots(spark, d):
    """Dependencies of each root's index after its newest delivery against the index before, by root, ecosystem and name.

    The index is delivered file by file: a path's last row counts on either side, and a root's first delivery is all new.
    """
    at = F.coalesce("indexed_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    f = table(spark, d, "files").where("path IS NOT NULL").select(F.coalesce("root", F.lit("")).alias("root"), X.plain_path(F.col("path")).alias("path"), at.cast("timestamp_ntz").alias("at"), "file_id", "text")
    f = f.join(f.groupBy("root").agg(F.max("at").alias("newest")), "root")

    def side(rows):
        last = rows.groupBy("root", "path").agg(F.max_by("text", F.struct("at", "file_id")).alias("text"))
        deps = extract(last.select(F.concat_ws("\n", "root", "path").alias("key"), "path", "text"))
        return deps.select(F.substring_index("key", "\n", 1).alias("root"), "ecosystem", "name", "version")

    return P.dep_delta(side(f.where(F.col("at") < F.col("newest"))), side(f), ["root", "ecosystem", "name"])


def q_dependencies(spark, d):
    """Dependencies in lock files and manifests of the indexed files."""
    return extract(table(spark, d, "files").select(F.col("file_id").alias("key"), "path", "text")).select(F.col("key").alias("file_id"), "ecosystem", "name", "version")


def q_sbom_counts(spark, d):
    return P.sbom(extract(table(spark, d, "files").select(F.col("file_id").alias("key"), "path", "text")))


def q_imports(spark, d):
    return P.imports(_once(table(spark, d, "files"), "file_id").select(F.col("file_id").alias("key"), "path", "text")).select(F.col("key").alias("file_id"), "module")


def q_licenses(spark, d):
    f = _once(table(spark, d, "files"), "file_id").select("file_id", P.license_of(F.col("text")).alias("license"))
    return f.groupBy("license").agg(F.count(F.lit(1)).alias("files"), F.max(P.copyleft(F.col("license"))).alias("copyleft"))


def q_typosquats(spark, d):
    """Part names one edit or swap from a popular one."""
    names = table(spark, d, "part").select(F.regexp_replace("p_name", "^(.)(.)(.*)$", "$2$1$3").alias("name"))
    popular = spark.createDataFrame([("red widget", 0), ("small ring", 1), ("blue bolt", 2), ("steel ring", 3)], "name string, pos int")
    return P.typosquats(names, popular)


def q_lookalikes(spark, d):
    names = table(spark, d, "domain_snaps").select(F.regexp_replace(F.lower(F.trim("domain_name")), r"\.$", "").alias("name")).distinct()
    return P.lookalikes(names).groupBy("name", "how").agg(F.count(F.lit(1)).alias("n"))


def q_web_audit(spark, d):
    return A.web_audit(table(spark, d, "responses")).groupBy("id", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_page_fields(spark, d):
    p = _once(table(spark, d, "responses"), "resp_id").select(F.col("resp_id").alias("key"), "body")
    return A.page_fields(p).select(F.col("key").alias("resp_id"), "title", "description", "scripts", "links", "forms")


def q_waf_marks(spark, d):
    p = _once(table(spark, d, "responses"), "resp_id").select(F.col("resp_id").alias("key"), "body")
    return A.marks(p).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


def q_workflows(spark, d):
    f = _once(table(spark, d, "raw_bodies"), "body_id").select(F.col("body_id").alias("key"), F.col("url").alias("path"), "text")
    return A.workflow_audit(f).select(F.col("key").alias("body_id"), "id", "severity")


def q_registry_bodies(spark, d):
    return A.registry_bodies(_once(table(spark, d, "raw_bodies"), "body_id").select(F.col("body_id").alias("key"), "text")).select(F.col("key").alias("body_id"), "form", "name", "version", "digests")


def q_feed_entries(spark, d):
    return A.feed_entries(_once(table(spark, d, "raw_bodies"), "body_id").select(F.col("body_id").alias("key"), "text")).select(F.col("key").alias("body_id"), "pos", "id", "title")


def q_spf(spark, d):
    s = table(spark, d, "domain_snaps").select("snap_no", F.regexp_replace(F.lower(F.trim("domain_name")), r"\.$", "").alias("domain"), "txt", "loaded_at")
    last = s.groupBy("domain", "snap_no").agg(F.max_by("txt", F.struct("loaded_at", F.to_json(F.struct("txt")))).alias("txt"))
    return A.spf(last.select("domain", "txt")).groupBy("status", "policy", "lookups").agg(F.count(F.lit(1)).alias("n"))


def q_egress(spark, d):
    """Addresses of watched domains that no allowance covers."""
    a = table(spark, d, "domain_snaps").select(F.explode("addrs").alias("a")).select(F.trim("a").alias("ip")).distinct().select(F.col("ip").alias("id"), "ip", F.lit(443).alias("port"))
    allow = spark.createDataFrame([("192.0.2.0/25", 443), ("198.51.100.0/24", None), ("203.0.113.7", 443), (None, 22)], "cidr string, port int")
    return A.unexpected_flows(a, allow).select("ip", "port")


def q_posture_findings(spark, d):
    return A.posture_changes(p1_found(spark, d)).groupBy("id", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_expiring(spark, d):
    """Certificates of the last snapshot that end within sixty days of 2025-06-01."""
    s = table(spark, d, "domain_snaps").select(F.regexp_replace(F.lower(F.trim("domain_name")), r"\.$", "").alias("domain"), "cert_not_after", "snap_no").distinct()
    return A.expiring(s, "cert_not_after", F.lit("2025-06-01").cast("date"), 60).select("domain", "snap_no", "days_left").distinct()


def q_kev_epss(spark, d):
    """Advisories read as rules: exploited and scored aliases per finding."""
    f = _once(table(spark, d, "findings"), "finding_id").select("finding_id", F.col("rule_id").alias("advisory"))
    al = spark.createDataFrame([("MAL-001", ["C-1", "C-2"]), ("PHP-002", ["C-3"]), ("JS-001", [])], "advisory string, aliases array<string>")
    kev = spark.createDataFrame([("C-2",), ("JS-001",)], "cve string")
    epss = spark.createDataFrame([("C-1", 0.2, 0.5), ("C-2", 0.7, 0.9), ("C-3", 0.1, 0.4)], "cve string, score double, percentile double")
    return P.enrich(f, al, kev, epss).groupBy("exploited", "score").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_D = "(SELECT doc_id, any_value(text) AS text FROM documents GROUP BY doc_id)"
_DOM = "regexp_replace(lower(trim(domain_name)), '\\.$', '')"


def _ex(pattern: str, f: str = "x", where: str = "true") -> str:
    return f"SELECT DISTINCT doc_id, {f} AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS x FROM documents) WHERE {where}"


_IPOK = "regexp_matches({0}, '^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])\\.){{3}}(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])$')"
_IPN = "(string_split({0}, '.')[1]::BIGINT * 16777216 + string_split({0}, '.')[2]::BIGINT * 65536 + string_split({0}, '.')[3]::BIGINT * 256 + string_split({0}, '.')[4]::BIGINT)"
_BLOCKS = [(0, 8), (10 << 24, 8), ((100 << 24) + (64 << 16), 10), (127 << 24, 8), ((169 << 24) + (254 << 16), 16), ((172 << 24) + (16 << 16), 12), (192 << 24, 24), ((192 << 24) + 512, 24), ((192 << 24) + (168 << 16), 16), ((198 << 24) + (18 << 16), 15), ((198 << 24) + (51 << 16) + (100 << 8), 24), ((203 << 24) + (113 << 8), 24), (224 << 24, 4), (240 << 24, 4)]
_R1 = "(SELECT resp_id, any_value(url) AS url, any_value(body) AS body FROM responses GROUP BY resp_id)"
_B1 = "(SELECT body_id, any_value(text) AS text, any_value(url) AS url FROM raw_bodies GROUP BY body_id)"

_DEPS = """WITH f AS (SELECT file_id, any_value(replace(path, chr(92), '/')) AS path, any_value(text) AS text FROM files GROUP BY file_id),
  x AS (SELECT file_id, unnest(regexp_extract_all(text, '"([a-z]+)": \\{"version": "[^"]+"', 1)) AS name, unnest(regexp_extract_all(text, '"[a-z]+": \\{"version": "([^"]+)"', 1)) AS version FROM f WHERE regexp_matches(path, '(?:package-lock\\.json|go\\.sum|uv\\.lock|Cargo\\.lock)$'))"""

ORACLE = {
    "q_extract_emails": _ex(X.EMAIL, "lower(x)"),
    "q_extract_urls": "SELECT DISTINCT doc_id, regexp_replace(x, '[.,;:!?]+$', '') AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s\"''<>)\\]}`]+')) AS x FROM documents)",
    "q_extract_ipv4": "SELECT DISTINCT snap_no, value FROM (SELECT snap_no, unnest(regexp_extract_all(array_to_string(addrs, ', '), '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b')) AS value FROM domain_snaps) WHERE " + _IPOK.format("value"),
    "q_extract_hashes": _ex(r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b", "lower(x)"),
    "q_extract_wallets": _ex(X.WALLET),
    "q_public_addresses": f"SELECT ip, CASE WHEN {_IPOK.format('ip')} THEN {_IPN.format('ip')} END AS n, coalesce({_IPOK.format('ip')} AND NOT ({' OR '.join(f'{_IPN.format(chr(105) + chr(112))} BETWEEN {lo} AND {lo + (1 << (32 - b)) - 1}' for lo, b in _BLOCKS)}), false) AS public FROM (SELECT DISTINCT trim(unnest(addrs)) AS ip FROM domain_snaps)",
    "q_zero_width": "SELECT doc_id, length(text) - length(translate(text, '" + X.ZERO_WIDTH + "', '')) AS n FROM documents WHERE length(text) <> length(translate(text, '" + X.ZERO_WIDTH + "', ''))",
    "q_licenses": """WITH f AS (SELECT file_id, lower(left(any_value(text), 8192)) AS h FROM files GROUP BY file_id), l AS (SELECT CASE """ + " ".join(f"WHEN contains(h, '{w}') THEN '{n}'" for n, w in P.LICENSES) + """ END AS license FROM f)
        SELECT license, count(*) AS files, bool_or(regexp_matches(license, '(?i)agpl|lgpl|gpl|mpl|epl|eupl|cddl|osl|cc-by-sa')) AS copyleft FROM l GROUP BY license""",
    "q_typosquats": """WITH n AS (SELECT DISTINCT lower(regexp_replace(p_name, '^(.)(.)(.*)$', '\\2\\1\\3')) AS name FROM part), p AS (SELECT * FROM (VALUES ('red widget', 0), ('small ring', 1), ('blue bolt', 2), ('steel ring', 3)) t(nearest, pos))
        SELECT name, nearest, CAST(damerau_levenshtein(name, nearest) AS INTEGER) AS distance FROM n, p WHERE name NOT IN (SELECT nearest FROM p) AND damerau_levenshtein(name, nearest) = 1 QUALIFY row_number() OVER (PARTITION BY name ORDER BY damerau_levenshtein(name, nearest), pos) = 1""",
    "q_string_forms": """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS s FROM part)
        SELECT p_partkey, replace(replace(lower(s), '_', '-'), '.', '-') AS normal, array_to_string(list_transform(string_split(s, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS camel, 'pkg:npm/' || s || '@1.0.0' AS purl,
        CASE WHEN length(s) >= 8 THEN left(s, 4) || '...' || right(s, 3) ELSE s END AS masked, round(list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: -((length(s) - length(replace(s, c, ''))) / CAST(length(s) AS DOUBLE)) * log2((length(s) - length(replace(s, c, ''))) / CAST(length(s) AS DOUBLE)))), 6) AS entropy FROM p""",
    "q_dependencies": _DEPS + " SELECT DISTINCT file_id, 'generic' AS ecosystem, name, version FROM x",
    "q_sbom_counts": _DEPS + " SELECT e.ecosystem, count(*) AS packages, count(DISTINCT name) AS names FROM (SELECT DISTINCT name, version FROM x) CROSS JOIN (VALUES ('generic'), ('*')) e(ecosystem) GROUP BY e.ecosystem",
    "q_posture_findings": f"""SELECT CASE rec_key WHEN 'certs' THEN 'DWATCH-001' WHEN 'ns' THEN 'DWATCH-002' WHEN 'mx' THEN 'DWATCH-003' ELSE CASE change WHEN 'added' THEN 'DWATCH-010' ELSE 'DWATCH-011' END END AS id,
        CASE rec_key WHEN 'ns' THEN 'high' WHEN 'mx' THEN 'medium' ELSE 'info' END AS severity, count(*) AS n FROM ({snapshot_queries.ORACLE['p1_found']}) WHERE kind = 'domain' GROUP BY ALL""",
    "q_workflows": f"""WITH w AS (SELECT body_id, text FROM {_B1} WHERE regexp_matches(text, '(?m)^jobs:'))
        SELECT body_id, id, 'medium' AS severity FROM w CROSS JOIN (VALUES ('WFA-001'), ('WFA-004')) i(id) WHERE CASE id WHEN 'WFA-001' THEN NOT regexp_matches(text, '(?m)^\\s*permissions:') ELSE regexp_matches(text, '(?m)run:[^\\n]*\\$\\{{\\{{\\s*secrets\\.[A-Za-z_]\\w*\\s*\\}}\\}}') END""",
    "q_waf_marks": f"SELECT mark, count(*) AS n FROM {_R1} CROSS JOIN (VALUES " + ", ".join("('{}', '{}')".format(k, rx.replace("'", "''")) for k, rx in A.WAF_MARKS.items()) + ") m(mark, rx) WHERE regexp_matches(body, rx) GROUP BY mark",
    "q_page_fields": f"""SELECT resp_id, nullif(trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(regexp_extract(body, '(?is)<meta\\s+name=["'']description["'']\\s+content=["'']([^"'']*)["'']', 1), '\\s+', ' ', 'g')), '') AS description,
        CAST(len(regexp_extract_all(body, '(?i)<script\\b')) AS INTEGER) AS scripts, CAST(len(regexp_extract_all(body, '(?i)<a\\s[^>]*href=')) AS INTEGER) AS links, CAST(len(regexp_extract_all(body, '(?i)<form\\b')) AS INTEGER) AS forms FROM {_R1} WHERE regexp_matches(body, '(?i)<html|<!doctype html')""",
    "q_registry_bodies": f"""WITH b AS (SELECT body_id, text, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM {_B1} WHERE json_valid(text) AND regexp_matches(text, '^\\s*[{{\\[]'))
        SELECT body_id, CASE WHEN json_extract(j, '$.schemaVersion') IS NOT NULL THEN 'manifest' WHEN json_extract_string(j, '$.name') IS NOT NULL THEN 'package' WHEN json_extract(j, '$.errors') IS NOT NULL OR json_extract_string(j, '$.error') IS NOT NULL THEN 'error' ELSE 'other' END AS form,
        json_extract_string(j, '$.name') AS name, json_extract_string(j, '$.version') AS version, CAST(len(list_distinct(regexp_extract_all(text, 'sha256:[0-9a-f]{{62,64}}'))) AS INTEGER) AS digests FROM b""",
    "q_feed_entries": f"""WITH e AS (SELECT body_id, unnest(regexp_extract_all(text, '(?s)<(?:entry|item)\\b[^>]*>(.*?)</(?:entry|item)>', 1)) AS e, unnest(range(len(regexp_extract_all(text, '(?s)<(?:entry|item)\\b[^>]*>(.*?)</(?:entry|item)>')))) AS pos FROM {_B1} WHERE regexp_matches(text, '<(?:feed|rss)\\b'))
        SELECT body_id, CAST(pos AS INTEGER) AS pos, regexp_extract(e, '(?s)<(?:id|guid)[^>]*>(.*?)</(?:id|guid)>', 1) AS id, regexp_extract(e, '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM e""",
    "q_egress": f"""WITH a AS (SELECT DISTINCT trim(unnest(addrs)) AS ip FROM domain_snaps), n AS (SELECT ip, CASE WHEN {_IPOK.format('ip')} THEN {_IPN.format('ip')} END AS n FROM a)
        SELECT ip, 443 AS port FROM n WHERE NOT coalesce((n BETWEEN {(192 << 24) + 512} AND {(192 << 24) + 512 + 127} OR n BETWEEN {(198 << 24) + (51 << 16) + (100 << 8)} AND {(198 << 24) + (51 << 16) + (100 << 8) + 255} OR n = {(203 << 24) + (113 << 8) + 7}), false)""",
    "q_kev_epss": """WITH f AS (SELECT finding_id, any_value(rule_id) AS r FROM findings GROUP BY finding_id), g AS (SELECT CASE r WHEN 'MAL-001' THEN true WHEN 'PHP-002' THEN false WHEN 'JS-001' THEN true END AS exploited, CASE r WHEN 'MAL-001' THEN 0.7::DOUBLE WHEN 'PHP-002' THEN 0.1::DOUBLE END AS score FROM f) SELECT exploited, score, count(*) AS n FROM g GROUP BY ALL""",
    "q_version_ranges": f"""WITH b AS (SELECT body_id AS key, left(lower(json_extract_string(text, '$.name')), 1) AS product, json_extract_string(text, '$.version') AS version FROM {_B1} WHERE json_valid(text) AND json_extract(text, '$.schemaVersion') IS NULL AND json_extract_string(text, '$.name') IS NOT NULL),
        v AS (SELECT *, list_transform(string_split(version, '.'), lambda x: TRY_CAST(x AS BIGINT)) AS v FROM b WHERE regexp_matches(version, '^[0-9]+\\.[0-9]+\\.[0-9]+$'))
        SELECT key, product, version, 'A-1' AS advisory FROM v WHERE product = 'v' AND ((v >= [2, 0, 0] AND v < [5, 1, 3]) OR v = [7, 0, 0]) UNION ALL SELECT key, product, version, 'A-2' FROM v WHERE product = 'm' AND v < [3, 0, 0] UNION ALL SELECT key, product, version, 'A-3' FROM v WHERE product = 'n' AND v > [9, 20, 0]""",
    "q_expiring": f"SELECT DISTINCT {_DOM} AS domain, snap_no, CAST(date_diff('day', DATE '2025-06-01', TRY_CAST(left(cert_not_after, 10) AS DATE)) AS INTEGER) AS days_left FROM domain_snaps WHERE date_diff('day', DATE '2025-06-01', TRY_CAST(left(cert_not_after, 10) AS DATE)) <= 60",
}
_H = "map_from_entries(list_transform(map_entries(headers), lambda e: {'k': lower(e.key), 'v': lower(e.value)}))"
_WEB = """WITH r AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY resp_id ORDER BY loaded_at DESC NULLS LAST, fetched_at DESC NULLS LAST) = 1),
  h AS (SELECT *, coalesce(""" + _H + """, MAP {}) AS h, lower(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, starts_with(lower(url), 'https:') AS https FROM r),
  x AS (SELECT resp_id, unnest([
    {'i': 'WEB-001', 's': 'high', 'c': https AND starts_with(lower(final_url), 'http:')}, {'i': 'WEB-010', 's': 'medium', 'c': h['content-security-policy'] IS NULL}, {'i': 'WEB-011', 's': 'low', 'c': h['x-content-type-options'] IS NULL},
    {'i': 'WEB-012', 's': 'low', 'c': h['x-frame-options'] IS NULL AND NOT coalesce(contains(h['content-security-policy'], 'frame-ancestors'), false)}, {'i': 'WEB-013', 's': 'low', 'c': h['referrer-policy'] IS NULL}, {'i': 'WEB-014', 's': 'low', 'c': h['permissions-policy'] IS NULL},
    {'i': 'WEB-015', 's': 'medium', 'c': https AND (h['strict-transport-security'] IS NULL OR regexp_matches(h['strict-transport-security'], 'max-age=0\\b'))}, {'i': 'WEB-017', 's': 'high', 'c': h['access-control-allow-origin'] = '*' AND coalesce(h['access-control-allow-credentials'] = 'true', false)},
    {'i': 'WEB-019', 's': 'medium', 'c': regexp_matches(h['content-security-policy'], 'unsafe-(?:inline|eval)')}, {'i': 'WEB-020', 's': 'low', 'c': h['set-cookie'] IS NOT NULL AND NOT (contains(h['set-cookie'], 'httponly') AND contains(h['set-cookie'], 'secure'))},
    {'i': 'WEB-021', 's': 'info', 'c': h['cross-origin-opener-policy'] IS NULL AND h['cross-origin-embedder-policy'] IS NULL}, {'i': 'WEB-022', 's': 'low', 'c': h['access-control-allow-origin'] = '*' AND NOT coalesce(h['access-control-allow-credentials'] = 'true', false)}, {'i': 'WEB-023', 's': 'medium', 'c': h['access-control-allow-origin'] = 'null'},
    {'i': 'WEB-025', 's': 'high', 'c': regexp_matches(body, '(?i)<form[^>]+action=["'']?http://')}, {'i': 'WEB-026', 's': 'low', 'c': regexp_matches(title, '^\\s*index of /')}, {'i': 'WEB-027', 's': 'medium', 'c': regexp_matches(body, 'Traceback \\(most recent call last\\)|java\\.lang\\.[A-Za-z]+Exception|panic: runtime error|</b> on line <b>')},
    {'i': 'WEB-028', 's': 'medium', 'c': https AND regexp_matches(body, '(?i)<(?:script|img|iframe|link)[^>]+(?:src|href)=["'']?http://')}, {'i': 'WEB-029', 's': 'low', 'c': h['set-cookie'] IS NOT NULL AND regexp_matches(h['cache-control'], 'public|max-age=[1-9]')}, {'i': 'WEB-044', 's': 'medium', 'c': regexp_matches(h['set-cookie'], 'samesite=none') AND NOT contains(h['set-cookie'], 'secure')},
    {'i': 'WEB-050', 's': 'high', 'c': regexp_matches(body, '(?i)(?:api_?key|secret|token|passw(?:or)?d)["'']?\\s*[:=]\\s*["''][A-Za-z0-9+/_\\-]{16,}["'']')}, {'i': 'WEB-060', 's': 'info', 'c': regexp_matches(body, '(?is)<meta\\s+name=["'']description["'']\\s+content=["'']\\s*[-–—]')}, {'i': 'WEB-061', 's': 'info', 'c': regexp_matches(body, '(?i)<meta[^>]+name=["'']?generator')}, {'i': 'WEB-062', 's': 'info', 'c': regexp_matches(title, 'admin|debug|dashboard|phpinfo')}
  ]) AS k FROM h)
  SELECT k.i AS id, k.s AS severity, count(*) AS n FROM x WHERE k.c GROUP BY ALL"""
_SPF = f"""WITH s AS (SELECT {_DOM} AS domain, snap_no, txt FROM domain_snaps QUALIFY row_number() OVER (PARTITION BY {_DOM}, snap_no ORDER BY loaded_at DESC NULLS LAST, CAST(txt AS VARCHAR) DESC) = 1),
  r AS (SELECT txt, list_filter(txt, lambda x: regexp_matches(lower(trim(x)), '^v=spf1(?:\\s|$)')) AS recs FROM s), t AS (SELECT *, list_filter(regexp_split_to_array(lower(trim(recs[1])), '\\s+'), lambda x: x <> 'v=spf1') AS terms FROM r),
  u AS (SELECT *, len(list_filter(terms, lambda x: regexp_matches(x, '^[+?~-]?(?:a|mx|ptr|exists|include)(?:[:/]|$)|^redirect='))) AS lookups, list_filter(terms, lambda x: regexp_matches(x, '^[+?~-]?all$')) AS alls FROM t),
  v AS (SELECT CASE WHEN txt IS NULL THEN 'inconclusive' WHEN len(recs) = 0 THEN 'absent' WHEN len(recs) > 1 OR lookups > 10 THEN 'error' ELSE 'confirmed' END AS status,
    CASE WHEN len(recs) = 1 THEN CASE WHEN len(alls) > 0 THEN CASE WHEN alls[1] = 'all' THEN '+all' ELSE alls[1] END WHEN len(list_filter(terms, lambda x: starts_with(x, 'redirect='))) > 0 THEN 'redirect' ELSE 'neutral' END END AS policy, CAST(CASE WHEN len(recs) = 1 THEN lookups END AS INTEGER) AS lookups FROM u)
  SELECT status, policy, lookups, count(*) AS n FROM v GROUP BY ALL"""
_IMPORTS = """WITH f AS (SELECT file_id, any_value(path) AS path, any_value(text) AS text FROM files GROUP BY file_id), e AS (SELECT file_id, text, lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) AS x FROM f),
  m AS (SELECT file_id, unnest(CASE WHEN x IN ('js', 'ts', 'jsx', 'tsx', 'mjs', 'cjs') THEN regexp_extract_all(text, '(?:require\\(\\s*|from\\s+)["''](@?[A-Za-z0-9_][\\w./-]*)["'']', 1) WHEN x = 'py' THEN list_concat(regexp_extract_all(text, '(?m)^\\s*(?:from\\s+([A-Za-z_][\\w]*)|import\\s+([A-Za-z_][\\w]*))', 1), regexp_extract_all(text, '(?m)^\\s*(?:from\\s+([A-Za-z_][\\w]*)|import\\s+([A-Za-z_][\\w]*))', 2))
    WHEN x = 'go' THEN regexp_extract_all(text, '(?m)^\\s*(?:import\\s+)?"([\\w.-]+\\.[\\w./-]+)"', 1) WHEN x = 'rb' THEN regexp_extract_all(text, '(?m)^\\s*require\\s+["'']([\\w/-]+)["'']', 1) WHEN x = 'rs' THEN regexp_extract_all(text, '(?m)^\\s*use\\s+([a-z_][\\w]*)::', 1) WHEN x = 'java' THEN regexp_extract_all(text, '(?m)^\\s*import\\s+(?:static\\s+)?([\\w.]+);', 1) END) AS module FROM e)
  SELECT DISTINCT file_id, module FROM m WHERE module <> ''"""
ORACLE |= {"q_web_audit": _WEB, "q_spf": _SPF, "q_imports": _IMPORTS}
_CONFUSED = ", ".join(f"('{c}', '{r}')" for c, rs in P.CONFUSABLE.items() for r in ([rs] if c in "mw" else rs))
_LOOK = f"""WITH n AS (SELECT DISTINCT regexp_replace(lower(trim(domain_name)), '\\.$', '') AS name FROM domain_snaps), p AS (SELECT name, split_part(name, '.', 1) AS s, substr(name, length(split_part(name, '.', 1)) + 1) AS rest FROM n),
  i AS (SELECT *, CAST(unnest(range(1, length(s) + 1)) AS INTEGER) AS i FROM p),
  x AS (SELECT name, s, left(s, i - 1) || substr(s, i + 1) AS x, rest, 'omission' AS how FROM i UNION ALL SELECT name, s, left(s, i) || substr(s, i), rest, 'repetition' FROM i
    UNION ALL SELECT name, s, left(s, i - 1) || substr(s, i + 1, 1) || substr(s, i, 1) || substr(s, i + 2), rest, 'transposition' FROM i WHERE i < length(s) UNION ALL SELECT name, s, left(s, i) || '-' || substr(s, i + 1), rest, 'hyphen' FROM i WHERE i < length(s)
    UNION ALL SELECT name, s, left(s, i - 1) || r || substr(s, i + 1), rest, 'confusable' FROM i JOIN (VALUES {_CONFUSED}) c(c, r) ON substr(s, i, 1) = c),
  y AS (SELECT name, x || rest AS candidate, how FROM x WHERE x <> s AND x <> '' UNION ALL SELECT name, s || '.' || t, 'suffix' FROM p, (VALUES {", ".join(f"('{t}')" for t in P.SUFFIXES)}) u(t) WHERE s || '.' || t <> name),
  z AS (SELECT name, candidate, min(how) AS how FROM y GROUP BY name, candidate QUALIFY row_number() OVER (PARTITION BY name ORDER BY min(how), candidate) <= 400)
  SELECT name, how, count(*) AS n FROM z GROUP BY ALL"""
_DELTA = """WITH f AS (SELECT coalesce(root, '') AS root, regexp_replace(replace(path, chr(92), '/'), '^(\\./+)+', '') AS path, coalesce(indexed_at, TIMESTAMP '0001-01-01') AS ts, file_id, text, max(coalesce(indexed_at, TIMESTAMP '0001-01-01')) OVER (PARTITION BY coalesce(root, '')) AS newest FROM files WHERE path IS NOT NULL),
  a AS (SELECT root, path, arg_max(text, (ts, file_id)) AS text FROM f GROUP BY ALL), b AS (SELECT root, path, arg_max(text, (ts, file_id)) AS text FROM f WHERE ts < newest GROUP BY ALL),
  x AS (SELECT 'new' AS side, * FROM a UNION ALL SELECT 'old', * FROM b), d AS (SELECT side, root, unnest(regexp_extract_all(text, '"([a-z]+)": \\{"version": "[^"]+"', 1)) AS name, unnest(regexp_extract_all(text, '"[a-z]+": \\{"version": "([^"]+)"', 1)) AS version FROM x WHERE regexp_matches(path, '(?:package-lock\\.json|go\\.sum|uv\\.lock|Cargo\\.lock)$')),
  g AS (SELECT root, name, array_to_string(list_sort(list_distinct(list(version) FILTER (side = 'old'))), ',') AS o, array_to_string(list_sort(list_distinct(list(version) FILTER (side = 'new'))), ',') AS n FROM d GROUP BY ALL), h AS (SELECT root, 'generic' AS ecosystem, name, nullif(o, '') AS old, nullif(n, '') AS new FROM g)
  SELECT root, ecosystem, name, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change FROM h WHERE old IS DISTINCT FROM new"""
ORACLE |= {"q_lookalikes": _LOOK, "q_dep_delta_roots": _DELTA}
