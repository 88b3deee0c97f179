"""Sinks: findings as rows of standard report formats, inventories and statements; stores.

Every format is a projection to JSON or text rows that executors write; nothing is rendered on the driver but short reports, whose
length is a parameter. Defined results: a null line is line 1 in SARIF; nulls in text formats are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators.report import base_fingerprint, content_fingerprint, rank_of

# Levels of report formats by severity rank.
SARIF = ("note", "warning", "warning", "error", "error")
CLIMATE = ("info", "minor", "major", "critical", "blocker")
ANNOTATION = ("notice", "notice", "warning", "error", "error")


def level(names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), rank_of(F.col("severity")))


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("*")).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object a row."""
    region = F.struct(F.coalesce("line", F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level(SARIF).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule object for each distinct rule: its text is its first message, 120 characters."""
    first = findings.groupBy("rule_id").agg(F.min("message").alias("m"))
    return first.select(F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.left("m", F.lit(120)).alias("text")).alias("shortDescription"))).alias("value"))


def write_sarif(findings: DataFrame, folder: str, tool: str = "tracewell") -> None:
    """A SARIF log as parts: rules and results, each line an object; ``sarif_log`` makes one document of a small log."""
    sarif_rules(findings).write.mode("overwrite").text(f"{folder}/rules")
    sarif_results(findings).write.mode("overwrite").text(f"{folder}/results")


def code_climate(findings: DataFrame) -> DataFrame:
    fp = F.left(F.sha2(F.concat_ws("|", "rule_id", "path", F.coalesce(F.col("line").cast("string"), F.lit(""))), 256), F.lit(16))
    where = F.struct(F.col("path"), F.struct(F.coalesce("line", F.lit(1)).alias("begin")).alias("lines"))
    return findings.select(F.to_json(F.struct(F.col("message").alias("description"), F.col("rule_id").alias("check_name"), fp.alias("fingerprint"), level(CLIMATE).alias("severity"), where.alias("location"))).alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    """CI annotation commands; % and line ends escaped, and : and , in properties."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    prop = lambda c: F.replace(F.replace(esc(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    return findings.select(F.concat(F.lit("::"), level(ANNOTATION), F.lit(" file="), prop(F.col("path")), F.lit(",line="), F.coalesce("line", F.lit(1)).cast("string"), F.lit(",title="), prop(F.col("rule_id")), F.lit("::"), esc(F.col("message"))).alias("value"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    place = F.concat(F.coalesce("path", F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    return findings.select(F.concat(F.lit("| "), F.lower("severity"), F.lit(" | "), F.col("rule_id"), F.lit(" | "), cell(place), F.lit(" | "), F.left(cell(F.col("message")), F.lit(200)), F.lit(" |")).alias("value"))


def text_report(findings: DataFrame, most: int = 1000) -> str:
    """A report grouped by target, of at most ``most`` findings in order of weight; the rest is counted."""
    rows = findings.orderBy(rank_of(F.col("severity")).desc(), "target", "path", F.asc_nulls_first("line"), "rule_id").limit(most + 1).collect()
    out, target = [], None
    for r in sorted(rows[:most], key=lambda r: r["target"] or ""):
        if r["target"] != target:
            target = r["target"]
            out.append(f"== {target}")
        out.append(f"[{(r['severity'] or '').lower()}] {r['rule_id']} {r['path'] or ''}{':' + str(r['line']) if r['line'] is not None else ''} {r['message']}")
    return "\n".join([*out, *(["..."] if len(rows) > most else [])])


def html_rows(findings: DataFrame) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return findings.select(F.concat(F.lit("<tr><td>"), esc(F.lower("severity")), F.lit("</td><td>"), esc(F.col("rule_id")), F.lit("</td><td>"), esc(F.col("path")), F.lit("</td><td>"), esc(F.col("excerpt")), F.lit("</td></tr>")).alias("value"))


def baseline(findings: DataFrame) -> DataFrame:
    """(fp, fp_content, expires_at): accepted fingerprints, once each, in order."""
    return findings.select(base_fingerprint().alias("fp"), content_fingerprint().alias("fp_content")).groupBy("fp").agg(F.min("fp_content").alias("fp_content")).withColumn("expires_at", F.lit(None).cast("timestamp")).orderBy("fp")


def vex_statements(findings: DataFrame) -> DataFrame:
    one = findings.select("rule_id").distinct()
    return one.select(F.to_json(F.struct(F.struct(F.col("rule_id").alias("name")).alias("vulnerability"), F.lit("under_investigation").alias("status"))).alias("value"))


def cyclonedx_components(deps: DataFrame) -> DataFrame:
    d = deps.select("ecosystem", "name", "version").distinct()
    return d.select(F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", X.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"))).alias("value"))


def spdx_packages(deps: DataFrame) -> DataFrame:
    d = deps.select("ecosystem", "name", "version").distinct()
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), X.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("referenceLocator"))
    return d.select(F.to_json(F.struct(F.concat(F.lit("SPDXRef-"), F.regexp_replace(F.concat_ws("-", "ecosystem", "name", "version"), "[^A-Za-z0-9.-]", "-")).alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.array(ref).alias("externalRefs"))).alias("value"))


def store_scan(findings: DataFrame, folder: str) -> None:
    """Append a scan's findings to a store partitioned by target."""
    findings.write.mode("append").partitionBy("target").parquet(f"{folder}/findings")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old``, and those of ``new`` whose key is not among them, once each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def search_records(records: DataFrame, query: str, most: int = 50) -> DataFrame:
    """Records that hold the text in key or body, in any case, newest first: a report of at most ``most``."""
    q = F.lit(query.lower())
    return records.where(F.contains(F.lower("key"), q) | F.contains(F.lower("body"), q)).orderBy(F.desc("ts"), "id").limit(most)


def sarif_log(findings: DataFrame, most: int = 10_000, tool: str = "tracewell") -> str:
    """One SARIF document of at most ``most`` findings in order of weight (the report's length; ``write_sarif`` has no bound)."""
    import json

    top = findings.orderBy(rank_of(F.col("severity")).desc(), "path", F.asc_nulls_first("line"), "rule_id").limit(most)
    results = [json.loads(r[0]) for r in sarif_results(top).collect()]
    rules = [json.loads(r[0]) for r in sarif_rules(top).orderBy("value").collect()]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]})


def html_report(findings: DataFrame, most: int = 1000, title: str = "Findings") -> str:
    """A page of at most ``most`` findings in order of weight; the rest is counted."""
    top = findings.orderBy(rank_of(F.col("severity")).desc(), "path", F.asc_nulls_first("line"), "rule_id").limit(most + 1)
    rows = [r[0] for r in html_rows(top).collect()]
    more = "<p>More findings are left out.</p>" if len(rows) > most else ""
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><table>{''.join(rows[:most])}</table>{more}</body></html>"


def baseline_signed(findings: DataFrame, key: bytes, form: str = "v2") -> DataFrame:
    """Baseline rows in the old form (the fingerprint alone), the form 'v2' (all columns) or 'signed' (each row with its HMAC)."""
    from tracewell.functions.codecs import hmac_sha256

    rows = baseline(findings)
    if form == "legacy":
        return rows.select("fp")
    return rows.withColumn("mac", hmac_sha256(key)(F.concat_ws("|", "fp", "fp_content"))) if form == "signed" else rows


def attestation(findings: DataFrame, subject: str, digest: str, rules_fp: str) -> DataFrame:
    """One row: an in-toto statement about a scan, with counts and the digest over the fingerprints."""
    from tracewell.operators.report import digests, summary

    told = summary(findings).crossJoin(digests(findings))  # two single rows
    predicate = F.struct(F.lit(rules_fp).alias("ruleset"), "total", "worst", "digest", "fingerprints")
    made = F.struct(
        F.lit("https://in-toto.io/Statement/v1").alias("_type"), F.array(F.struct(F.lit(subject).alias("name"), F.struct(F.lit(digest).alias("sha256")).alias("digest"))).alias("subject"),
        F.lit("https://in-toto.io/attestation/test-result/v0.1").alias("predicateType"), predicate.alias("predicate"),
    )
    return told.select(F.to_json(made).alias("value"))


def hook_calls(findings: DataFrame, key: bytes, event: str = "finding") -> DataFrame:
    """(body, signature): what a webhook is sent for each finding; a callback of ``foreachBatch`` delivers the rows."""
    from tracewell.functions.codecs import hmac_sha256

    body = findings.select(F.to_json(F.struct(F.lit(event).alias("event"), F.struct("*").alias("finding"))).alias("body"))
    return body.withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(key)(F.col("body"))))


def store_scans(scans: DataFrame, folder: str) -> None:
    """Append scans (scan_id, root, ts, counts) to the store beside their findings."""
    scans.write.mode("append").partitionBy("root").parquet(f"{folder}/scans")


def write_cache(files: DataFrame, findings: DataFrame, rules_fp: str, folder: str) -> None:
    """The scan cache as it is after a scan: (root, path, mtime, size, rules_fp) and the findings of those files, in a new version of the folder."""
    files.select("root", "path", "mtime", "size", F.lit(rules_fp).alias("rules_fp")).write.mode("overwrite").parquet(f"{folder}/files")
    findings.write.mode("overwrite").parquet(f"{folder}/findings")
