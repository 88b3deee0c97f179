"""Structured audits: web responses, pages, build files, workflows, mail policy, egress, file heuristics.

Each audit is a projection of one row to an array of ids that is exploded; ids are fixed per check. Defined results: null
headers count as none sent; null bodies have no body findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators.snapshots import newest


def explode_ids(rows: DataFrame, keep: list[str], checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(keep..., id, severity): one row for each check that holds."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"))) for i, s, c in checks]), lambda x: x.isNotNull())
    return rows.select(*keep, F.explode(found).alias("_x")).select(*keep, "_x.id", "_x.severity")


def lower_headers(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only the last stays."""
    return F.coalesce(F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"]))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def web_checks(responses: DataFrame) -> list[tuple[str, str, Column]]:
    """The checks of a response (url, headers, body, final_url where it was followed): (id, severity, condition)."""
    h = lower_headers(F.col("headers"))
    get = lambda k: F.lower(F.try_element_at(h, F.lit(k)))
    https, body = F.lower("url").startswith("https:"), F.col("body")
    csp, cookie, origin = get("content-security-policy"), get("set-cookie"), get("access-control-allow-origin")
    final = F.lower("final_url") if "final_url" in responses.columns else F.lit(None).cast("string")
    title = F.lower(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title>", 1))
    with_credentials = F.coalesce(get("access-control-allow-credentials") == "true", F.lit(False))
    return [
        ("WEB-001", "high", https & final.startswith("http:")), ("WEB-010", "medium", csp.isNull()), ("WEB-011", "low", get("x-content-type-options").isNull()),
        ("WEB-012", "low", get("x-frame-options").isNull() & ~F.coalesce(csp.contains("frame-ancestors"), F.lit(False))), ("WEB-013", "low", get("referrer-policy").isNull()), ("WEB-014", "low", get("permissions-policy").isNull()),
        ("WEB-015", "medium", https & (get("strict-transport-security").isNull() | get("strict-transport-security").rlike(r"max-age=0\b"))), ("WEB-017", "high", (origin == "*") & with_credentials), ("WEB-019", "medium", csp.rlike("unsafe-(?:inline|eval)")),
        ("WEB-020", "low", cookie.isNotNull() & ~(cookie.contains("httponly") & cookie.contains("secure"))), ("WEB-021", "info", get("cross-origin-opener-policy").isNull() & get("cross-origin-embedder-policy").isNull()), ("WEB-022", "low", (origin == "*") & ~with_credentials), ("WEB-023", "medium", origin == "null"),
        ("WEB-025", "high", body.rlike(r"(?i)<form[^>]+action=[\"']?http://")), ("WEB-026", "low", title.rlike(r"^\s*index of /")), ("WEB-027", "medium", body.rlike(r"Traceback \(most recent call last\)|java\.lang\.[A-Za-z]+Exception|panic: runtime error|</b> on line <b>")),
        ("WEB-028", "medium", https & body.rlike(r"(?i)<(?:script|img|iframe|link)[^>]+(?:src|href)=[\"']?http://")), ("WEB-029", "low", cookie.isNotNull() & get("cache-control").rlike("public|max-age=[1-9]")), ("WEB-044", "medium", cookie.rlike("samesite=none") & ~cookie.contains("secure")),
        ("WEB-050", "high", body.rlike(r"(?i)(?:api_?key|secret|token|passw(?:or)?d)[\"']?\s*[:=]\s*[\"'][A-Za-z0-9+/_\-]{16,}[\"']")), ("WEB-060", "info", body.rlike(r"(?is)<meta\s+name=[\"']description[\"']\s+content=[\"']\s*[-–—]")), ("WEB-061", "info", body.rlike(r"(?i)<meta[^>]+name=[\"']?generator")), ("WEB-062", "info", title.rlike("admin|debug|dashboard|phpinfo")),
    ]


def web_audit(responses: DataFrame) -> DataFrame:
    """(resp_id, id, severity) of responses (resp_id, url, headers, body); of those delivered twice the one loaded last."""
    order = [c for c in ("loaded_at", "fetched_at") if c in responses.columns]
    once = newest(responses.select("resp_id", "url", "headers", "body", *[c for c in ("final_url", *order) if c in responses.columns]), "resp_id", *order) if order else responses.dropDuplicates(["resp_id"])
    return explode_ids(once, ["resp_id"], web_checks(responses))


def page_fields(pages: DataFrame) -> DataFrame:
    """(key, title, description, generator, scripts, links, forms) of HTML bodies (key, body)."""
    b = F.col("body")
    first = lambda rx: F.nullif(X.collapse(F.regexp_extract(b, rx, 1)), F.lit(""))
    count = lambda rx: F.size(F.regexp_extract_all(b, F.lit(rx), F.lit(0)))
    return pages.where(F.col("body").rlike("(?i)<html|<!doctype html")).select(
        "key", first(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), first(r"""(?is)<meta\s+name=["']description["']\s+content=["']([^"']*)["']""").alias("description"),
        first(r"""(?is)<meta\s+name=["']generator["']\s+content=["']([^"']*)["']""").alias("generator"),
        count(r"(?i)<script\b").alias("scripts"), count(r"""(?i)<a\s[^>]*href=""").alias("links"), count(r"(?i)<form\b").alias("forms"), F.regexp_extract_all(b, F.lit(r"""(?i)<script[^>]+src=["']([^"']+)["']"""), F.lit(1)).alias("script_urls"),
    )


# Marks of web firewalls' challenge pages and of trackers.
WAF_MARKS = {"challenge": r"(?i)checking your browser|verify (?:that )?you are (?:a )?human|security check|make sure you're not a robot", "blocked": r"(?i)request blocked|access denied|security policy", "captcha": r"(?i)captcha|turnstile"}


def marks(pages: DataFrame, table: dict[str, str] = WAF_MARKS) -> DataFrame:
    """(key, mark) of every mark a body bears."""
    return pages.select("key", F.explode(F.filter(F.array(*[F.when(F.col("body").rlike(rx), F.lit(k)) for k, rx in table.items()]), lambda x: x.isNotNull())).alias("mark"))


def dockerfile_audit(files: DataFrame) -> DataFrame:
    """(key, id, severity) of container build files (key, path, text): line by line, continuations not joined."""
    named = files.where(F.col("path").rlike(r"(?i)(?:^|/)(?:Dockerfile|Containerfile)[^/]*$|\.dockerfile$") & F.col("text").isNotNull())
    t = F.col("text")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    has = lambda rx: F.exists(lines, lambda x: x.rlike(rx))
    secret = r"(?i)(?:password|passwd|secret|token|api_?key|access_?key|private_?key|credential)"
    untagged = F.exists(lines, lambda x: x.rlike(r"(?i)^FROM\s") & ~F.upper(x).contains(" AS ") & ~x.rlike(r"(?i)^FROM\s+(?:--\S+\s+)?(?:scratch\s*$|\S+@sha256:|(?:\S*/)?[^/\s:]+:(?!latest\s*$)\S+)"))
    checks = [
        ("CNT-001", "high", has(r"(?i)^FROM\s") & ~has(r"(?i)^USER\s")), ("CNT-002", "high", has(r"(?i)(?:curl|wget)[^|]*\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b")), ("CNT-003", "medium", has(r"(?i)^ADD\s+(?:--\S+\s+)*https?://")),
        ("CNT-004", "medium", untagged), ("CNT-005", "critical", has(rf"^(?i:ENV|ARG)\s+\w*{secret}\w*[=\s]+[\"']?[^$\s\"'][^\s]*")), ("CNT-006", "low", has(r"chmod\s+(?:-R\s+)?0?777")),
        ("CNT-009", "high", has(r"(?i)^(?:COPY|ADD)\s+\S*(?:id_rsa|id_ed25519|\.pem|\.key|\.env|credentials|\.npmrc|\.netrc)\b")), ("CNT-010", "medium", has(r"(?i)^EXPOSE\s+(?:\S+\s+)*22")),
    ]
    return explode_ids(named, ["key"], checks)


def workflow_audit(files: DataFrame) -> DataFrame:
    """(key, id, severity, detail) of CI workflows (key, path, text) by their lines; ``containers.audit`` reads the documents.

    Only texts that name jobs are looked at. The line form covers references, triggers, permissions and untrusted input in scripts.
    """
    named = files.where(F.col("text").rlike(r"(?m)^jobs:") & F.col("text").isNotNull())
    t = F.col("text")
    uses = F.filter(F.regexp_extract_all(t, F.lit(r"(?m)^\s*(?:-\s+)?uses:\s*[\"']?([^\s\"'#]+)"), F.lit(1)), lambda x: ~x.rlike(r"^\./|@(?:[0-9a-f]{40})$|^docker://.*@sha256:"))
    untrusted = r"\$\{\{\s*github\.(?:event\.(?:issue|pull_request|comment|review|head_commit|commits)[\w.\[\]*]*(?:title|body|message|ref|name|email|label)|head_ref)"
    secret = r"\$\{\{\s*secrets\.[A-Za-z_]\w*\s*\}\}"
    base = [
        ("WFA-001", "medium", ~t.rlike(r"(?m)^\s*permissions:")), ("WFA-002", "high", t.rlike(r"(?m)^\s*permissions:\s*write-all")), ("WFA-003", "high", t.rlike(rf"(?m)run:[^\n]*{untrusted}")),
        ("WFA-004", "medium", t.rlike(rf"(?m)run:[^\n]*{secret}")), ("WFA-005", "medium", t.rlike(r"(?m)^\s*secrets:\s*inherit")), ("WFA-006", "medium", F.size(uses) > 0),
        ("WFA-007", "high", t.rlike(r"pull_request_target") & t.rlike(r"ref:\s*\$\{\{\s*github\.(?:event\.pull_request\.head|head_ref)")), ("WFA-008", "medium", t.rlike(r"(?m)runs-on:[^\n]*self-hosted") & t.rlike(r"pull_request")),
        ("WFA-009", "medium", t.rlike(r"ACTIONS_ALLOW_UNSECURE_COMMANDS:\s*[\"']?true")), ("WFA-010", "low", t.rlike(r"(?m)^\s*image:\s*[\"']?[^\s@\"']+(?::latest)?[\"']?\s*$")),
    ]
    return explode_ids(named, ["key"], base)


def tags(record: Column) -> Column:
    """A policy record's tags (v=..; p=..) as a map with names in lower case."""
    pairs = F.filter(F.transform(F.split(record, ";"), lambda x: F.split(F.trim(x), "=", 2)), lambda p: F.size(p) == 2)
    once = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: F.lower(F.trim(q[0]))), F.lower(F.trim(p[0]))) == i + 1)
    return F.map_from_entries(F.transform(once, lambda p: F.struct(F.lower(F.trim(p[0])), F.trim(p[1]))))


def spf(domains: DataFrame) -> DataFrame:
    """(domain, status, policy, lookups) from TXT answers (domain, txt ARRAY): the record's own terms.

    null answers are inconclusive (the lookup failed); none or several records are an error; more than ten lookups are an error; a bare
    'all' is '+all'; without 'all' and redirect the policy is neutral. Included records count as one lookup each: see ``spf_tree``.
    """
    recs = F.filter("txt", lambda x: F.lower(F.trim(x)).rlike(r"^v=spf1(?:\s|$)"))
    terms = F.filter(F.split(F.lower(F.trim(F.get(recs, F.lit(0)))), r"\s+"), lambda x: x != "v=spf1")
    lookups = F.size(F.filter(terms, lambda x: x.rlike(r"^[+?~-]?(?:a|mx|ptr|exists|include)(?:[:/]|$)|^redirect=")))
    alls = F.filter(terms, lambda x: x.rlike(r"^[+?~-]?all$"))
    policy = F.when(F.size(alls) > 0, F.when(F.get(alls, F.lit(0)) == "all", "+all").otherwise(F.get(alls, F.lit(0)))).when(F.exists(terms, lambda x: x.startswith("redirect=")), "redirect").otherwise("neutral")
    status = F.when(F.col("txt").isNull(), "inconclusive").when(F.size(recs) == 0, "absent").when(F.size(recs) > 1, "error").when(lookups > 10, "error").otherwise("confirmed")
    ok = F.size(recs) == 1
    return domains.select("domain", status.alias("status"), F.when(ok, policy).alias("policy"), F.when(ok, lookups).alias("lookups"))


def spf_tree(txt: DataFrame, hops: int = 10) -> DataFrame:
    """(domain, lookups): lookups of a domain's record and all it includes, at most ``hops`` deep; loops end at the depth.

    ``txt`` (domain, record). Each hop joins the frontier with the records on the included name and aggregates at once.
    """
    recs = txt.where(F.lower("record").startswith("v=spf1")).groupBy(F.lower("domain").alias("name")).agg(F.min("record").alias("record"))
    terms = F.split(F.lower(F.trim("record")), r"\s+")
    cost = F.size(F.filter(terms, lambda x: x.rlike(r"^[+?~-]?(?:a|mx|ptr|exists|include)(?:[:/]|$)|^redirect=")))
    nexts = F.transform(F.filter(terms, lambda x: x.rlike(r"^[+?~-]?include:|^redirect=")), lambda x: F.regexp_extract(x, r"(?:include:|redirect=)(.+)$", 1))
    known = recs.select("name", cost.alias("cost"), nexts.alias("nexts"))
    frontier = known.select(F.col("name").alias("domain"), "name", F.lit(1).alias("times"))
    total = None
    for _ in range(hops):
        here = frontier.join(known, "name")
        part = here.select("domain", (F.col("cost") * F.col("times")).alias("cost"))
        total = part if total is None else total.unionByName(part)
        frontier = here.select("domain", "times", F.explode("nexts").alias("name")).groupBy("domain", "name").agg(F.sum("times").cast("int").alias("times"))
    return total.groupBy("domain").agg(F.sum("cost").alias("lookups"))


def dmarc(domains: DataFrame) -> DataFrame:
    """(domain, status, policy) from the TXT answers of _dmarc (domain, txt ARRAY)."""
    recs = F.filter("txt", lambda x: F.lower(F.trim(x)).rlike(r"^v=dmarc1(?:\s*;|\s*$)"))
    p = F.lower(F.try_element_at(tags(F.get(recs, F.lit(0))), F.lit("p")))
    status = F.when(F.col("txt").isNull(), "inconclusive").when(F.size(recs) == 0, "absent").when(F.size(recs) > 1, "error").when(p.isin("none", "quarantine", "reject"), "confirmed").otherwise("inconclusive")
    return domains.select("domain", status.alias("status"), F.when(F.size(recs) == 1, p).alias("policy"))


def unexpected_flows(flows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Flows (id, ip, port) that no allowance (cidr or null, port or null) covers; metadata addresses never pass.

    Allowances are keyed by port and by their network at each prefix length in use, so flows meet them in an equi-join on
    (prefix, network); the list of prefix lengths is at most 33 long.
    """
    n = X.ip_number(F.col("ip"))
    bits = F.coalesce(F.try_element_at(F.split("cidr", "/"), F.lit(2)).cast("int"), F.lit(32))
    net = F.floor(X.ip_number(F.substring_index("cidr", "/", 1)) / F.pow(F.lit(2.0), 32 - bits)).cast("bigint")
    rules = allowed.select(F.when(F.col("cidr").isNull(), F.lit(0)).otherwise(bits).alias("bits"), F.when(F.col("cidr").isNull(), F.lit(0).cast("bigint")).otherwise(net).alias("net"), F.col("port").alias("rule_port"))
    lengths = F.array(*[F.lit(i) for i in range(33)])
    keyed = flows.select("id", "ip", "port", n.alias("n")).select("*", F.explode(lengths).alias("bits")).withColumn("net", F.floor(F.col("n") / F.pow(F.lit(2.0), 32 - F.col("bits"))).cast("bigint"))
    fine = keyed.join(rules, ["bits", "net"]).where(F.col("rule_port").isNull() | (F.col("rule_port") == F.col("port"))).where(F.col("ip") != "169.254.169.254").select("id").distinct()
    return flows.join(fine, "id", "left_anti").select("id", "ip", "port")


def registry_bodies(bodies: DataFrame) -> DataFrame:
    """(key, form, name, version, packages, digests): JSON answers of registries (key, text) read by their form."""
    t = F.col("text")
    js = F.try_parse_json(t)
    pick = lambda p, k: F.try_variant_get(js, p, k)
    form = F.when(pick("$.schemaVersion", "int").isNotNull(), "manifest").when(pick("$.name", "string").isNotNull(), "package").when(pick("$.errors", "variant").isNotNull() | pick("$.error", "string").isNotNull(), "error").when(js.isNotNull(), "other")
    digests = F.array_distinct(F.regexp_extract_all(t, F.lit(r"sha256:[0-9a-f]{62,64}"), F.lit(0)))
    return bodies.where(js.isNotNull() & t.rlike(r"^\s*[{\[]")).select("key", form.alias("form"), pick("$.name", "string").alias("name"), pick("$.version", "string").alias("version"), F.size(digests).alias("digests"))


def feed_entries(bodies: DataFrame) -> DataFrame:
    """(key, pos, id, title) of RSS, Atom and JSON feeds (key, text)."""
    entries = F.regexp_extract_all("text", F.lit(r"(?s)<(?:entry|item)\b[^>]*>(.*?)</(?:entry|item)>"), F.lit(1))
    rows = bodies.where(F.col("text").rlike(r"<(?:feed|rss)\b")).select("key", F.posexplode(entries).alias("pos", "e"))
    xml = rows.select("key", "pos", F.regexp_extract("e", r"(?s)<(?:id|guid)[^>]*>(.*?)</(?:id|guid)>", 1).alias("id"), F.regexp_extract("e", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"))
    js = bodies.where(F.col("text").rlike(r"^\s*\{") & F.get_json_object("text", "$.version").contains("jsonfeed.org"))
    items = F.from_json(F.get_json_object("text", "$.items"), "array<struct<id:string,title:string>>")
    return xml.unionByName(js.select("key", F.posexplode(items).alias("pos", "e")).select("key", "pos", "e.id", "e.title"))


def byte_entropy(c: bytes) -> float:
    n = np.bincount(np.frombuffer(c, dtype=np.uint8), minlength=256)
    p = n[n > 0] / len(c)
    return float(-(p * np.log2(p)).sum())


def image_findings(images: DataFrame) -> DataFrame:
    """(key, id, severity) of container image configurations (key, config: JSON): credentials in the environment, no user, no health check, fetched scripts in the history."""
    pick = lambda p: F.get_json_object("config", p)
    env = F.coalesce(F.from_json(pick("$.config.Env"), "array<string>"), F.array().cast("array<string>"))
    steps = F.coalesce(F.transform(F.from_json(pick("$.history"), "array<struct<created_by:string>>"), lambda x: F.coalesce(x["created_by"], F.lit(""))), F.array().cast("array<string>"))
    user = F.coalesce(pick("$.config.User"), F.lit(""))
    secret = F.exists(env, lambda x: x.rlike(r"(?i)^[^=]*(?:password|passwd|secret|token|api_?key|access_?key|private_?key)[^=]*=[^$\s]"))
    checks = [
        ("IMG-001", "critical", secret), ("IMG-002", "high", user.rlike(r"^(?:|0|root)(?::.*)?$")), ("IMG-003", "low", pick("$.config.Healthcheck").isNull()),
        ("IMG-004", "critical", F.exists(steps, lambda x: x.rlike(r"(?:curl|wget)[^|]*\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b"))), ("IMG-010", "medium", F.exists(steps, lambda x: x.rlike(r"(?i)\bADD\s+(?:--\S+\s+)*https?://"))),
    ]
    return explode_ids(images.where(pick("$.config").isNotNull() | pick("$.history").isNotNull()), ["key"], checks)


def binary_findings(files: DataFrame) -> DataFrame:
    """(key, id) of files (key, path, content): double extension, packed executable, script behind an image, bytes behind the end of a PNG, an executable of high entropy."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, path, c in zip(b["key"], b["path"], b["content"], strict=True):
                c, p = bytes(c or b""), (path or "").lower()
                if any(p.endswith(x + y) for x in (".pdf", ".jpg", ".png", ".doc", ".docx", ".txt") for y in (".exe", ".scr", ".js", ".bat", ".vbs", ".sh")):
                    rows.append((key, "BIN-001"))
                if c[:4] in (b"\x7fELF",) or c[:2] == b"MZ":
                    rows += [(key, "BIN-002")] * (b"UPX!" in c[:4096] or b"UPX!" in c[-8192:])
                    if len(c) >= 4096 and byte_entropy(c) > 7.5:
                        rows.append((key, "BIN-005"))
                image = c[:8] == b"\x89PNG\r\n\x1a\n" or c[:3] == b"\xff\xd8\xff" or c[:4] == b"GIF8"
                if image and any(m in c[-8192:] for m in (b"<?php", b"<script", b"#!/bin/")):
                    rows.append((key, "BIN-003"))
                if c[:8] == b"\x89PNG\r\n\x1a\n" and (at := c.rfind(b"IEND")) >= 0 and len(c) > at + 8:
                    rows.append((key, "BIN-004"))
            yield pd.DataFrame(rows, columns=["key", "id"])

    return files.select("key", "path", "content").mapInPandas(each, f"key {dict(files.dtypes)['key']}, id string")


def posture_changes(changes: DataFrame) -> DataFrame:
    """Typed domain changes as findings: (domain, snap_no, id, severity)."""
    by = F.when(F.col("rec_key") == "certs", "DWATCH-001").when(F.col("rec_key") == "ns", "DWATCH-002").when(F.col("rec_key") == "mx", "DWATCH-003").when(F.col("change") == "added", "DWATCH-010").otherwise("DWATCH-011")
    sev = F.when(F.col("rec_key") == "ns", "high").when(F.col("rec_key") == "mx", "medium").otherwise("info")
    return changes.where("kind = 'domain'").select(F.col("owner").alias("domain"), "snap_no", by.alias("id"), sev.alias("severity"))


def expiring(rows: DataFrame, column: str, day: Column, within: int) -> DataFrame:
    """Rows whose date (head of a text) lies within so many days after ``day``, with the days left (negative: past)."""
    left = F.datediff(F.try_to_date(F.left(column, F.lit(10)), "yyyy-MM-dd"), day)
    return rows.withColumn("days_left", left).where(F.col("days_left") <= within)
