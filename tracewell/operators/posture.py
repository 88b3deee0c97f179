"""Posture: facts of hosts, settings of repositories and organisations, mail policies, licences of projects, names before publication, leads.

Checks are tables or columns, one row of output per check that holds. Defined results: a fact that is missing holds for checks of
absence only; settings that are not JSON give none; null answers are inconclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.audits import explode_ids, tags
from tracewell.operators.supply import copyleft

# Checks of host facts (id, severity, key, comparison, value). Comparisons: eq, ne, lt, gt, like (a pattern), unlike, missing.
HOST_CHECKS = [
    ("SYS-KERN-01", "high", "kernel.randomize_va_space", "ne", "2"), ("SYS-KERN-02", "low", "kernel.kptr_restrict", "lt", "1"), ("SYS-KERN-03", "medium", "kernel.dmesg_restrict", "ne", "1"), ("SYS-KERN-04", "low", "kernel.yama.ptrace_scope", "lt", "1"),
    ("SYS-KERN-05", "medium", "fs.protected_hardlinks", "ne", "1"), ("SYS-KERN-06", "medium", "fs.protected_symlinks", "ne", "1"), ("SYS-KERN-07", "low", "fs.suid_dumpable", "ne", "0"), ("SYS-KERN-08", "medium", "kernel.unprivileged_bpf_disabled", "lt", "1"),
    ("SYS-NET-01", "medium", "net.ipv4.conf.all.accept_redirects", "ne", "0"), ("SYS-NET-02", "low", "net.ipv4.conf.all.send_redirects", "ne", "0"), ("SYS-NET-03", "medium", "net.ipv4.conf.all.accept_source_route", "ne", "0"), ("SYS-NET-04", "medium", "net.ipv4.tcp_syncookies", "ne", "1"),
    ("SYS-NET-05", "low", "net.ipv4.conf.all.log_martians", "ne", "1"), ("SYS-NET-06", "low", "net.ipv4.icmp_echo_ignore_broadcasts", "ne", "1"), ("SYS-NET-07", "low", "net.ipv4.conf.all.rp_filter", "lt", "1"),
    ("SYS-SSH-01", "high", "sshd.permitrootlogin", "like", "(?i)^yes$"), ("SYS-SSH-02", "medium", "sshd.passwordauthentication", "like", "(?i)^yes$"), ("SYS-SSH-03", "high", "sshd.permitemptypasswords", "like", "(?i)^yes$"), ("SYS-SSH-04", "low", "sshd.x11forwarding", "like", "(?i)^yes$"),
    ("SYS-SSH-05", "medium", "sshd.protocol", "like", "1"), ("SYS-SSH-06", "low", "sshd.maxauthtries", "gt", "6"), ("SYS-SSH-12", "medium", "sshd.ciphers", "like", "(?i)cbc|3des|arcfour"), ("SYS-SSH-13", "high", "sshd.macs", "like", "(?i)md5|sha1-96"),
    ("SYS-AUTH-01", "high", "shadow.empty_passwords", "gt", "0"), ("SYS-AUTH-02", "critical", "passwd.uid0_accounts", "gt", "1"), ("SYS-AUTH-03", "low", "login.pass_max_days", "gt", "365"), ("SYS-AUTH-20", "low", "sudo.timestamp_timeout", "gt", "30"), ("SYS-AUTH-30", "medium", "sudo.nopasswd_all", "gt", "0"),
    ("SYS-FS-01", "medium", "mount./tmp", "unlike", "noexec"), ("SYS-FS-02", "low", "mount./var/tmp", "unlike", "nosuid"), ("SYS-FS-10", "medium", "fs.world_writable_dirs", "gt", "0"), ("SYS-LOG-01", "low", "service.syslog", "missing", ""), ("SYS-LOG-02", "low", "service.auditd", "missing", ""),
    ("SYS-CRON-03", "high", "cron.writable_scripts", "gt", "0"), ("SYS-SVC-01", "medium", "service.telnet", "like", "active"), ("SYS-SVC-02", "high", "service.rsh", "like", "active"), ("SYS-SVC-22", "critical", "docker.tcp_socket", "like", "0\\.0\\.0\\.0"), ("SYS-FW-01", "medium", "service.firewall", "missing", ""),
    ("SYS-PKG-01", "medium", "packages.security_updates", "gt", "0"), ("SYS-TIME-01", "medium", "service.timesync", "missing", ""), ("SYS-BOOT-01", "low", "boot.secure_boot", "unlike", "(?i)enabled"), ("SYS-HOME-02", "high", "home.world_readable_keys", "gt", "0"),
    ("SYS-INT-01", "info", "service.integrity_check", "missing", ""), ("SYS-MAL-01", "critical", "ld.so.preload", "like", "\\S"), ("SYS-DNS-01", "low", "dns.dnssec", "unlike", "(?i)yes"), ("SYS-CPU-01", "high", "cpu.vulnerable", "gt", "0"),
]
# Leads of compromise on a host (id, fact, pattern).
LEADS = [
    ("LEAD-PRELOAD", "ld.so.preload", r"\S"), ("LEAD-CRON", "cron.line", r"(?:curl|wget)[^|]*\|\s*(?:ba)?sh|base64\s+-d|/dev/tcp/"), ("LEAD-STAGE", "file.path", r"^/(?:tmp|var/tmp|dev/shm)/\.[^/]+$|^/dev/shm/[^/]+\.(?:sh|so|elf)$"),
    ("LEAD-DELETED", "proc.exe", r" \(deleted\)$"), ("LEAD-MODULE", "module.unlisted", r"\S"), ("LEAD-BPF", "bpf.program", r"(?i)hide|hook|rootkit"),
]
# Settings that are findings (id, severity, path in the answer, pattern of the value).
SETTINGS = [
    ("RST-101", "medium", "$.two_factor_requirement_enabled", "^false$"), ("RST-102", "info", "$.default_repository_permission", "^(?:write|admin)$"), ("RST-103", "medium", "$.members_can_create_public_repositories", "^true$"),
    ("RST-201", "medium", "$.branch_protection.enabled", "^false$"), ("RST-202", "info", "$.branch_protection.required_reviews", "^0$"), ("RST-210", "medium", "$.allow_force_pushes", "^true$"), ("RST-211", "info", "$.web_commit_signoff_required", "^false$"), ("RST-220", "medium", "$.actions.default_workflow_permissions", "^write$"),
]


def host_findings(facts: DataFrame, checks: list[tuple[str, str, str, str, str]] = HOST_CHECKS) -> DataFrame:
    """(host, id, severity, value) of facts (host, key, value) against the check table; the join is on the key, absent ones on the host."""
    spark = facts.sparkSession
    table = F.broadcast(spark.createDataFrame(checks, "id string, severity string, key string, op string, want string"))  # as many rows as there are checks
    v, w = F.expr("try_cast(value as double)"), F.expr("try_cast(want as double)")
    holds = (
        F.when(F.col("op") == "eq", F.col("value") == F.col("want")).when(F.col("op") == "ne", F.col("value") != F.col("want")).when(F.col("op") == "lt", v < w).when(F.col("op") == "gt", v > w)
        .when(F.col("op") == "like", F.expr("rlike(value, want)")).when(F.col("op") == "unlike", ~F.expr("rlike(value, want)")).otherwise(False)
    )
    one = facts.groupBy("host", "key").agg(F.max("value").alias("value"))
    met = one.join(table, "key").where(holds).select("host", "id", "severity", "value")
    wanted = table.where("op = 'missing'").select("id", "severity", "key")
    lacking = one.select("host").distinct().join(wanted).join(one.select("host", "key"), ["host", "key"], "left_anti").select("host", "id", "severity", F.lit(None).cast("string").alias("value"))
    return met.unionByName(lacking)


def host_leads(facts: DataFrame) -> DataFrame:
    """(host, id, value) of facts that look like a compromise."""
    found = F.filter(F.array(*[F.when((F.col("key") == k) & F.col("value").rlike(rx), F.lit(i)) for i, k, rx in LEADS]), lambda x: x.isNotNull())
    return facts.select("host", "value", F.explode(found).alias("id")).select("host", "id", "value").distinct()


def settings_findings(answers: DataFrame) -> DataFrame:
    """(key, id, severity) of settings answers (key, json); an answer that was refused is RST-000."""
    checks = [(i, s, F.get_json_object("json", p).rlike(rx)) for i, s, p, rx in SETTINGS]
    return explode_ids(answers.where("json IS NOT NULL"), ["key"], [("RST-000", "info", F.get_json_object("json", "$.message").isNotNull()), *checks])


def registrable(host: Column, second: str = "co|com|net|org|gov|edu|ac|or|ne|go") -> Column:
    """The registrable domain of a host: its last two labels, or three under a two-letter country with a generic second level; null for addresses."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^[a-z][a-z0-9+.\-]*://(?:[^@/]*@)?|[/:?#].*$", ""), r"\.$", "")
    three = F.regexp_extract(h, rf"([^.]+\.(?:{second})\.[a-z]{{2}})$", 1)
    two = F.regexp_extract(h, r"([^.]+\.[a-z][a-z0-9\-]*)$", 1)
    return F.nullif(F.when(h.rlike(r"^[\d.]+$|^\[|:"), F.lit("")).when(three != "", three).otherwise(two), F.lit(""))


def dkim(answers: DataFrame) -> DataFrame:
    """(domain, selector, status) of TXT answers of selectors (domain, selector, txt): revoked if the key is empty."""
    rec = F.get(F.filter("txt", lambda x: F.lower(x).rlike(r"(?:^|;)\s*(?:v=dkim1|k=|p=)")), F.lit(0))
    key = F.try_element_at(tags(rec), F.lit("p"))
    return answers.select("domain", "selector", F.when(F.col("txt").isNull(), "inconclusive").when(rec.isNull(), "absent").when(F.regexp_replace(F.coalesce(key, F.lit("")), r"\s", "") == "", "revoked").otherwise("confirmed").alias("status"))


def bimi(answers: DataFrame) -> DataFrame:
    """(domain, status, logo) of TXT answers of the default selector."""
    rec = F.get(F.filter("txt", lambda x: F.lower(F.trim(x)).startswith("v=bimi1")), F.lit(0))
    logo = F.try_element_at(tags(rec), F.lit("l"))
    return answers.select("domain", F.when(F.col("txt").isNull(), "inconclusive").when(rec.isNull(), "absent").when(F.coalesce(logo, F.lit("")) == "", "declined").otherwise("confirmed").alias("status"), F.nullif(logo, F.lit("")).alias("logo"))


def mta_sts(policies: DataFrame) -> DataFrame:
    """(domain, mode, covered) of policy files (domain, policy, mx): whether each of the mail hosts fits a pattern; '*.x' fits x itself as well."""
    field = lambda k: F.lower(F.regexp_extract("policy", rf"(?im)^{k}:\s*(\S+)\s*$", 1))
    pats = F.transform(F.regexp_extract_all("policy", F.lit(r"(?im)^mx:\s*(\S+)\s*$"), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"\.$", ""))
    host = lambda h: F.regexp_replace(F.lower(F.element_at(F.split(F.trim(h), r"\s+"), -1)), r"\.$", "")
    fits = lambda h, p: F.when(p.startswith("*."), F.concat(F.lit("."), h).endswith(F.substring(p, 2, 255))).otherwise(h == p)
    covered = F.forall(F.coalesce("mx", F.array().cast("array<string>")), lambda h: F.exists(pats, lambda p: fits(host(h), p)))
    mode = F.when(F.col("policy").isNull(), "absent").when(field("mode").isin("enforce", "testing", "none"), field("mode")).otherwise("error")
    return policies.select("domain", mode.alias("mode"), F.when(F.col("policy").isNotNull(), covered).alias("covered"))


def mail_gaps(spf: DataFrame, dmarc: DataFrame, mta: DataFrame, bimi_rows: DataFrame) -> DataFrame:
    """(domain, id): spf-open, dmarc-none, mtasts-mode, bimi-dmarc, from the four verdicts by domain."""
    j = spf.select("domain", F.col("policy").alias("spf")).join(dmarc.select("domain", F.col("policy").alias("dmarc")), "domain", "full_outer").join(mta.select("domain", "mode"), "domain", "full_outer").join(bimi_rows.select("domain", F.col("status").alias("bimi")), "domain", "full_outer")
    weak = F.coalesce("dmarc", F.lit("none")) == "none"
    checks = [("spf-open", "medium", F.col("spf").isin("+all", "?all", "neutral")), ("dmarc-none", "medium", weak), ("mtasts-mode", "low", F.col("mode").isin("testing", "none")), ("bimi-dmarc", "low", (F.col("bimi") == "confirmed") & weak)]
    return explode_ids(j, ["domain"], checks).select("domain", "id")


def license_audit(projects: DataFrame, deps: DataFrame) -> DataFrame:
    """(project, id, severity): projects (project, declared, found: the licence of the text) and their dependencies' licences (project, name, license)."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    a, b = flat(F.col("declared")), flat(F.col("found"))
    per = deps.groupBy("project").agg(F.max(copyleft(F.col("license"))).alias("_c"), F.count_if(F.col("license").isNull()).alias("_u"))
    j = projects.join(per, "project", "left")
    checks = [
        ("LIC-001", "low", F.col("found").isNull() & (a == "")), ("LIC-002", "info", F.col("found").isNull() & (a != "")), ("LIC-003", "medium", (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a)),
        ("LIC-004", "info", copyleft(F.coalesce("declared", "found"))), ("LIC-010", "info", F.col("_u") > 0), ("LIC-011", "medium", F.col("_c") & ~F.coalesce(copyleft(F.coalesce("declared", "found")), F.lit(False))),
    ]
    return explode_ids(j, ["project"], checks)


def publish_findings(files: DataFrame) -> DataFrame:
    """(key, id, severity) of paths (key, path) that should not be published."""
    p = F.col("path")
    return explode_ids(files.where("path IS NOT NULL"), ["key"], [
        ("PUB-001", "critical", p.rlike(r"(?i)(?:^|/)(?:\.env(?!\.(?:example|sample|template)$)(?:\.[\w-]+)?|id_(?:rsa|dsa|ecdsa|ed25519)|[^/]+\.(?:pem|p12|pfx|keystore)|\.npmrc|\.netrc|\.pypirc)$")),
        ("PUB-002", "medium", p.rlike(r"(?i)(?:^|/)(?:\.git|\.svn|\.hg)/|\.(?:sqlite3?|db|sql|bak|dump)$")), ("PUB-003", "low", p.rlike(r"(?i)(?:^|/)(?:\.DS_Store|Thumbs\.db|npm-debug\.log|\.idea/.*|\.vscode/.*)$")),
    ])


def young_repositories(repos: DataFrame, day: Column, days: int = 30) -> DataFrame:
    """(repo, age_days, id): repositories (repo, created) made within so many days: a lead."""
    age = F.datediff(day, F.try_to_date(F.left("created", F.lit(10)), "yyyy-MM-dd"))
    return repos.withColumn("age_days", age).where(F.col("age_days").between(0, days)).select("repo", "age_days", F.lit("OSINT-001").alias("id"))


# Shapes of tokens by issuer, for look-ups of whether they live.
PROVIDERS = {"github": r"^gh[opsru]_[A-Za-z0-9]{36,}$|^github_pat_\w{60,}$", "gitlab": r"^glpat-[\w-]{20,}$", "slack": r"^xox[abprs]-[A-Za-z0-9-]{20,}$", "stripe": r"^[rs]k_live_[A-Za-z0-9]{20,}$", "npm": r"^npm_[A-Za-z0-9]{36}$", "aws": r"^(?:AKIA|ASIA)[A-Z2-7]{16}$"}


def liveness(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """(token_fp, provider, id, severity): tokens by the issuer of their shape, with the recorded answer (token_fp, live); live ones are VER-001."""
    provider = F.lit(None).cast("string")
    for name, rx in PROVIDERS.items():
        provider = F.when(F.col("token").rlike(rx), name).otherwise(provider)
    t = tokens.select(F.sha2("token", 256).alias("token_fp"), provider.alias("provider")).where("provider IS NOT NULL").distinct()
    j = t.join(answers.groupBy("token_fp").agg(F.max("live").alias("live")), "token_fp", "left")
    return j.select("token_fp", "provider", F.when(F.col("live"), "VER-001").otherwise("VER-002").alias("id"), F.when(F.col("live"), "critical").otherwise("info").alias("severity"))
