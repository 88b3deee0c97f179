"""Remediations as rewrites: (before, after) of lines, never written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rewrites of one line (id, pattern, replacement).
REWRITES = [
    ("IAC-004", r"(?i)(\bencrypted\b[\"']?\s*[=:]\s*[\"']?)false", "$1true"), ("IAC-005", r"(?i)(publicly_accessible[\"']?\s*[=:]\s*[\"']?)true", "$1false"), ("IAC-009", r"(?i)(\bprivileged[\"']?\s*[=:]\s*[\"']?)true", "$1false"),
    ("PY-005", r"\bverify\s*=\s*False\b", "verify=True"), ("PY-002", r"\byaml\.load\(([^()\n]*)\)", "yaml.safe_load($1)"), ("JS-005", r"rejectUnauthorized\s*:\s*false", "rejectUnauthorized: true"), ("GO-003", r"InsecureSkipVerify\s*:\s*true", "InsecureSkipVerify: false"),
    ("WFA-002", r"permissions:\s*write-all", "permissions: read-all"), ("OWASP-003", r"debug\s*=\s*True", "debug=False"),
]


def rewritten(line: Column, id: str) -> Column:
    for i, rx, to in REWRITES:
        if i == id:
            return F.regexp_replace(line, rx, to)
    return line


def remediations(files: DataFrame) -> DataFrame:
    """(key, line, id, before, after) of every line of texts (key, text) that a rewrite changes."""
    lines = files.where("text IS NOT NULL").select("key", F.posexplode(F.split("text", "\n")).alias("pos", "before"))
    made = F.filter(F.array(*[F.when(F.col("before").rlike(rx), F.struct(F.lit(i).alias("id"), F.regexp_replace("before", rx, to).alias("after"))) for i, rx, to in REWRITES]), lambda x: x.isNotNull())
    return lines.select("key", (F.col("pos") + 1).alias("line"), "before", F.explode(made).alias("_m")).select("key", "line", "_m.id", "before", "_m.after").where("before <> after")


def pinned_steps(files: DataFrame, pins: DataFrame) -> DataFrame:
    """(key, before, after): step references of workflows (key, text) with the commit that a table (action, ref, sha) knows for them; an equi-join."""
    used = files.where("text IS NOT NULL").select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"uses:\s*[\"']?([\w.-]+/[\w./-]+@[\w.-]+)"), F.lit(1)))).alias("before"))
    split = used.withColumns({"action": F.substring_index("before", "@", 1), "ref": F.substring_index("before", "@", -1)})
    met = split.where(~F.col("ref").rlike("^[0-9a-f]{40}$")).join(pins.select("action", "ref", "sha").distinct(), ["action", "ref"])
    return met.select("key", "before", F.concat("action", F.lit("@"), "sha", F.lit(" # "), "ref").alias("after"))


def bumped(deps: DataFrame, fixed: DataFrame) -> DataFrame:
    """(key, name, before, after): dependencies with the least fixed version (ecosystem, name, version) above their own."""
    from tracewell.functions.text import version_key

    f = fixed.select("ecosystem", "name", F.col("version").alias("after"), version_key(F.col("version")).alias("_f")).where("_f IS NOT NULL")
    d = deps.select("key", "ecosystem", "name", F.col("version").alias("before"), version_key(F.col("version")).alias("_d")).where("_d IS NOT NULL")
    return d.join(f, ["ecosystem", "name"]).where("_f > _d").groupBy("key", "name", "before").agg(F.min_by("after", "_f").alias("after"))


def without_user(files: DataFrame) -> DataFrame:
    """(key, before, after) of container build files (key, path, text) that never leave the root user: a USER line behind the last FROM's block."""
    t = F.col("text")
    named = files.where(F.col("path").rlike(r"(?i)(?:^|/)(?:Dockerfile|Containerfile)[^/]*$") & t.rlike(r"(?im)^FROM\s") & ~t.rlike(r"(?im)^USER\s"))
    return named.select("key", t.alias("before"), F.concat(F.rtrim(t), F.lit("\nUSER 65532\n")).alias("after"))
