"""Queries p1_...: what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.snapshots import domain_changes, file_changes
from tracewell.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return domain_changes(table(spark, d, "domain_snaps")).unionByName(file_changes(table(spark, d, "file_sigs")))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changes per kind, snapshot and type."""
    return p1_found(spark, d).groupBy("kind", "snap_no", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary}

_DNS = "regexp_replace(lower(trim({x})), '\\.$', '')"
_SET = "array_to_string(list_sort(list_distinct(list_filter(list_transform({c}, lambda x: {f}), lambda x: x IS NOT NULL AND x <> ''))), chr(10))"
_FOUND = f"""
WITH dn AS (
  SELECT {_DNS.format(x='domain_name')} AS owner, CAST(snap_no AS BIGINT) AS snap_no, loaded_at,
         {_SET.format(c='certs', f=_DNS.format(x='x'))} AS certs, {_SET.format(c='ns', f=_DNS.format(x='x'))} AS ns,
         {_SET.format(c='mx', f=_DNS.format(x="regexp_replace(x, '\\s+', ' ', 'g')"))} AS mx
  FROM domain_snaps WHERE domain_name IS NOT NULL AND snap_no IS NOT NULL),
d AS (SELECT * FROM dn QUALIFY row_number() OVER (PARTITION BY owner, snap_no ORDER BY loaded_at DESC NULLS LAST, certs DESC) = 1),
dp AS (SELECT s.snap_no FROM (SELECT DISTINCT snap_no FROM d) s JOIN (SELECT DISTINCT snap_no FROM d) p ON p.snap_no = s.snap_no - 1),
fn AS (
  SELECT root AS owner, regexp_replace(replace(path, chr(92), '/'), '^(\\./+)+', '') AS rec, CAST(snap_no AS BIGINT) AS snap_no, loaded_at,
         regexp_replace(regexp_replace(lower(trim(sha256)), '^0x', ''), '^0+(.)', '\\1') AS sha
  FROM file_sigs WHERE root IS NOT NULL AND path IS NOT NULL AND snap_no IS NOT NULL),
f AS (SELECT * FROM fn QUALIFY row_number() OVER (PARTITION BY owner, rec, snap_no ORDER BY loaded_at DESC NULLS LAST, sha DESC) = 1),
fs AS (SELECT owner, snap_no, lag(snap_no) OVER (PARTITION BY owner ORDER BY snap_no) AS prev FROM (SELECT DISTINCT owner, snap_no FROM f))
SELECT 'domain' AS kind, c.owner, 'record' AS rec_key, c.snap_no, 'added' AS change
  FROM d c JOIN dp USING (snap_no) WHERE NOT EXISTS (SELECT 1 FROM d p WHERE p.owner = c.owner AND p.snap_no = c.snap_no - 1)
UNION ALL SELECT 'domain', p.owner, 'record', p.snap_no + 1, 'removed'
  FROM d p JOIN dp ON dp.snap_no = p.snap_no + 1 WHERE NOT EXISTS (SELECT 1 FROM d c WHERE c.owner = p.owner AND c.snap_no = p.snap_no + 1)
UNION ALL SELECT 'domain', c.owner, k.key, c.snap_no, 'changed'
  FROM d c JOIN d p ON p.owner = c.owner AND p.snap_no = c.snap_no - 1 CROSS JOIN (VALUES ('certs'), ('ns'), ('mx')) k(key)
  WHERE CASE k.key WHEN 'certs' THEN c.certs <> p.certs WHEN 'ns' THEN c.ns <> p.ns ELSE c.mx <> p.mx END
UNION ALL SELECT 'file', c.owner, c.rec, c.snap_no, 'added'
  FROM f c JOIN fs ON fs.owner = c.owner AND fs.snap_no = c.snap_no AND fs.prev IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM f p WHERE p.owner = c.owner AND p.rec = c.rec AND p.snap_no = fs.prev)
UNION ALL SELECT 'file', p.owner, p.rec, fs.snap_no, 'removed'
  FROM f p JOIN fs ON fs.owner = p.owner AND fs.prev = p.snap_no
  WHERE NOT EXISTS (SELECT 1 FROM f c WHERE c.owner = p.owner AND c.rec = p.rec AND c.snap_no = fs.snap_no)
UNION ALL SELECT 'file', c.owner, c.rec, c.snap_no, 'changed'
  FROM f c JOIN fs ON fs.owner = c.owner AND fs.snap_no = c.snap_no JOIN f p ON p.owner = c.owner AND p.rec = c.rec AND p.snap_no = fs.prev
  WHERE c.sha <> p.sha
"""

ORACLE = {"p1_found": _FOUND, "p1_summary": f"SELECT kind, snap_no, change, count(*) AS n FROM ({_FOUND}) GROUP BY ALL"}
