"""Queries of the text operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.authored import DIRS_RE, LOCK_RE, NAME_RE, PAIRS_RE, find_not_authored, judged_files, judged_rows, path_evidence, plain_path, shared_subtrees
from tracewell.llm.chunking import split_documents
from tracewell.llm.leakage import find_leaks
from tracewell.llm.linkage import clustered, repeats, scored_links
from tracewell.llm.residue import find_residue
from tracewell.llm.secrets import find_credentials, learn_words
from tracewell.llm.setjoin import components, expand, similar_sets
from tracewell.llm.tokens import encode_column, encode_corpus
from tracewell.session import table


def _credentials(spark: SparkSession, d: str) -> DataFrame:
    """Findings that show a credential, with the words of all documents and of all indexed files as the dictionary."""
    corpus = table(spark, d, "documents").select("text").unionByName(table(spark, d, "files").select("text"))
    return find_credentials(table(spark, d, "findings"), words=learn_words(corpus))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _credentials(spark, d).select("finding_id")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The excerpts that show a credential, with nothing but its value replaced."""
    return _credentials(spark, d).select("finding_id", "redacted", "n_values")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "responses"), table(spark, d, "raw_bodies")).select("tab", "rec_id")


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Records to exclude by table and kind of evidence."""
    return find_residue(table(spark, d, "responses"), table(spark, d, "raw_bodies")).groupBy("tab", "evidence").agg(F.count(F.lit(1)).alias("records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(table(spark, d, "findings")).select("finding_id")


def p4_scans(spark: SparkSession, d: str) -> DataFrame:
    """Repeats per scan beside what the scan itself counted as known."""
    found = repeats(table(spark, d, "findings")).groupBy("scan_id").agg(F.count(F.lit(1)).alias("repeats"))
    scans = table(spark, d, "scans").select("scan_id", "baselined").groupBy("scan_id").agg(F.max("baselined").alias("baselined"))
    return scans.join(found, "scan_id", "left").select("scan_id", F.coalesce("repeats", F.lit(0)).alias("repeats"), "baselined")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with its issue text and the cluster of issue texts linked to it."""
    return clustered(table(spark, d, "findings"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Near links between issue texts with their learned score."""
    return scored_links(table(spark, d, "findings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = similar_sets(table(spark, d, "files"))
    return expand(members, pairs).select(F.col("x").alias("file_id_a"), F.col("y").alias("file_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every file with a large enough set: its class of equal sets, its group and the class's number of links."""
    members, pairs = similar_sets(table(spark, d, "files"))
    reps = members.where(F.col("id") == F.col("rep")).select("id")
    groups = components(reps, pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(groups.withColumnRenamed("id", "rep"), "rep").join(links, "rep", "left")
        .select(F.col("id").alias("file_id"), F.col("rep").alias("class_id"), F.col("group").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_not_authored(table(spark, d, "files"), table(spark, d, "findings")).select("tab", "rec_id")


def p6_authored(spark: SparkSession, d: str) -> DataFrame:
    """The files that remain as hand-written source."""
    return judged_files(table(spark, d, "files")).where(F.col("evidence").isNull()).select("file_id", "root", "path")


def p6_shared_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Files and directories whose Merkle hash stands in roots of different owners."""
    return shared_subtrees(judged_rows(table(spark, d, "files")))


def p6_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Files by their evidence and by what they would be judged by without the Merkle hashes."""
    return judged_files(table(spark, d, "files")).groupBy("evidence", "own").agg(F.count(F.lit(1)).alias("files"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Findings' paths by what they tell."""
    rows = table(spark, d, "findings").where("finding_id IS NOT NULL AND path IS NOT NULL").select("finding_id", plain_path(F.col("path")).alias("path")).distinct()
    return rows.groupBy(path_evidence(F.col("path")).alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters by kind of document."""
    docs = table(spark, d, "documents").select("kind", F.size(encode_column(F.col("text"))).alias("n"))
    return docs.groupBy("kind").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items that leaked, with the number of documents that give them away."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"))


QUERIES = {
    "p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_evidence": p3_evidence,
    "p4_found": p4_found, "p4_scans": p4_scans, "p4_links": p4_links, "p4_clusters": p4_clusters,
    "p5_found": p5_found, "p5_groups": p5_groups,
    "p6_found": p6_found, "p6_authored": p6_authored, "p6_shared_subtrees": p6_shared_subtrees, "p6_evidence": p6_evidence, "p6_paths": p6_paths,
    "p7_ids": p7_ids, "p7_counts": p7_counts,
    "p8_found": p8_found, "p8_items": p8_items, "p9_pieces": p9_pieces,
}

_P5 = """
WITH f AS (SELECT file_id, any_value(hex(fp)) AS h FROM files WHERE fp IS NOT NULL AND octet_length(fp) >= 160 AND file_id IS NOT NULL GROUP BY file_id),
s AS (SELECT DISTINCT file_id, substr(h, CAST(i * 16 + 1 AS BIGINT), 16) AS x FROM f, unnest(range(CAST(length(h) // 16 AS BIGINT))) t(i)),
n AS (SELECT file_id, count(*) AS n FROM s GROUP BY file_id HAVING count(*) >= 20),
c AS (SELECT a.file_id AS file_id_a, b.file_id AS file_id_b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.file_id < b.file_id GROUP BY ALL)
SELECT file_id_a, file_id_b FROM c JOIN n na ON na.file_id = file_id_a JOIN n nb ON nb.file_id = file_id_b
WHERE 10 * i >= 7 * (na.n + nb.n - i)
"""

# DuckDB counts edits in bytes: each distinct word of a pair is spelled as one ASCII character (short excerpts have fewer than 95).
_P4 = """
WITH f AS (
  SELECT finding_id, any_value(scan_id) AS scan_id, any_value(target) AS target, any_value(rule_id) AS rule_id,
         any_value(CASE WHEN excerpt IS NOT NULL THEN regexp_extract_all(excerpt, '[\\p{L}\\p{N}_]+') END) AS w,
         any_value(regexp_replace(replace(path, chr(92), '/'), '^(\\./+)+', '')) AS path, any_value(message) AS message
  FROM findings WHERE finding_id IS NOT NULL AND scan_id IS NOT NULL AND target IS NOT NULL AND rule_id IS NOT NULL GROUP BY finding_id),
u AS (SELECT target, rule_id, w, min(scan_id) AS first FROM f WHERE w IS NOT NULL GROUP BY ALL),
v AS (
  SELECT a.target, a.rule_id, a.w, min(b.first) AS first FROM u a JOIN u b ON a.target = b.target AND a.rule_id = b.rule_id
  AND 5 * abs(len(a.w) - len(b.w)) <= greatest(len(a.w), len(b.w))
  AND 5 * levenshtein(
    array_to_string(list_transform(a.w, lambda x: chr(CAST(31 + list_position(list_distinct(list_concat(a.w, b.w)), x) AS INTEGER))), ''),
    array_to_string(list_transform(b.w, lambda x: chr(CAST(31 + list_position(list_distinct(list_concat(a.w, b.w)), x) AS INTEGER))), '')
  ) <= greatest(len(a.w), len(b.w)) GROUP BY ALL),
n AS (SELECT target, rule_id, path, message, min(scan_id) AS first FROM f WHERE w IS NULL GROUP BY ALL)
SELECT f.finding_id FROM f JOIN v ON v.target = f.target AND v.rule_id = f.rule_id AND v.w = f.w WHERE v.first < f.scan_id
UNION ALL
SELECT f.finding_id FROM f JOIN n ON n.target = f.target AND n.rule_id = f.rule_id AND n.path IS NOT DISTINCT FROM f.path
  AND n.message IS NOT DISTINCT FROM f.message WHERE f.w IS NULL AND n.first < f.scan_id
"""
_P4_SCANS = f"""
SELECT s.scan_id, coalesce(r.repeats, 0) AS repeats, s.baselined FROM (SELECT scan_id, max(baselined) AS baselined FROM scans GROUP BY scan_id) s
LEFT JOIN (SELECT scan_id, count(*) AS repeats FROM ({_P4}) JOIN (SELECT DISTINCT finding_id, scan_id FROM findings) USING (finding_id) GROUP BY scan_id) r USING (scan_id)
"""
# Groups are the least id that union by label spreading over the pairs reaches; classes and links follow from the sets.
_P5_GROUPS = """
WITH RECURSIVE f AS (SELECT file_id, any_value(hex(fp)) AS h FROM files WHERE fp IS NOT NULL AND octet_length(fp) >= 160 AND file_id IS NOT NULL GROUP BY file_id),
s AS (SELECT DISTINCT file_id, substr(h, CAST(i * 16 + 1 AS BIGINT), 16) AS x FROM f, unnest(range(CAST(length(h) // 16 AS BIGINT))) t(i)),
n AS (SELECT file_id, count(*) AS n, md5(string_agg(x, '' ORDER BY x)) AS p FROM s GROUP BY file_id HAVING count(*) >= 20),
m AS (SELECT file_id, n, min(file_id) OVER (PARTITION BY p) AS class_id FROM n),
c AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.file_id < b.file_id WHERE a.file_id IN (SELECT class_id FROM m) AND b.file_id IN (SELECT class_id FROM m) GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n na ON na.file_id = c.a JOIN n nb ON nb.file_id = c.b WHERE 10 * i >= 7 * (na.n + nb.n - i)),
y AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
g AS (SELECT class_id AS id, class_id AS l FROM m WHERE file_id = class_id UNION SELECT y.b, g.l FROM g JOIN y ON y.a = g.id),
k AS (SELECT id, min(l) AS group_id FROM g GROUP BY id),
d AS (SELECT a AS id, count(*) AS links FROM y GROUP BY a)
SELECT m.file_id, m.class_id, k.group_id, coalesce(d.links, 0) AS links FROM m JOIN k ON k.id = m.class_id LEFT JOIN d ON d.id = m.class_id
"""
# Words without accents and invisible characters; each run of twelve (or the whole item) is joined by its hash.
_PLAIN = "regexp_extract_all(strip_accents(lower(regexp_replace({}, '\\p{{Cf}}|\\p{{Mn}}', '', 'g'))), '[\\p{{L}}\\p{{N}}]+')"
_P8 = f"""
WITH i AS (SELECT item_id, {_PLAIN.format('text')} AS w FROM (SELECT item_id, any_value(text) AS text FROM eval_items GROUP BY item_id)), i2 AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM (SELECT doc_id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id)),
ir AS (SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: md5(array_to_string(w[k:k + n - 1], ' ')))) AS h FROM i2),
dr AS (SELECT doc_id, n, unnest(list_transform(range(1, greatest(len(w) - n + 1, 0) + 1), lambda k: md5(array_to_string(w[k:k + n - 1], ' ')))) AS h FROM d, (SELECT DISTINCT n FROM i2))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (n, h)
"""
_P6_PATHS = """
WITH f AS (SELECT DISTINCT finding_id, regexp_replace(replace(path, chr(92), '/'), '^(\\./+)+', '') AS p FROM findings WHERE finding_id IS NOT NULL AND path IS NOT NULL),
e AS (SELECT CASE WHEN regexp_matches(p, '{lock}') THEN 'lock file' WHEN regexp_matches(p, '{dirs}') OR regexp_matches(p, '{pairs}') THEN 'directory' WHEN regexp_matches(p, '{name}') THEN 'name' END AS evidence FROM f)
SELECT evidence, count(*) AS n FROM e GROUP BY 1
""".format(lock=LOCK_RE, dirs=DIRS_RE, pairs=PAIRS_RE, name=NAME_RE)
ORACLE: dict[str, str] = {"p5_groups": _P5_GROUPS, "p8_found": _P8, "p8_items": f"SELECT item_id, count(*) AS documents FROM ({_P8}) GROUP BY item_id", "p6_paths": _P6_PATHS, "p4_found": _P4, "p4_scans": _P4_SCANS, "p5_found": _P5}
