"""Queries of similarity, style and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators import events as E
from tracewell.operators import similarity as S
from tracewell.operators import style as Y
from tracewell.session import table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "kind", "source")


def _files(spark, d):
    return table(spark, d, "files").select(F.col("file_id").alias("key"), "text")


def q_winnow(spark, d):
    """Winnowed fingerprints of the documents."""
    return S.fingerprints(_docs(spark, d), S.word_tokens(F.col("text"))).select(F.col("key").alias("doc_id"), "shingles", "hashes")


def q_exact_duplicates(spark, d):
    """Documents whose text stands more than once, with their class (least id)."""
    x = _docs(spark, d).where("text IS NOT NULL").select("key", F.md5("text").alias("h"))
    c = x.groupBy("h").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return x.join(c, "h").select(F.col("key").alias("doc_id"), "class_id", "copies")


def q_repeated_lines(spark, d):
    """Lines of at least twenty characters that stand in more than three documents."""
    lines = _docs(spark, d).select("key", F.explode(F.split("text", "\n")).alias("line")).select("key", F.trim("line").alias("line")).where(F.length("line") >= 20).distinct()
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("docs")).where("docs > 3")


def q_similar_files(spark, d):
    """Classified pairs of files (representatives of equal fingerprints): all copies and all that embed another."""
    _, pairs = S.similar(S.fingerprints(_files(spark, d), S.code_tokens(F.col("text"))))
    return S.classify(pairs).select("a", "b", "kind", F.round("jaccard", 6).alias("jaccard"))


def q_file_classes(spark, d):
    """Every fingerprinted file with the representative of its class."""
    members, _ = S.similar(S.fingerprints(_files(spark, d), S.code_tokens(F.col("text"))))
    return members.select(F.col("key").alias("file_id"), F.col("rep").alias("class_id"))


def q_minhash_64(spark, d):
    """Sixty-four exact minima of the files' fingerprints."""
    fp = S.fingerprints(_files(spark, d), S.word_tokens(F.col("text")))
    return fp.select(F.col("key").alias("file_id"), S.minima(F.col("hashes")).alias("minima"))


def q_function_words(spark, d):
    return Y.function_word_rates(_docs(spark, d)).select(F.col("key").alias("doc_id"), "word", "rate")


def q_kind_cosine(spark, d):
    """Cosine of each kind's function words to those of the reports."""
    rows = _docs(spark, d).select(F.col("kind").alias("key"), "text")
    words = rows.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))).alias("word"))
    n = words.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rates = words.where(F.col("word").isin(*Y.FUNCTION_WORDS)).groupBy("key", "word").agg(F.count(F.lit(1)).alias("c")).join(n, "key").select("key", "word", (F.col("c") / F.col("n")).alias("rate"))
    return Y.group_cosine(rates, "report").select(F.col("key").alias("kind"), "cosine")


def q_trigram_topk(spark, d):
    return Y.top_trigrams(_docs(spark, d), "kind", 200)


def q_layout(spark, d):
    rows = _docs(spark, d).where(F.length("text") > 0)
    return rows.select(F.col("key").alias("doc_id"), *[c.alias(k) for k, c in Y.layout(F.col("text")).items()])


def q_embedding_cosine(spark, d):
    """Cosine of every vector to the centroid of its label."""
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).join(parts, ["label", "i"])
    s = x.groupBy("vec_id", "label").agg(F.sum(F.col("x") * F.col("m")).alias("xy"), F.sum(F.col("x").cast("double") * F.col("x")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("yy"))
    return s.select("vec_id", "label", F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 5).alias("cosine"))


def q_events_by_kind(spark, d):
    return E.by_kind(table(spark, d, "events").select(E.kind(F.col("event_type")).alias("kind")), "kind")


def q_events_json_field(spark, d):
    """Sum of a field picked from the payload."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k") >= 50).alias("high"))


def q_actor_first_last(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_kind"))


def q_burst_24h(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return E.burst(e, "user_id", "s")


def q_gap_median(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return E.gap_medians(e, "user_id", "s")


def q_chain_breaks(spark, d):
    """Events of a user read as pushes: head is the payload, before the payload of the event two back where that is odd."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    head = F.get_json_object("props", "$.k")
    before = F.when(F.get_json_object("props", "$.k").cast("int") % 7 == 0, F.lit("0")).otherwise(F.lag(head).over(w))
    pushes = e.select("event_id", F.col("user_id").alias("repo"), F.col("event_type").alias("ref"), F.col("ts").alias("created"), head.alias("head"), before.alias("before"))
    return E.chain_breaks(pushes).select("event_id", "before", "expected")


def q_hourly(spark, d):
    """Extension: tumbling hours."""
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v")).select(F.col("w.start").alias("hour"), "event_type", "n", "v")


def q_sessions(spark, d):
    return E.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")


def q_event_cursor(spark, d):
    """Events newer than the last one seen of each kind's first half."""
    e = table(spark, d, "events")
    seen = e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp")).groupBy("event_type").agg(F.max("event_id").alias("cursor"))
    return e.join(seen, "event_type").where("event_id > cursor").select("event_id", "event_type")


def q_rotation(spark, d):
    """Live, removed and reappeared issue texts: findings of a target's scans as added and removed lines."""
    f = table(spark, d, "findings").where("excerpt IS NOT NULL").select("target", "scan_id", F.sha2("excerpt", 256).alias("h")).distinct()
    order = Window.partitionBy("target").orderBy("scan_id")
    scans = f.select("target", "scan_id").distinct().withColumns({"o": F.row_number().over(order), "after": F.lead("scan_id").over(order)})
    last = scans.groupBy("target").agg(F.max(F.struct("o", "scan_id")).alias("end"))
    seen = f.join(scans, ["target", "scan_id"]).join(last, "target")
    # A text stands in some scans: a line is added at each, and removed at the first without it and, if it is gone, at the last.
    w = Window.partitionBy("target", "h").orderBy("o")
    steps = seen.withColumn("next", F.lead("o").over(w))
    gone = F.coalesce(F.col("next") > F.col("o") + 1, F.col("o") < F.col("end.o"))
    line = lambda scan, sign: F.struct(scan.alias("ts"), F.lit(sign).alias("sign"))
    made = F.filter(F.array(line(F.col("scan_id"), "+"), F.when(gone, line(F.col("after"), "-")), F.when(gone & F.col("next").isNull(), line(F.col("end.scan_id"), "-"))), lambda x: x.isNotNull())
    lines = steps.select(F.concat_ws("|", "target", "h").alias("fp"), F.explode(made).alias("l")).select("fp", "l.ts", F.col("l.ts").cast("string").alias("sha"), "l.sign")
    return E.rotation(lines).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_scan"))


def q_provenance(spark, d):
    """Scores of targets from the severities of their findings as evidence."""
    f = table(spark, d, "findings").select(F.col("target").alias("subject"), "rule_id", F.lower("severity").alias("s")).distinct()
    ev = f.select("subject", F.when(F.col("s") == "critical", "high").when(F.col("s") == "high", "medium").otherwise("low").alias("tier"))
    return E.provenance(ev)


def q_compromise_windows(spark, d):
    """Findings recorded within given windows."""
    win = spark.createDataFrame([("W1", "2025-01-10", "2025-01-20"), ("W2", "2025-03-01", "2025-03-02")], "id string, start string, end string").select("id", F.to_timestamp("start").alias("start"), F.to_timestamp("end").alias("end"))
    return E.in_windows(table(spark, d, "findings").select("finding_id", "recorded_at"), "recorded_at", win).select("finding_id", "id").distinct()


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_FW = ", ".join(f"'{w}'" for w in Y.FUNCTION_WORDS)
_SH = "list_transform(range(1, len(t) - 3), lambda i: CAST(('0x' || left(md5(array_to_string(t[i:i+4], ' ')), 15)) AS BIGINT))"
_WIN = f"""WITH k AS (SELECT {{id}} AS id, any_value(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM {{tab}} GROUP BY 1),
  h AS (SELECT id, {_SH} AS h FROM k WHERE len(t) >= 5),
  m AS (SELECT id, len(h) AS n, list_transform(range(1, greatest(len(h) - 14, 1) + 1), lambda i: list_min(h[i:i+14])) AS m FROM h),
  fp AS (SELECT id, CAST(n AS INTEGER) AS shingles, list_filter(m, lambda x, i: i = 1 OR x <> m[i-1]) AS hashes FROM m)"""

ORACLE = {
    "q_winnow": _WIN.format(id="doc_id", tab="documents") + " SELECT id AS doc_id, shingles, hashes FROM fp",
    "q_exact_duplicates": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL QUALIFY copies > 1",
    "q_repeated_lines": "SELECT line, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) > 3",
    "q_minhash_64": _WIN.format(id="file_id", tab="files") + " SELECT id AS file_id, [" + ", ".join(f"CAST(list_min(list_transform(hashes, lambda x: (CAST(x AS HUGEINT) * {a}::HUGEINT + {b}::HUGEINT) % {S.PRIME}::HUGEINT)) AS BIGINT)" for a, b in S.coefficients()) + "] AS minima FROM fp",
    "q_function_words": f"""WITH w AS (SELECT doc_id, any_value(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM documents GROUP BY doc_id)
        SELECT doc_id, word, round(count(*) / CAST(n AS DOUBLE), 6) AS rate FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM w) WHERE word IN ({_FW}) GROUP BY doc_id, word, n""",
    "q_kind_cosine": f"""WITH w AS (SELECT kind, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents), n AS (SELECT kind, count(*) AS n FROM w GROUP BY kind),
        r AS (SELECT kind, word, count(*) / CAST(any_value(n.n) AS DOUBLE) AS rate FROM w JOIN n USING (kind) WHERE word IN ({_FW}) GROUP BY kind, word),
        a AS (SELECT word, rate AS r FROM r WHERE kind = 'report')
        SELECT kind, round(coalesce(sum(rate * r), 0) / (sqrt(sum(rate * rate)) * (SELECT sqrt(sum(r * r)) FROM a)), 3) AS cosine FROM r LEFT JOIN a USING (word) GROUP BY kind""",
    "q_trigram_topk": """WITH t AS (SELECT kind, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM documents), g AS (SELECT kind, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, CAST(i AS BIGINT), 3))) AS trigram FROM t WHERE length(t) >= 3)
        SELECT kind, trigram, count(*) AS n FROM g GROUP BY kind, trigram QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, trigram) <= 200""",
    "q_layout": """SELECT doc_id, CAST(floor(len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \\t\\r]', '', 'g') = '')) * 1000000.0::DOUBLE / len(string_split(text, chr(10)))) AS BIGINT) AS blank_lines, CAST(floor(length(text) * 1000.0::DOUBLE / len(string_split(text, chr(10)))) AS BIGINT) AS mean_line,
        """ + ", ".join(f"CAST(floor((length(text) - length(regexp_replace(text, '{rx}', '', 'g'))) * 1000000.0::DOUBLE / length(text)) AS BIGINT) AS {k}" for k, rx in (("digits", "[0-9]"), ("upper", "[A-Z]"), ("punctuation", "[.,;:!?]"), ("brackets", r"[(){}\[\]]"))) + " FROM documents WHERE length(text) > 0",
    "q_embedding_cosine": """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL)
        SELECT vec_id, label, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 5) AS cosine FROM x JOIN m USING (label, i) GROUP BY vec_id, label""",
    "q_events_by_kind": "SELECT lower(event_type) || 'event' AS kind, count(*) AS n FROM events GROUP BY 1",
    "q_events_json_field": "SELECT event_type, CAST(sum(k) AS BIGINT) AS total, count(*) FILTER (k >= 50) AS high FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "q_actor_first_last": "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, arg_min(event_type, (ts, event_id)) AS first_kind FROM events GROUP BY user_id",
    "q_burst_24h": "SELECT user_id, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS n FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)) GROUP BY user_id",
    "q_gap_median": """WITH g AS (SELECT user_id, event_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))
        SELECT user_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY user_id""",
    "q_chain_breaks": """WITH p AS (SELECT event_id, user_id, event_type, ts, json_extract_string(props, '$.k') AS head FROM events), q AS (SELECT *, lag(head) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS expected FROM p)
        SELECT event_id, '0' AS before, expected FROM q WHERE expected IS NOT NULL AND CAST(head AS INT) % 7 = 0 AND expected <> '0'""",
    "q_hourly": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2",
    "q_sessions": """WITH a AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS brk FROM events), b AS (SELECT *, sum(coalesce(brk, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s""",
    "q_event_cursor": "SELECT e.event_id, e.event_type FROM events e JOIN (SELECT event_type, max(event_id) AS c FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) c ON c.event_type = e.event_type WHERE e.event_id > c.c",
    "q_rotation": """WITH f AS (SELECT DISTINCT target, scan_id, excerpt FROM findings WHERE excerpt IS NOT NULL), s AS (SELECT DISTINCT target, scan_id FROM f), lo AS (SELECT target, excerpt, min(scan_id) AS lo FROM f GROUP BY ALL),
        g AS (SELECT lo.target, lo.excerpt, s.scan_id, f.scan_id IS NOT NULL AS here FROM lo JOIN s ON s.target = lo.target AND s.scan_id >= lo.lo LEFT JOIN f ON f.target = lo.target AND f.excerpt = lo.excerpt AND f.scan_id = s.scan_id),
        -- the order of steps is by scan and then by its text, as commits of one second would be
        w AS (SELECT *, lag(here) OVER (PARTITION BY target, excerpt ORDER BY scan_id) AS was FROM g),
        r AS (SELECT target, excerpt, arg_max(here, scan_id) AS present, max(scan_id) AS last, max(scan_id) FILTER (here AND NOT coalesce(was, true)) AS again FROM w GROUP BY ALL)
        SELECT state, count(*) AS n, max(ts) AS last_scan FROM (SELECT CASE WHEN NOT present THEN 'Removed' WHEN again IS NOT NULL THEN 'Reappeared' ELSE 'Live' END AS state, CASE WHEN present AND again IS NOT NULL THEN again ELSE last END AS ts FROM r) GROUP BY state""",
    "q_provenance": """WITH e AS (SELECT DISTINCT target, rule_id, lower(severity) AS s FROM findings), g AS (SELECT target, least(30, 4 * count(*) FILTER (s NOT IN ('critical', 'high'))) + 40 * count(*) FILTER (s = 'critical') + 15 * count(*) FILTER (s = 'high') AS x FROM e GROUP BY target)
        SELECT target AS subject, CAST(least(x, 100) AS INTEGER) AS score, CASE WHEN x >= 70 THEN 'likely' WHEN x >= 40 THEN 'possible' WHEN x >= 15 THEN 'weak' ELSE 'none' END AS verdict FROM g""",
    "q_compromise_windows": """SELECT DISTINCT finding_id, id FROM findings JOIN (VALUES ('W1', TIMESTAMP '2025-01-10', TIMESTAMP '2025-01-20'), ('W2', TIMESTAMP '2025-03-01', TIMESTAMP '2025-03-02')) w(id, s, e) ON recorded_at BETWEEN s AND e""",
}
