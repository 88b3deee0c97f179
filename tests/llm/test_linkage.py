import random

from tracewell.llm.linkage import History, clustered, deliver, latest_clusters, least_score, learn_weights, link_batch, repeats, score_of, scored_links, update_clusters

SCHEMA = "finding_id bigint, scan_id bigint, target string, rule_id string, severity string, path string, line int, excerpt string, message string, words int"


def words(s):
    import re

    return re.findall(r"\w+", s)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    out = set()
    for r in rows:
        for q in rows:
            if r[1] is None or r[2] is None or r[3] is None or q[:4].count(None) or not (q[1] < r[1] and q[2] == r[2] and q[3] == r[3]):
                continue
            if (r[7] is None) != (q[7] is None):
                continue
            if r[7] is None:
                same = r[5].replace("\\", "/") == q[5].replace("\\", "/") and r[8] == q[8]
            else:
                a, b = words(r[7]), words(q[7])
                same = 5 * distance(a, b) <= max(len(a), len(b))
            if same:
                out.add(r[0])
                break
    return out


def sample(n=260, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(9)]
    rows, texts = [], [[rnd.choice(vocab) for _ in range(rnd.randint(0, 16))] for _ in range(25)]
    for i in range(n):
        t = list(rnd.choice(texts))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randint(0, 2)
            if k == 0 and t:
                t.pop(rnd.randrange(len(t)))
            elif k == 1:
                t.insert(rnd.randint(0, len(t)), rnd.choice(vocab))
            elif t:
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
        excerpt = None if rnd.random() < 0.1 else (" . ".join(t) if rnd.random() < 0.5 else "(" + " ".join(t) + ")")
        rows.append((i, rnd.randint(1, 9), rnd.choice(["t", "u", None]), rnd.choice(["A", "B"]), "low", rnd.choice(["a/b", "a\\b", "c"]), 1, excerpt, rnd.choice(["m", None]), 0))
    return rows


def test_against_brute_force_and_in_any_batches(spark, tmp_path):
    rows = sample()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.finding_id for r in repeats(df.union(df)).collect()} == want
    got = set()
    for i, (lo, hi) in enumerate([(1, 3), (4, 4), (5, 9)]):
        history = History(spark, f"file://{tmp_path}/h", i)  # each batch by a process of its own
        marked = link_batch(history, df.where(f"scan_id BETWEEN {lo} AND {hi}"))
        got |= {r.finding_id for r in marked.where("first_earlier_scan < scan_id").collect()}
        update_clusters(history)
    assert got == want
    # clusters do not depend on the batches
    whole, kept = {}, {}
    for r in clustered(df, 1).collect():
        whole.setdefault(r.cluster, set()).add(r.issue)
    reps = {r.issue for r in history.read("reps").collect()}
    moved = {r.issue: r.cluster for r in latest_clusters(history).collect()}
    for i in reps:
        kept.setdefault(moved.get(i, i), set()).add(i)
    assert sorted(map(len, kept.values())) == sorted(map(len, whole.values()))


def test_a_batch_writes_only_its_own_directory_and_a_failed_one_can_be_repeated(spark, tmp_path):
    import os

    df = spark.createDataFrame(sample(), SCHEMA)
    history = History(spark, f"file://{tmp_path}/h")
    link_batch(history, df.where("scan_id <= 4")).count()
    seen = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in fs if "batch=0" in d}
    before = seen()
    link_batch(history, df.where("scan_id > 4")).count()
    again = link_batch(History(spark, f"file://{tmp_path}/h", 1), df.where("scan_id > 4"))
    assert seen() == before
    assert {r.finding_id for r in again.where("first_earlier_scan < scan_id").collect()} == {i for i in brute(sample()) if [r for r in sample() if r[0] == i][0][1] > 4}


def test_the_score_prunes_no_link():
    weights = learn_weights([((True, True, True, False, False), 30), ((False, True, False, False, False), 50), ((True, False, False, True, True), 7)])
    assert min(score_of(b | 1, weights) for b in range(0, 32, 2)) >= least_score(weights) - 1e-9


def test_long_texts_ties_and_empty(spark):
    long = " ".join(f"v{i}" for i in range(1200))
    near = " ".join(f"v{i}" if i % 6 else f"z{i}" for i in range(1200))
    rows = [(1, 1, "t", "A", "x", "p", 1, long, "m", 0), (2, 2, "t", "A", "x", "p", 1, near, "m", 0), (3, 2, "t", "A", "x", "p", 1, "!!", "m", 0), (4, 3, "t", "A", "x", "p", 1, "", "m", 0), (5, 1, "t", "A", "x", "p", 1, "only", "m", 0), (6, 1, "t", "A", "x", "p", 1, "only", "m", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.finding_id for r in repeats(df).collect()} == {2, 4}
    assert repeats(df.limit(0)).count() == 0
    # keys per text grow with its fifth part, not with its power
    history = deliver(df, 1)
    assert history.read("keys").groupBy("issue").count().agg({"count": "max"}).first()[0] == 241


def test_scores_are_finite(spark):
    got = scored_links(spark.createDataFrame(sample(80), SCHEMA)).collect()
    assert got and all(abs(r.score) < 100 and 5 * r.distance <= r.longer for r in got)
