import random
import struct

from tracewell.llm.setjoin import components, expand, similar_sets

SCHEMA = "file_id bigint, fp binary, rep string"


def pack(xs):
    return b"".join(struct.pack("<Q", x) for x in xs)


def sample(n=220, seed=5, hot=60):
    rnd = random.Random(seed)
    base = [[rnd.getrandbits(64) for _ in range(rnd.randint(15, 90))] for _ in range(25)]
    common = [rnd.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(n):
        s = list(rnd.choice(base))
        for _ in range(rnd.randint(0, len(s) // 4)):
            s[rnd.randrange(len(s))] = rnd.getrandbits(64)
        if rnd.random() < 0.3:
            s = s[: int(len(s) * 0.8)]
        rows.append((i, pack(s + common + s[:3]), "x"))
    rows += [(1000 + i, rows[0][1], "x") for i in range(hot)]
    return [*rows, (5000, None, "x"), (5001, b"", "x"), (None, rows[0][1], "x"), (5002, pack(range(19)), "x"), (5003, pack(range(20)), "x"), (5004, pack(range(20)) + b"abc", "x")]


def brute(rows, t=0.7):
    sets = {i: {x[k : k + 8] for k in range(0, len(x) // 8 * 8, 8)} for i, x, _ in rows if x and i is not None}
    ids = sorted(i for i, s in sets.items() if len(s) >= 20)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def test_pairs_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    members, pairs = similar_sets(df.union(df))
    got = [(r.x, r.y) for r in expand(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_other_thresholds(spark):
    rows = sample(120, 9, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    for t in (0.5, 0.9):
        members, pairs = similar_sets(df, t=t)
        assert {(r.x, r.y) for r in expand(members, pairs).collect()} == brute(rows, t)


def test_groups_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 61), 100, 101, 102, 200]], "id bigint")
    got = {r.id: r.group for r in components(nodes, edges).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[102] == 100 and got[200] == 200
    members, pairs = similar_sets(spark.createDataFrame([], SCHEMA))
    assert expand(members, pairs).count() == 0
