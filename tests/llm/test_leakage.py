import random

import pytest

from tracewell.llm.leakage import Bm25Index, bounded_items, find_leaks, words


def test_words():
    assert words("Été—ne­w ﬁx x_y​z ÅB1") == ["ete", "new", "fix", "x", "yz", "ab1"] and words(None) == [] == words("")


def brute(text, items, run=12):
    w, out = words(text), set()
    for i, t in items:
        own = words(t)
        n = min(run, len(own))
        if n and any(own[a : a + n] == w[b : b + n] for a in range(len(own) - n + 1) for b in range(len(w) - n + 1)):
            out.add(i)
    return out


def test_against_brute_force():
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 40)))) for i in range(50)] + [(90, None), (91, "the the the the")]
    ix = Bm25Index(items)
    hits = 0
    for _ in range(400):
        w = rnd.choices(vocab + ["zz"], k=rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 2)):
            own = words(rnd.choice(items[:50])[1])
            if own:
                a = rnd.randrange(len(own))
                at = rnd.randint(0, len(w))
                w[at:at] = own[a : a + rnd.randint(8, 14)]
        text = " - ".join(w)
        want = brute(text, items)
        hits += len(want)
        assert ix.leaks(text) == want
    assert hits > 50


def test_operator(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, None), (3, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x ALPHA, bêta​: gamma y", 1), (1, "x ALPHA, beta: gamma y", 1), (2, None, 1), (3, "alpha gamma beta", 1)], "doc_id bigint, text string, item_id int")
    assert [tuple(r) for r in find_leaks(docs, items).collect()] == [(1, 1)]
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        bounded_items(items, "item_id", "text", 3)
