import pytest

from tracewell.llm.residue import Index, exemplars, find_residue, mend

IX = Index({"the": 900, "to": 500, "this": 400, "error": 50}, 1000)
TEXT = "The policy engine caches the signed manifest whenever two scans overlap, and the lockfile reader reports what it skips. "
PAGE = "<!doctype html><html><head><title>Docs</title></head><body>{}<h1>Docs</h1><p>" + TEXT * 4 + "</p>{}</body></html>"
YES = [
    "<html><body><h1>404 Not Found</h1></body></html>", '{"ok":false,"reason":"Access denied. You don\'t have permission to view this resource."}', "Zugriff verweigert", "VÃ©rification de votre navigateur en cours",
    "<html><body><noscript>Please enable JavaScript to continue.</noscript><div id=a></div><script src=x></script></body></html>", PAGE.format("", "<p>{{title}}</p>"), PAGE.format("", "<p>TODO: write date</p>"), '{"name": "%%PRODUCT%%", "version": "1"}',
    "Lorem ipsum dolor sit amet consectetur magna elit.", "# [INSERT TITLE HERE]\n\n${date}\n", PAGE.format("", "&lt;price goes here&gt;"), "Traceback (most recent call last):\n  File \"/srv/a.py\", line 3, in b\nKeyError: 'c'", "<?xml version='1.0'?><Error><Code>NoSuchKey</Code><RequestId>7c792ec0a0cef187</RequestId></Error>",
]
NO = [
    None, "", "  \n", TEXT * 3, PAGE.format("<noscript>Please enable JavaScript to continue.</noscript>", ""), PAGE.format("", '<p>How it answers with "Access denied. You don\'t have permission to view this resource." is logged.</p>'),
    PAGE.format("", "<pre><code>{{title}}</code></pre>"), PAGE.format("<script>const a = `/${base}/x`;</script>", ""), "name: x\non: push\njobs:\n  build:\n    runs-on: ${{ matrix.os }}\n    steps:\n      - run: make\n", '{"name": "a", "error": null, "readme": "Write `{{x}}` in the layout."}',
]


@pytest.mark.parametrize("body", YES)
def test_residue(body):
    assert IX.residue(body, "https://x.test/a")


@pytest.mark.parametrize("body", NO)
def test_content(body):
    assert IX.residue(body, "https://x.test/a") is None


def test_every_exemplar_is_residue_by_itself():
    for kind, t in exemplars():
        assert IX.marked(t.replace("~", "price")) if kind == "mark" else IX.share([t]) >= 0.35, (kind, t)


def test_marks_are_wholes_of_any_length_and_depth():
    import json

    deep = "value {{ a name of very many words that a designer left in the page and nobody ever filled }} end"
    for _ in range(300):
        deep = [deep, "x"]
    assert IX.residue(json.dumps(deep))[0] == "mark"
    for text in ("Your here", "to be\nwritten down", "a {name} b", "def __init__(self)", "__lower__ x", "TBD is short for it", "${HOME/x", "a [[1, 2]] b", "x %(a b)s", "the [Insert key] on it"):
        assert not IX.marked(text), text
    for text in ("price: TBD", "see *|FIRST NAME|*.", "[YOUR COMPANY NAME HERE]", "dear %(name)s,", "{12} files", "{{user.name|upper}}", "still to be written.", "Your very own price here"):
        assert IX.marked(text), text


def test_sentences_spell_what_the_block_spells():
    from tracewell.llm.residue import sentences, tokens

    for block in ("One. Two! Three?Four: five; six\n\n\"seven\" (eight) .... nine", "", "...", "a\0b. c", "Été.Là 3.5 x.Y\tz", "x" * 5000, "é. " * 300):
        assert [t for s in sentences(block) for t in s] == tokens(block.replace("\0", " "))
    assert IX.residue("Zugriff\0verweigert")


def test_another_table_of_exemplars(spark):
    b = spark.createDataFrame([(1, "u", None, None, "alpha beta gamma"), (2, "u", None, None, TEXT)], "body_id bigint, url string, content_type string, challenge string, text string")
    r = spark.createDataFrame([], "resp_id bigint, url string, headers map<string,string>, body string")
    assert [x.rec_id for x in find_residue(r, b, [("mine", "alpha beta gamma delta")]).collect()] == [1]


def test_very_long_and_odd_bodies():
    assert IX.residue(TEXT * 3000) is None
    assert IX.residue("x" * 300_000) is None
    assert IX.residue("[" * 5000) is None
    assert mend("dÃ©jÃ  â€“ ok") == "déjà – ok" or "déj" in mend("dÃ©jÃ  â€“ ok")


def test_operator(spark):
    r = spark.createDataFrame([(1, "https://x.test", {"content-type": "text/html"}, YES[0], 1), (1, "https://x.test", None, YES[0], 1), (2, None, None, None, 1), (3, "u", None, NO[3], 1)], "resp_id bigint, url string, headers map<string,string>, body string, tab int")
    b = spark.createDataFrame([(1, "u", None, None, YES[1]), (2, "u", None, "Bearer x", NO[9])], "body_id bigint, url string, content_type string, challenge string, text string")
    assert sorted((x.tab, x.rec_id) for x in find_residue(r, b).collect()) == [("raw_bodies", 1), ("responses", 1)]
    assert find_residue(r.limit(0), b.limit(0)).count() == 0
