import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm.chunking import merge, split, split_documents
from tracewell.llm.tokens import decode, decode_column, encode, encode_corpus, rank_path, safe_parts

PATH = rank_path()
ODD = ["", " ", "\n\n\n", "a  b", "x <|endoftext|> y", "naïve café 漢字 🙂🙂", "a" * 5000, " " * 3000, "漢" * 3000, "line\n" * 900, "word " * 2000, "​\u0000﻿", "'s 'll don't"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_round_trip_and_safe_parts(text):
    ids = encode(text, PATH)
    assert decode(ids, PATH) == text
    assert [i for p in safe_parts(text, 7) for i in encode(p, PATH)] == ids and "".join(safe_parts(text, 7)) == text


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys(text):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    assert encode(text, PATH, 50) == t.encode(text, add_special_tokens=False).ids


def test_corpus(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5)], "doc_id bigint, text string, ids int")
    out = encode_corpus(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == {1: encode("a b", PATH), 2: [], 3: []}
    assert [r[0] for r in out.select(decode_column(out["ids"])).collect()] == ["a b", "", ""]


def check(text, limit, overlap):
    out = split(text, PATH, limit, overlap)
    if len(encode(text, PATH)) <= limit:
        assert out == []
        return
    assert "".join(text[a:b] for a, b, *_ in out) == text
    for k, (a, b, led, n, piece) in enumerate(out):
        assert n == len(encode(piece, PATH)) <= limit and led <= overlap and piece.endswith(text[a:b])
        lead = piece[: len(piece) - (b - a)]
        assert text[:a].endswith(lead) and (k or not lead) and len(encode(lead, PATH)) == led


@pytest.mark.parametrize("text", ODD)
def test_pieces_of_odd_texts(text):
    check(text * 3, 64, 16)


def test_pieces_of_random_texts():
    rnd = random.Random(1)
    for _ in range(60):
        text = "".join(rnd.choice(["word", " ", "\n", "\n\n", ". ", ", ", "漢字。", "x" * 30, "🙂", "12345", "\t", "# Head\n"]) for _ in range(rnd.randint(50, 700)))
        check(text, 48, 12)


def test_weakest_gaps_merge_first():
    assert merge([3, 3, 3, 3], [9, 1, 5, 1], 6) == [0, 2]
    assert merge([10, 10], [9, 0], 15) == [0, 1]
    assert merge([5], [9], 3) == [0]


def test_natural_boundaries_are_preferred():
    text = ("One sentence that is of a fair length here. Another one follows it at once.\n\n" * 30).strip()
    for a, *_ in split(text, PATH, 128, 32)[1:]:
        assert text[:a].endswith("\n\n")


def test_documents(spark):
    df = spark.createDataFrame([(1, "word " * 3000), (2, None), (3, ""), (4, "short")], "doc_id bigint, text string")
    rows = sorted(split_documents(df).collect())
    assert {r.doc_id for r in rows} == {1} and [r.piece_no for r in rows] == list(range(len(rows))) and all(r.n_tokens <= 512 for r in rows)
