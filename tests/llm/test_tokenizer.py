import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keepstream.llm import chunking, tokenizer

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def enc():
    with open(tokenizer.VOCABULARY, "rb") as f:
        return tokenizer.Encoder(tokenizer.model_proto(f.read()))


@pytest.fixture(scope="module")
def reference():
    with open(tokenizer.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello world", "<|endoftext|> and <|startoftext|>", "a  b\n\n c\t", "naïve café 漢字 🙂👩‍👩‍👧", "it's we'll 12,345.67", "▁ _x Ġ", "\x00\x7f﻿ ", "é é", "(((" * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(enc, reference, text):
    ids = enc.encode(text)
    assert ids == reference.encode_ordinary(text) and enc.decode(ids) == text and enc.count(text) == len(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(enc, reference, text):
    ids = enc.encode(text)
    assert ids == reference.encode_ordinary(text) and enc.decode(ids) == text


def test_very_long_words(enc, reference):
    for text in ("x" * 50_000, "漢字" * 10_000, "\n" * 20_000, "ab12 " * 20_000):
        assert enc.encode(text) == reference.encode_ordinary(text)


def test_full_cache(enc, reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "CACHE_SIZE", 3)
    text = "some words are here and some words are not here and there"
    assert enc.encode(text) == reference.encode_ordinary(text)


def test_column(spark, reference):
    rows = [(1, "Hello <|endoftext|>", 5), (2, "", 5), (3, None, 5), (3, "Hello <|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted((r["doc_id"], r["text"] or "", r["ids"]) for r in tokenizer.token_ids(df).collect())
    assert got == sorted((i, t or "", reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert tokenizer.token_ids(df.limit(0)).collect() == []
    assert sorted(r["n_tokens"] for r in tokenizer.token_count(df).collect()) == sorted(len(reference.encode_ordinary(t or "")) for _, t, _ in rows)
    back = tokenizer.decoded(tokenizer.token_ids(df), out="back")
    assert all(r["back"] == (r["text"] or "") for r in back.collect())


def test_bad_ranks_are_refused():
    with pytest.raises(ValueError):
        tokenizer.model_proto(base64.b64encode(b"a") + b" 1\n")


# ---- splitting


def check(enc, text, limit, overlap):
    p = chunking.pieces(enc, text, limit, overlap)
    if not text:
        assert p == []
        return p
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for s, e, n in p:
        assert s < e and n == enc.count(text[s:e]) <= limit
    if len(p) > 1:
        assert enc.count(text) > limit
        for (a, b, _), (c, _, _) in zip(p, p[1:]):
            assert a < c < b
    else:
        assert enc.count(text) <= limit
    return p


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a sentence. ", "\n\n", "1. A claim; ", "漢字。", "🙂", "xyzzy" * 9, "  "]), max_size=150))
def test_any_split(enc, parts):
    check(enc, "".join(parts), 60, 8)


@pytest.mark.parametrize("text", ["", "short", "a" * 5000, "あ" * 3000, "\n" * 3000, "🙂" * 600, " ".join(["w"] * 4000)])
def test_texts_without_boundaries(enc, text):
    check(enc, text, 200, 20)


def test_natural_boundaries(enc):
    text = "".join(f"{i}. A device according to claim {i}, wherein the part is round and made of steel.\n" for i in range(1, 200))
    for s, e, _ in check(enc, text, 400, 40)[:-1]:
        assert text[e - 1] == "\n" and text[e].isdigit()
    text = "A plain sentence about nothing in particular. " * 400
    for s, e, _ in check(enc, text, 400, 40)[:-1]:
        assert text[:e].rstrip().endswith(".")


def test_pieces_are_balanced(enc):
    p = check(enc, "A plain sentence about nothing in particular. " * 1000, 4096, 128)
    sizes = [n for _, _, n in p]
    assert len(p) == -(-(enc.count("A plain sentence about nothing in particular. " * 1000) - 128) // (4096 - 128)) and max(sizes) - min(sizes) < 600


def test_split_table(spark, enc):
    long = "Several words in a row. " * 2000
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x")], "doc_id bigint, text string, pieces string")
    split = chunking.split_texts(df)
    assert sorted(r["doc_id"] for r in split.collect()) == [1, 1]
    rows = chunking.piece_rows(split).collect()
    assert all(r["piece"] == long[r["start"] : r["end"]] and r["n_tokens"] == enc.count(r["piece"]) for r in rows)
    assert chunking.split_texts(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        chunking.split_texts(df, limit=10, overlap=5)
