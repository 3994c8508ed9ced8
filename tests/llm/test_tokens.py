import random

import pytest
from tokenizers import Tokenizer

from terraloom.llm import tokens as t

SCHEMA = "doc_id bigint, text string, key string, ids int"


@pytest.fixture(scope="module")
def other():
    k = Tokenizer.from_file(f"{t.TOKENIZERS}/byte_bpe_50k.json")
    k.encode_special_tokens = True
    return k


def texts():
    rng = random.Random(1)
    words = ["it's", "naïve", "数学の本", "12345", "\t", "\n\n", "   ", "don't", "Привет", "<|endoftext|>", "!!", "🙂", "a" * 40]
    long = "".join(rng.choice(words) + rng.choice([" ", "", "  ", "\n"]) for _ in range(30_000))
    return {1: None, 2: "", 3: " ", 4: "Hello  world\r\n", 5: long, 6: "x" * 100_000, 7: " " * 50_000 + "y", 8: "日本語" * 12_000, 9: ("word " * 5000).strip(), 10: ("ab\n\n \t" * 6000), 11: "1" * 17_000 + "a b" * 9000}


def test_same_ids_as_another_library(spark, other):
    docs = texts()
    df = spark.createDataFrame([(k, x, "k", 1) for k, x in docs.items()] + [(4, docs[4], "k", 1), (None, "x", "k", 1)], SCHEMA)
    got = {r.doc_id: r.ids for r in t.encode(df, "doc_id", "text").collect()}
    assert got.keys() == docs.keys()
    for k, x in docs.items():
        assert got[k] == other.encode(x or "", add_special_tokens=False).ids, k
        assert t.decode(got[k]) == (x or "").encode()
    n = {r.doc_id: r.n_tokens for r in t.token_counts(df, "doc_id", "text").collect()}
    assert n == {k: len(v) for k, v in got.items()}


def test_small_chunks_meet(spark, other, monkeypatch):
    monkeypatch.setattr(t, "CHUNK", 200)
    monkeypatch.setattr(t, "OVERLAP", 40)
    docs = {k: (x or "")[:3000] for k, x in texts().items()}
    df = spark.createDataFrame([(k, x, "k", 1) for k, x in docs.items()], SCHEMA).filter("length(text) > 200")
    pieces = t._pieces(df.selectExpr("doc_id as key", "text"), t.TOKENIZERS)
    whole = {}
    for r in pieces.orderBy("key", "piece").collect():
        whole[r.key] = whole.get(r.key, "") + r.text
    assert whole == {k: x for k, x in docs.items() if len(x) > 200}
    got = {r.doc_id: r.ids for r in t.encode(df, "doc_id", "text").collect()}
    assert got == {k: other.encode(x, add_special_tokens=False).ids for k, x in docs.items() if len(x) > 200}


def test_empty(spark):
    assert t.encode(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0
