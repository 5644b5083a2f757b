"""Counts equal those of the tokenizers library for the same vocabulary."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from askorpus.llm.tokencount import count_tokens, load, op8_token_counts, surviving

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_same_as_library(docs_of, library):
    draw = random.Random(3)
    pool = ["the", " token", "aaa", "  ", "\n", "é", "漢字", "🙂", "don't", "12345", "...", " ", "\t\t", "A" * 300]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(150)]
    texts += ["", None, "a" * 40000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", " \n \n  z", "\x00\x01"]
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs_of(texts), PATH).collect()}
    assert [got[k] for k in range(len(texts))] == lengths(library, texts)


def test_whole_table(spark, sf_dir, library):
    rows = op8_token_counts(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(texts, lengths(library, texts.values())))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) for r in rows)


def test_edges(spark, docs_of):
    rules = load(PATH)
    assert surviving(rules, []).tolist() == [] and surviving(rules, [b"a", b"aaaa"]).tolist()[0] == 1
    docs = docs_of([(None, "a"), (1, "a"), (1, "a")]).selectExpr("*", "'x' AS n_tokens")
    assert [r["n_tokens"] for r in count_tokens(docs, PATH).collect()] == [1, 1, 1]
    assert count_tokens(docs_of([]), PATH).count() == 0
