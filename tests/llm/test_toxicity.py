"""Exact nearest examples against all cosines; held-out accuracy; folds and edges."""

import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from askorpus.llm import toxicity
from askorpus.llm.toxicity import (Model, Known, fit, op4_toxicity_neighbours, score_documents, terms_of, without_toxic)

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    draw = random.Random(seed)
    plain = ["".join(draw.choice("aeimnorst") for _ in range(draw.randrange(2, 9))) for _ in range(300)]
    bad = ["vilest", "wretch", "scornful", "brute"]
    rows = []
    for k in range(n):
        words = [draw.choice(plain) for _ in range(draw.randrange(10, 80))]
        toxic = int(draw.random() < 0.2)
        if toxic:
            for _ in range(draw.randrange(1, 5)):
                words.insert(draw.randrange(len(words)), draw.choice(bad) + draw.choice(["", "ly", "s"]))
        rows.append((k, " ".join(words), toxic))
    return rows


@pytest.fixture
def labelled(spark, docs_of):
    rows = corpus(600)
    return docs_of([r[:2] for r in rows]), spark.createDataFrame([(k, 1, t) for k, _, t in rows], LABELS), rows


def test_nearest_is_exact():
    draw = np.random.default_rng(2)
    examples = [(int(k), int(draw.integers(2)), {int(t): int(draw.integers(1, 4)) for t in draw.choice(40, draw.integers(1, 9), replace=False)})
                for k in draw.permutation(1500)]
    model = Model({str(t): t for t in range(40)}, draw.uniform(0.5, 3, 40), examples, neighbours=7)
    vectors = np.zeros((1500, 40))
    for row, doc in enumerate(model.ids.tolist()):
        for t, w in model.vector(next(e[2] for e in examples if e[0] == doc)).items():
            vectors[row, t] = w
    for _ in range(60):
        query = {int(t): int(draw.integers(1, 3)) for t in draw.choice(40, draw.integers(1, 6), replace=False)}
        own = np.zeros(40)
        for t, w in model.vector(query).items():
            own[t] = w
        cosine = np.round(vectors @ own, 12)
        skip = int(draw.integers(1500))
        want = [r for r in np.lexsort((np.arange(1500), -cosine)) if cosine[r] > 0 and r != skip][:7]
        got = model.nearest(query, skip)
        assert [r for _, r in got] == want and all(abs(c - cosine[r]) < 1e-9 for c, r in got)


def test_held_out_accuracy(labelled):
    docs, labels, rows = labelled
    truth = {k: t for k, _, t in rows}
    held = {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    model = fit(docs, labels)
    assert not held & set(model.ids.tolist())
    got = {r["doc_id"]: (r["score"], r["evidence"]) for r in score_documents(docs, model).collect()}
    caught = sum(got[k][0] >= 0.3 for k in held if truth[k]) / sum(truth[k] for k in held)
    wrong = sum(got[k][0] >= 0.3 for k in held if not truth[k]) / sum(1 - truth[k] for k in held)
    assert caught > 0.9 and wrong < 0.03
    assert abs(sum(got[k][0] for k in held) / len(held) - sum(truth[k] for k in held) / len(held)) < 0.05
    shown = next(e for k, (s, e) in got.items() if s > 0.9)
    assert shown[0]["label"] == 1 and shown[0]["cosine"] > 0.3


def test_held_out_labels_change_nothing(spark, labelled):
    docs, labels, _ = labelled
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a = {r["doc_id"]: r["score"] for r in score_documents(docs, fit(docs, labels)).collect()}
    b = {r["doc_id"]: r["score"] for r in score_documents(docs, fit(docs, turned)).collect()}
    assert a == b


def test_known_counts_like_terms():
    vocabulary = {t: k for k, t in enumerate(["scum", "scum-", "abc", "abcd-"])}
    text = "Scum scumble ABC abcdef abcde, scum"
    want = {vocabulary[t]: n for t, n in terms_of(text).items() if t in vocabulary}
    assert Known(vocabulary)(text) == want and Known(vocabulary)(None) == {} == dict(terms_of(None))


def test_edges(spark, docs_of, labelled, table_dir):
    docs, labels, rows = labelled
    odd = docs_of([(None, "vilest"), (9001, None), (9002, ""), (9003, "a" * 200000), (0, rows[0][1]), (0, rows[0][1])])
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 1), (2, 1, 0)], LABELS))
    both = docs.unionByName(odd).selectExpr("*", "1 AS score", "'x' AS evidence")
    got = score_documents(both, fit(both, more)).collect()
    assert len(got) == 606 and all(0 <= r["score"] <= 1 for r in got)
    kept = without_toxic(both, more)
    assert kept.columns == both.columns and {9001, 9002, 9003} <= {r["doc_id"] for r in kept.collect()}
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in score_documents(docs, fit(docs, none)).collect()} == {0.0}
    sf = table_dir(documents=docs_of([]), labels=none)
    assert op4_toxicity_neighbours(spark, sf).count() == 0


def test_every_term_of_the_examples_counts(spark, docs_of):
    # a toxic word of two rows, ordinary words and a text of ordinary words only
    rows = [(k, f"alpha beta w{k}" + (" rareslur" if k in (0, 1, 3) else "")) for k in range(40)] + [(900, "alpha beta")]
    labels = spark.createDataFrame([(k, 1, int(k in (0, 1, 3) or k % 5 == 0)) for k in range(40)], LABELS)
    model = fit(docs_of(rows), labels)
    held = set(model.ids.tolist())
    assert {t for k, text in rows if k in held for t in terms_of(text)} == set(model.vocabulary)
    assert (model.idf > 0).all()
    got = {r["doc_id"]: r["evidence"] for r in score_documents(docs_of(rows), model).collect()}
    assert all(len(e) == model.k for e in got.values())


def held_bytes(model):
    return sum(v.nbytes for v in vars(model).values() if isinstance(v, np.ndarray))


def test_memory_of_a_search(spark, docs_of):
    """Common terms are one matrix in single precision, texts met before a few hundred bytes each, and a
    batch of texts a few megabytes."""
    draw = np.random.default_rng(3)
    examples = [(k, k % 2, (draw.choice(400, 60, replace=False), np.ones(60, np.int64))) for k in range(2000)]
    model = Model({f"t{t}": t for t in range(400)}, draw.uniform(0.5, 3, 400), examples)
    before = held_bytes(model)
    model.prepare()
    assert held_bytes(model) - before < 8 * model.rough.size
    texts = [f"t{k} t{k + 1} t{k + 2}" for k in range(300)]
    first = model.scores(texts)
    assert model.scores(texts) == first and all(len(near) == model.k for _, near in first)
    assert max(map(sys.getsizeof, model.seen.values())) < 300
    docs = docs_of([(k, "word " * 2000) for k in range(4000)]).coalesce(1)
    score_documents(docs, model)
    sizes = docs.select("text").mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([x.nbytes])], names=["n"]) for x in b), "n long")
    assert max(r["n"] for r in sizes.collect()) < 5 << 20


def test_words_of_ascii_need_no_pattern(monkeypatch):
    """Every ASCII character between words, and what is no ASCII before or after lower-casing."""
    texts = [f"Ab{chr(c)}cD_{chr(c)}{chr(c)}9" for c in range(256)] + ["", None, "\u212aelvin \u0130x", "a\u2028b", "\U0001d7d8 z\u00e9"]
    want = [toxicity.WORD.findall((t or "").lower()) for t in texts]
    assert [toxicity.words_of(t) for t in texts] == want

    class Pattern:
        def findall(self, text):
            assert not text.isascii()
            return []

    monkeypatch.setattr(toxicity, "WORD", Pattern())
    known = Known({"ab": 0, "word": 1, "word-": 2})
    assert known("Ab words, word") == {0: 1, 1: 1, 2: 2}
    assert known("caf\u00e9") == {}


def test_known_forgets_words(monkeypatch):
    """Words are numbered anew after the memory is emptied."""
    monkeypatch.setattr(toxicity, "WORDS", 3)
    known = Known({"a": 0, "b": 1, "abcd": 2, "abcd-": 3, "abcde-": 4})
    for _ in range(3):
        for text in ("a b c d e", "abcde abcd", "e d b b", "x y z"):
            want = {known.vocabulary[t]: n for t, n in terms_of(text).items() if t in known.vocabulary}
            assert known(text) == want
    assert len(known.words) <= 8


def test_terms_are_numbered_as_met(monkeypatch):
    """Examples reach the driver as numbers of few bytes; terms and counts are those of their texts."""
    monkeypatch.setattr(toxicity, "TEXTS", 2)
    texts = ["beta al", "al " * 70_000, "", None, "al gamma " * 300, " ".join(f"w{k}" for k in range(300))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([0, 1, 1, 0, 2, 0]), pa.array(texts)], names=["doc_id", "toxic", "text"])
    parts = list(toxicity._term_lists([batch]))
    assert [p.num_rows for p in parts] == [1, 1] and len(parts[0].column("codes")[0].as_py()) == 4
    words, found = toxicity.numbered(pa.Table.from_batches(parts))
    assert list(words)[:4] == ["beta", "beta-", "al", "gamma"] and list(words.values()) == list(range(len(words)))
    names = list(words)
    assert [(d, y) for d, y, _, _ in found] == [(0, 0), (1, 1), (4, 2), (5, 0)]
    for d, _, codes, counts in found:
        assert {names[c]: n for c, n in zip(codes.tolist(), counts.tolist())} == dict(terms_of(texts[d]))
        assert counts.dtype == np.int32
    assert toxicity.numbered(pa.Table.from_batches([], parts[0].schema)) == ({}, [])


def test_memory_of_an_index():
    """Lists are filled in place: beside them there is nothing of their size."""
    import tracemalloc
    draw = np.random.default_rng(3)
    examples = [(k, k % 2, (np.sort(draw.choice(5000, 500, replace=False)), draw.integers(1, 9, 500))) for k in range(1000)]
    idf = draw.random(5000) + 1
    tracemalloc.start()
    model = Model({str(k): k for k in range(5000)}, idf, examples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.4 * (model.weights.nbytes + model.rows.nbytes)
    for term in (0, 17, 4999):
        rows = model.rows[model.at[term]:model.at[term + 1]]
        assert rows.tolist() == [k for k, _, (t, _) in examples if term in t]
        for r, w in zip(rows.tolist(), model.weights[model.at[term]:]):
            assert model.vector(dict(zip(*(v.tolist() for v in examples[r][2]))))[term] == pytest.approx(w)
