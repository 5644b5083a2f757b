"""Automaton hits against a word-by-word restatement."""

import random
import re

from askorpus.llm.decontaminate import find_contamination, op6_decontaminate, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(text, items, window=10):
    own = words(text)
    hit, ids = set(), set()
    for i, t in items:
        w = [x[0] for x in words(t)]
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for b in range(len(own) - n + 1):
                if [x[0] for x in own[b:b + n]] == w[a:a + n]:
                    hit |= set(range(b, b + n))
                    ids.add(i)
    runs = [(own[p][1], own[q][2]) for p, q in
            ((p, max(q for q in range(p, len(own)) if all(x in hit for x in range(p, q + 1))))
             for p in sorted(hit) if p - 1 not in hit)]
    return len(own), len(hit), sorted(ids), runs


def found(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), [(s["start"], s["end"]) for s in r["spans"]])
            for r in df.collect()}


def test_against_brute_force(spark, docs_of):
    draw = random.Random(7)
    vocab = ["Ab", "cé", "d-e", "F", "ßg", "h1"]
    items = [(k, " ".join(draw.choice(vocab) for _ in range(draw.choice([1, 3, 4, 6])))) for k in range(4)]
    items += [(9, items[0][1]), (10, "")]
    texts = ["  ".join(draw.choice(vocab) for _ in range(draw.randrange(40))) for _ in range(40)]
    texts += ["", None, "x" * 5000, items[2][1].upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {k: brute(t, items, 4) for k, t in enumerate(texts)}
    assert found(find_contamination(docs_of(texts), bench, 4)) == want
    assert found(find_contamination(docs_of(texts), bench, 4, automaton_bytes=40)) == want


def test_edges(spark, docs_of, table_dir):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(["a b", None, ""]).selectExpr("*", "'x' AS items", "1 AS hits", "2 AS n_hit")
    got = find_contamination(docs, none)
    assert got.count() == 3 and got.where("n_hit > 0").count() == 0
    bench = spark.createDataFrame([(None, "a b"), (1, None), (2, "A, b!")], "item_id long, text string")
    kept = without_contaminated(docs_of(["x a b", "ab", None, ""]), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3] and kept.columns == docs_of([""]).columns
    sf = table_dir(documents=docs_of([(None, "a b"), (5, "a b"), (5, "a b")]), benchmark=bench)
    rows = op6_decontaminate(spark, sf).collect()
    assert len(rows) == 3 and all(r["contaminated"] and r["n_items"] == 1 for r in rows)
    # an item without an id makes a document dirty, without a name for it
    nameless = spark.createDataFrame([(None, "p q r")], "item_id long, text string")
    got = find_contamination(docs_of(["x p q r", "p q"]), nameless).orderBy("doc_id").collect()
    assert [(r["n_hit"], list(r["items"])) for r in got] == [(3, []), (0, [])]
    assert [r["doc_id"] for r in without_contaminated(docs_of(["x p q r", "p q"]), nameless).collect()] == [1]
    sf = table_dir(documents=docs_of([]), benchmark=bench)
    assert op6_decontaminate(spark, sf).count() == 0
