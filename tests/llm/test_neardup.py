"""Components against all pairs of full sets."""

import random

import numpy as np
import pytest

from askorpus.llm import neardup
from askorpus.llm.neardup import near_duplicates, op9_minhash_neardup, signature, without_near_duplicates


def brute(texts):
    def shingles(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()]
        n = min(5, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    comp = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {k: (len(sets[k]), comp[k], comp[k] == k) for k in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def family(draw, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randrange(edits + 1)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    rows = []
    for g in range(6):
        rows += family(draw, [f"g{g}w{draw.randrange(500)}" for _ in range(120)], 12, 4)
    shared = [f"s{k}" for k in range(60)]
    rows += [" ".join(shared + [f"o{draw.randrange(10**6)}" for _ in range(70)]) for _ in range(15)]
    rows += ["", None, " \t\n", "one", "One", "a b c", "A b c", "a b c d e", rows[0], rows[0].upper(), "y " * 30000]
    draw.shuffle(rows)
    return dict(enumerate(rows))


def test_against_all_pairs(docs_of, texts):
    assert found(near_duplicates(docs_of(list(texts.items())))) == brute(texts)


def test_many_false_candidates(docs_of, texts):
    # bands of one coordinate put nearly everything together: only the rounds decide
    few = dict(list(texts.items())[:60])
    assert found(near_duplicates(docs_of(list(few.items())), bands=8, rows=1)) == brute(few)


def test_chain_of_rounds(docs_of, monkeypatch):
    # a chain in which neighbours link and the ends do not
    words = [f"w{k}" for k in range(100)]
    chain = {k: " ".join(words[2 * k:] + [f"n{j}" for j in range(2 * k)]) for k in range(12)}
    monkeypatch.setattr(neardup, "PIVOTS_HELD", 3)
    monkeypatch.setattr(neardup, "MEMBERS_A_TASK", 4)
    assert found(near_duplicates(docs_of(list(chain.items())))) == brute(chain)


def test_signature_estimates_similarity():
    draw = np.random.default_rng(1)
    errors = []
    for _ in range(20):
        pool = draw.integers(0, 2**63, 600).astype(np.uint64)
        a, b = np.unique(pool[:500]), np.unique(pool[100:])
        errors.append(np.mean(signature(a) == signature(b)) - 400 / 600)
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.15


def test_edges(docs_of, table_dir, spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(None, long), (None, None), (3, long), (3, long), (4, long + " z"), (5, ""), (6, None), (2, "b")]
    docs = docs_of(rows).selectExpr("*", "'q' AS id", "1 AS kept", "2 AS comp")
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 2, 3, 5, 6]
    assert op9_minhash_neardup(spark, table_dir(documents=docs_of([]))).count() == 0
    assert without_near_duplicates(docs_of([])).count() == 0
    assert found(near_duplicates(docs_of(["", None]))) == {0: (0, 0, True), 1: (0, 1, True)}


def test_one_id_with_several_texts(docs_of):
    draw = random.Random(5)
    many = [" ".join(f"t{k}w{draw.randrange(500)}" for _ in range(60)) for k in range(8)]
    # id 7 has four unrelated texts, two near ones, one repeated row and one without words
    rows = [(7, t) for t in many[:4]] + [(7, many[0] + " z"), (7, many[1]), (7, ""), (9, many[2] + " z"), (8, many[4]),
                                         (3, many[3] + " z"), (10, many[4] + " z"), (8, many[5])]
    got = [(r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in near_duplicates(docs_of(rows)).collect()]
    assert sorted(got) == sorted([(7, True, 7)] * 5 + [(7, False, 7), (9, True, 7), (7, True, 3), (3, True, 3),
                                                       (8, True, 8), (10, True, 8), (8, True, 8)])
    kept = [(r["doc_id"], r["text"]) for r in without_near_duplicates(docs_of(rows)).collect()]
    near = {k: [t for t in kept if t[1] in (many[k], many[k] + " z")] for k in range(6)}
    assert len(kept) == 7 and (7, "") in kept and all(len(v) == 1 for v in near.values())
    assert [near[k][0][0] for k in range(6)] == [7, 7, 7, 3, 8, 8]


def test_counts_are_taken_while_writing(spark, docs_of, texts, monkeypatch):
    """No query of its own asks whether rows are there or labels stay: each leaves a plan with the driver."""
    from pyspark.sql.classic.dataframe import DataFrame
    df, asked = docs_of([*texts.items()]), []
    for name in ("isEmpty", "first"):
        monkeypatch.setattr(DataFrame, name, lambda self, n=name, own=getattr(DataFrame, name): asked.append(n) or own(self))
    assert near_duplicates(df).where("NOT kept").count()
    assert not asked


def test_rows_counted_while_written(spark):
    from askorpus.llm.shared import Scratch
    from pyspark.sql import functions as F
    scratch, rows = Scratch(spark, "counted"), spark.range(10)
    for name, df, many, total in (("some", rows, 10, 45), ("none", rows.where("id < 0"), 0, None),
                                  ("joined", rows.join(rows.where("id > 20"), "id"), 0, None),
                                  ("groups", rows.repartition(5).groupBy(F.expr("id % 3").alias("id")).count(), 3, 3)):
        out, n = scratch.put_counted(df, name)
        assert (n, out.count()) == (many, many)
        assert scratch.put_counted(df, name + "-sum", F.col("id").cast("decimal(38,0)"))[1] == total
