"""Targets and blocks against plain restatements; the mix against its contract."""

import random
from fractions import Fraction

import pytest

from askorpus.llm import mixing
from askorpus.llm.mixing import mixed_documents, op3_source_mix, quotas, sainte_lague, targets


def seats_one_by_one(votes, seats, capacity):
    given = [0] * len(votes)
    for _ in range(seats):
        open_ids = [i for i in range(len(votes)) if given[i] < capacity[i] and votes[i] > 0]
        if not open_ids:
            break
        best = max(open_ids, key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


def test_apportionment():
    draw = random.Random(4)
    for _ in range(300):
        n = draw.randrange(1, 8)
        votes = [float(draw.choice([0, 1, 2, 5, 5, 10, draw.randrange(1000)])) for _ in range(n)]
        capacity = [draw.randrange(0, 60) for _ in range(n)]
        seats = draw.randrange(0, 120)
        assert sainte_lague(votes, seats, capacity) == seats_one_by_one(votes, seats, capacity)
    assert sainte_lague([], 5, []) == []


def test_targets():
    draw = random.Random(5)
    for _ in range(200):
        n = draw.randrange(1, 9)
        sizes = [draw.choice([0, 1, 10, 100, 5000]) for _ in range(n)]
        weights = [(1, 2, 3)[k % 3] for k in range(n)]
        got = targets(sizes, weights)
        want, left, over = [Fraction(0)] * n, Fraction(sum(sizes)), set()
        while len(over) < n:
            total = sum(weights[i] for i in range(n) if i not in over)
            want = [Fraction(3 * sizes[i]) if i in over else left * weights[i] / total for i in range(n)]
            fresh = {i for i in range(n) if i not in over and want[i] > 3 * sizes[i]}
            if not fresh:
                break
            over |= fresh
            left -= sum(3 * sizes[i] for i in fresh)
        else:
            want = [Fraction(3 * s) for s in sizes]
        assert got == [float(w) for w in want]


def test_contract(spark, docs_of, table_dir):
    draw = random.Random(6)
    rows = [(k, "w " * draw.randrange(0, 120), draw.choice(["a", "b", "b", "b", "c", None, ""])) for k in range(900)]
    rows += [(2000 + k, "tiny one", "d") for k in range(3)]
    sf = table_dir(documents=docs_of(rows))
    got = op3_source_mix(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, op3_source_mix(spark, sf).collect())) and len(got) == len(rows)
    by = {}
    source = {k: s for k, _, s in rows}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        had = by.setdefault(source[r["doc_id"]], [r["source_size"], r["target"], 0, 0])
        had[2] += r["size"]
        had[3] += r["taken"]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    assert [by[n][1] for n in names] == targets([by[n][2] for n in names], [(1, 2, 3)[k % 3] for k in range(len(names))])
    for size, target, own, taken in by.values():
        assert size == own and abs(taken - target) <= 64
    mixed = mixed_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    words = {}
    for r in mixed:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    for n in names:
        assert abs(words.get(n, 0) - by[n][1]) <= 16 * 60 + 64


def test_quota_never_exceeds_the_repeats():
    for _, _, size, target, words in quotas([("a", 0, 10), ("a", 1, 7), ("b", 0, 5000), (None, 0, 1)]):
        assert words <= 3 * max(size, 1)


def test_edges(spark, docs_of, table_dir):
    rows = [(None, "a b", "x"), (None, "a b", "x"), (1, None, None), (2, "", "x"), (3, "w " * 50000, "y")]
    sf = table_dir(documents=docs_of(rows))
    got = op3_source_mix(spark, sf).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 50000]
    docs = docs_of(rows).selectExpr("*", "'p' AS place", "1 AS shard", "2 AS size", "3 AS taken")
    assert mixed_documents(docs).columns == docs.columns
    assert op3_source_mix(spark, table_dir(documents=docs_of([]))).count() == 0
    assert mixed_documents(docs_of([])).count() == 0


def test_too_many_sources_are_refused(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixed_documents(docs_of([(k, "a b", f"s{k}") for k in range(50)]))


def test_small_sources_come_near_their_target():
    from askorpus.llm.mixing import quotas
    streams = [("big", j, 5000) for j in range(16)] + [("small", j, 12) for j in range(16)] + [("tiny", 3, 4)]
    found = {}
    for name, _, size, target, words in quotas(streams):
        found.setdefault(name, [target, 0])[1] += words
    assert all(abs(words - target) <= 64 and words > 0 for target, words in found.values())
    assert found["small"][1] == found["small"][0] == 576
