"""Ranked search against scoring every document, and the bounds of blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from askorpus.llm import ranking
from askorpus.llm.ranking import op11_ranked_search, rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    many, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 100 - 50 + 50 * c.total() * many // words
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def sample(seed, many=300):
    draw = random.Random(seed)
    words = [f"w{k}" if k % 3 else f"Wé{k}" for k in range(90)]
    def text(n):
        return draw.choice([" ", "-", ". "]).join(words[min(int(draw.expovariate(0.06)), 89)] for _ in range(n))
    docs = [(k, text(draw.randrange(1, 60))) for k in range(many)]
    docs += [(1000 + k, docs[5][1]) for k in range(70)] + [(None, docs[5][1]), (5, docs[5][1]), (7, None), (8, ""), (9, "!!")]
    items = [(k, text(draw.randrange(1, 12))) for k in range(12)] + [(50, docs[5][1]), (51, None), (52, "zzz"), (3, "w1"), (None, "w2 w2")]
    return docs, items


@pytest.mark.parametrize("shard, block, limit", [(4096, 16, 1 << 17), (64, 4, 20)])
def test_against_brute_force(spark, docs_of, monkeypatch, shard, block, limit):
    monkeypatch.setattr(ranking, "SHARD", shard)
    monkeypatch.setattr(ranking, "BLOCK", block)
    docs, items = sample(3)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS query", "2 AS score")
    frame = docs_of(docs).selectExpr("*", "'x' AS terms", "1 AS rank")
    for top in (5, 60):
        assert got(rank_documents(frame, asked, top, limit)) == brute(docs, items, top)


def test_bounds_hold_and_skip():
    """A block's bound is never below a score in it, and blocks of unlike documents are skipped."""
    draw = np.random.default_rng(1)
    groups, size = 8, 80
    rows = [np.unique(np.append(0, 1 + g * 9 + draw.choice(9, 6, replace=False))) for g in draw.integers(0, groups, 400)]
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows)
    shard = ranking.Shard(None, ends, flat, draw.integers(1, 1000, len(flat)))
    weights = np.full(size, 5)
    postings, starts = shard.lists(size)
    ordered, begins = ranking.blocks_of(postings[starts[0]:starts[1]], shard.sketch(weights, size))
    assert sorted(ordered.tolist()) == list(range(400)) and np.diff(np.append(begins, 400)).max() <= ranking.BLOCK
    asked = np.zeros(size, np.int64)
    asked[[0, *range(1, 10)]] = 5
    skipped = 0
    floor = np.sort(shard.scores(np.arange(400), asked))[-20]
    for a, b in zip(begins, np.append(begins[1:], 400)):
        block = ordered[a:b]
        top = np.zeros(size, np.int64)
        for r in block:
            np.maximum.at(top, flat[ends[r]:ends[r + 1]], shard.impacts[ends[r]:ends[r + 1]])
        bound = int((asked * top).sum())
        assert bound >= shard.scores(block, asked).max()
        skipped += bound < floor
    assert skipped > len(begins) / 2


def test_edges(spark, docs_of, table_dir):
    bench = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    none = bench.limit(0)
    assert op11_ranked_search(spark, table_dir(documents=docs_of([]), benchmark=bench)).count() == 0
    assert op11_ranked_search(spark, table_dir(documents=docs_of(["a"]), benchmark=none)).count() == 0
    assert op11_ranked_search(spark, table_dir(documents=docs_of([None, "", "..."]), benchmark=bench)).count() == 0
    long = [(0, "a " * 200_000 + "b"), (1, "c")]
    assert got(op11_ranked_search(spark, table_dir(documents=docs_of(long), benchmark=bench))) == brute(long, [(1, "a b")], 50)
