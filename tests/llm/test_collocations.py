"""Phrases against a plain count of all windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from askorpus.llm import collocations
from askorpus.llm.collocations import mine_phrases, op13_collocations, tile_counts


def brute(rows, longest=3, least=10, top=2000, covered=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in candidates.items():
        w = tuple(w)
        if any(d[0] == lang and len(d) - 1 > len(w) and 100 * fd >= covered * a
               and any(d[i:i + len(w)] == w for i in range(1, len(d))) for d, fd in candidates.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items()
                  for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def sample(seed, many=120):
    draw = random.Random(seed)
    words = ["Ab", "ab", "cé", "d-e", "F", "ß", "h\x00", "very" * 30, "x", "y"] + [f"w{k}" for k in range(30)]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " !"]
    rows = []
    for _ in range(many):
        text = "".join(words[min(int(draw.expovariate(0.25)), len(words) - 1)] + draw.choice(gaps) for _ in range(draw.randrange(80)))
        rows.append((draw.choice(["en", "en", "en", "de", None]), text))
    return rows + [("en", None), ("en", ""), ("en", "a b c " * 4000), (None, "."), ("und", "a b c")]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def test_against_brute_force(frame):
    rows = sample(1)
    assert found(mine_phrases(frame(rows))) == brute(rows)
    assert found(mine_phrases(frame(rows), longest=5, least=4, top=7)) == brute(rows, 5, 4, 7)


def test_small_dictionary_and_blocks(frame, monkeypatch):
    """Words without an id and phrases in several blocks count alike."""
    rows = sample(2)
    monkeypatch.setattr(collocations, "DICTIONARY", 9)
    monkeypatch.setattr(collocations, "PHRASES", 5)
    monkeypatch.setattr(collocations, "GROUP", 500)
    monkeypatch.setattr(collocations, "HELD", 50)
    assert found(mine_phrases(frame(rows))) == brute(rows)
    monkeypatch.setattr(collocations, "DICTIONARY", 0)
    assert found(mine_phrases(frame(rows), longest=4)) == brute(rows, 4)


def test_tiles():
    draw = np.random.default_rng(3)
    left, right = (draw.zipf(1.3, 5000).clip(0, 99_999).astype(np.int64) for _ in range(2))
    for side, dense in ((16, 8), (256, 100), (64, 10**9)):
        a, b, counts = tile_counts(left, right, side, dense)
        assert dict(zip(zip(a.tolist(), b.tolist()), counts.tolist())) == Counter(zip(left.tolist(), right.tolist()))
        assert len(a) == len(set(zip(a.tolist(), b.tolist())))
    assert len(tile_counts(left[:0], right[:0])[0]) == 0


def test_edges(spark, frame, docs_of, table_dir):
    big = frame([("en", "a b. " * 20)] * 3).selectExpr("*", "1 AS w0", "'x' AS phrase", "2 AS n", "3 AS score")
    assert found(mine_phrases(big)) == [("en", 1, "a b", 60, 60, 60, 120, 1000000)]
    for rows in ([], [None], ["", "x"]):
        assert op13_collocations(spark, table_dir(documents=docs_of(rows))).count() == 0
