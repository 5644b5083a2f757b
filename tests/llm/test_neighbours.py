"""Recall and exact scores against brute force; duplicates, ties and unusable vectors."""

import numpy as np
import pytest

from askorpus.llm import neighbours
from askorpus.llm.neighbours import nearest, op2_forest_neighbours

DDL = "vec_id long, embedding array<float>"


def brute(rows, queries, k=10):
    points = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows
              if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(points))
    x = np.stack([points[i] for i in ids])
    out = {}
    for q in queries:
        if q in points:
            d = np.sqrt(((x - points[q]) ** 2).sum(axis=1))
            out[q] = [(int(ids[n]), float(d[n])) for n in np.lexsort((ids, d)) if ids[n] != q][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert set(got) == set(want)
    return np.mean([len({x for x, _ in got[q]} & {x for x, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("kind", ["clusters", "spread"])
def test_recall(spark, kind):
    draw = np.random.default_rng(3)
    points = draw.normal(size=(3000, 24))
    if kind == "clusters":
        points = points * 0.1 + draw.normal(size=(30, 24))[draw.integers(0, 30, 3000)]
    rows = [(k, p.tolist()) for k, p in enumerate(points.astype(np.float32))]
    df = spark.createDataFrame(rows, DDL)
    got = found(nearest(df, df.where("vec_id % 50 = 0"), sample=1000))
    want = brute(rows, range(0, 3000, 50))
    assert recall(got, want) >= 0.9
    for q in got:
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        exact = dict(brute(rows, [q], 3000)[q])
        assert all(abs(exact[x] - s) < 1e-12 for x, s in got[q])


def test_duplicates_ties_and_unusable(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES_HELD", 2)
    monkeypatch.setattr(neighbours, "VECTORS_A_TASK", 5)
    same = [1.0, 2.0]
    rows = [(k, same) for k in range(40)] + [(100 + k, [float(k), 0.5]) for k in range(1, 9)] + [(200, [1.0, 2.5]), (201, [1.0, 1.5])]
    bad = [(None, [1.0, 1.0]), (300, None), (301, [0.0, 0.0]), (302, [float("nan"), 1.0]), (303, [None, 1.0]),
           (304, [float("inf"), 1.0]), (305, []), (306, [1.0])]
    df = spark.createDataFrame(rows + rows[:5] + bad, DDL).selectExpr("*", "1 AS id", "2 AS v")
    got = found(nearest(df, df, leaf=4, trees=3, recall=1.0))
    want = brute(rows, [i for i, _ in rows])
    assert got == want


def test_small_and_empty(spark, table_dir, sf_dir):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 0.0])], DDL)
    assert found(nearest(df, df))[0] == [(1, 2 ** 0.5), (2, 2.0)]
    one = spark.createDataFrame([(0, [1.0])], DDL)
    assert nearest(one, one).count() == 0
    assert op2_forest_neighbours(spark, table_dir(embeddings=spark.createDataFrame([], DDL))).count() == 0
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert recall(found(op2_forest_neighbours(spark, sf_dir)), want) >= 0.9
