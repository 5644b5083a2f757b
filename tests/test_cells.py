"""Cells: the same neighbours as a full scan, from fewer rings."""

import glob
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from askorpus.operators import cells as cl
from askorpus.operators.membership import marked, wide_anti, wide_semi
from askorpus.operators.topk import nearest_batch


def clustered(seed, many=1500, dim=6, groups=12):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 10) for _ in range(dim)] for _ in range(groups)]
    rows = [(k, [c + draw.gauss(0, 0.3) for c in centres[draw.randrange(groups)]]) for k in range(many)]
    # a third are one and the same vector
    return rows + [(many + k, centres[0]) for k in range(many // 2)] + [(9999, None)]


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, "id long, v array<float>")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 5)) for r in df.collect())


def asked_of(df, where):
    return df.where(where).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))


@pytest.mark.parametrize("k, cells, metric", [(1, None, "l2sq"), (7, 16, "l2sq"), (40, 5, "l2"), (5000, 8, "l2sq")])
def test_same_as_a_scan(spark, vectors, tmp_path, k, cells, metric):
    df = vectors(clustered(1)).repartition(3).cache()
    asked = asked_of(df, "id % 97 = 0 AND v IS NOT NULL").unionAll(
        spark.createDataFrame([(-1, [100.0] * 6), (-2, [0.0] * 6), (-3, None)], "query_id long, vector array<float>"))
    index = cl.build_cells(df, "id", "v", str(tmp_path / "cells"), cells, ring=64)
    want = nearest_batch(df, asked, k, "id", "v", metric=metric)
    assert rows(cl.nearest_in_cells(index, asked, k, "id", metric=metric)) == rows(want)


def test_rings_hold_every_vector_once(vectors, tmp_path):
    df = vectors(clustered(2))
    index = cl.build_cells(df, "id", "v", str(tmp_path / "cells"), 8, ring=100)
    rings = index.rings().collect()
    assert sorted(k for r in rings for k in r["keys"]) == [r["id"] for r in df.where("v IS NOT NULL").orderBy("id").collect()]
    assert all(len(r["keys"]) == r["n"] <= 100 and len(r["vectors"]) == 6 * r["n"] for r in rings)
    assert len({(r["cell"], r["ring"]) for r in rings}) == len(rings)
    for r in rings:
        for a in range(0, len(r["vectors"]), 6):
            away = math.dist(r["vectors"][a:a + 6], index.pivots[r["cell"]])
            assert r["low"] - 1e-4 <= away <= r["high"] + 1e-4


def test_far_cells_are_not_read(spark, vectors, tmp_path, monkeypatch):
    """Only rings near a query are joined, through pruned folders, and queries are not collected."""
    df = vectors(clustered(3))
    index = cl.build_cells(df, "id", "v", str(tmp_path / "cells"), 24, ring=64)
    read = []
    scan = cl._scan
    monkeypatch.setattr(cl, "_scan", lambda index, pairs, k, out: read.append(pairs.cache()) or scan(index, pairs, k, out))
    asked = asked_of(df, "id % 300 = 7 AND id < 1500")
    collected = []
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(self) or [])
    found = cl.nearest_in_cells(index, asked, 5, "id")
    monkeypatch.undo()
    assert not collected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan)
    assert found.count() == asked.count() * 5
    pairs = sum(p.count() for p in read)
    assert pairs < asked.count() * index.rings().count() / 4
    assert len(glob.glob(str(tmp_path / "cells" / "cell=*"))) > 5


def test_edges(spark, vectors, tmp_path):
    none = vectors([(1, None)])
    index = cl.build_cells(none, "id", "v", str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<float>")
    assert cl.nearest_in_cells(index, asked, 3, "id").count() == 0
    same = vectors([(k, [1.0, 1.0]) for k in range(50)])
    index = cl.build_cells(same, "id", "v", str(tmp_path / "same"), ring=8)
    assert [r[2] for r in rows(cl.nearest_in_cells(index, asked, 3, "id"))] == [0, 1, 2]
    assert cl.nearest_in_cells(index, asked.limit(0), 3, "id").count() == 0
    with pytest.raises(ValueError):
        cl.nearest_in_cells(index, asked, 3, metric="dot")
    with pytest.raises(Exception, match="another length"):
        cl.build_cells(vectors([(1, [1.0]), (2, [1.0, 2.0])]), "id", "v", str(tmp_path / "bad"))


def test_wide_rows_stay(spark):
    wide = spark.range(2000).selectExpr("IF(id % 50 = 3, NULL, id) AS k", "concat('text ', id) AS text", "'x' AS _word")
    wanted = spark.range(0, 2000, 17).selectExpr("id AS k").unionAll(spark.createDataFrame([(None,), (17,)], "k long"))
    for bits in (4, 26):
        semi, anti = wide_semi(wide, wanted, ["k"], bits), wide_anti(wide, wanted, ["k"], bits)
        assert sorted(r["text"] for r in semi.collect()) == sorted(
            r["text"] for r in wide.join(wanted.distinct(), "k", "left_semi").collect())
        assert sorted(r["text"] for r in anti.collect()) == sorted(r["text"] for r in wide.join(wanted, "k", "left_anti").collect())
        assert semi.columns == anti.columns == wide.columns
    may = marked(wide, wanted, ["k"])
    assert may.where("_may").count() < 300
    assert wide_semi(wide, wanted.limit(0), ["k"]).count() == 0
