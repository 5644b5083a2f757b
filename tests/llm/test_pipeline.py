"""The pipeline stage by stage against plain restatements of its decisions."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from askorpus.llm.mixing import targets
from test_decontaminate import brute as windows_hit
from test_neardup import brute as components

LABELS = "doc_id long, quality int, toxic int"


def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema if name != "shard" else None)
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def sf(spark, docs_of, tmp_path_factory):
    draw = random.Random(8)
    vocab = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(400)]
    items = [(k, " ".join(draw.choice(vocab) for _ in range(20))) for k in range(5)]
    rows, labels = [], []
    for k in range(240):
        words = [draw.choice(vocab) for _ in range(draw.randrange(30, 90))]
        toxic = k % 5 == 0
        if toxic:
            words[3:3] = ["scoundrelish", "wretchedly"]
        if k % 17 == 1:
            words[5:5] = items[k % 5][1].split()[2:14]
        rows.append((k, " ".join(words), f"s{k % 4}"))
        labels.append((k, 1, int(toxic)))
    rows += [(1000 + k, rows[k][1] + " tail", rows[k][2]) for k in range(1, 60, 3)]
    rows += [(2000 + k, rows[2][1], "s9") for k in range(5)]
    rows += [(3000, None, None), (3001, "", "s1"), (None, "some words without an id", "s2")]
    path = tmp_path_factory.mktemp("pipe")
    docs_of(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_stages(spark, sf):
    path, items = sf
    first = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    toxic, near, clean, mixed, sharded = [s.collect() for s in stages(spark, path)]
    kept = {r["doc_id"]: r["text"] for r in toxic}
    assert set(kept) == {k for k, r in first.items() if "scoundrelish" not in (r["text"] or "")}
    comp = components({k: t for k, t in kept.items() if k is not None})
    assert {r["doc_id"] for r in near} == {k for k, c in comp.items() if c[2]} | {None}
    assert len(near) == len({r["doc_id"] for r in near}) < len(kept)
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in near if not windows_hit(r["text"], items)[1]}
    assert len(clean) < len(near)
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in clean}
    size, taken = Counter(), Counter()
    for r in clean:
        size[r["source"]] += len((r["text"] or "").split())
    for r in mixed:
        taken[r["source"]] += len((r["text"] or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for n, t in zip(names, targets([size[n] for n in names], [(1, 2, 3)[k % 3] for k in range(len(names))])):
        assert abs(taken[n] - t) <= 16 * 50 + 64
    assert Counter(r["doc_id"] for r in sharded) == copies
    assert all(len({r["shard"] for r in sharded if r["text"] == t}) == 1 for t in {r["text"] for r in sharded})


def test_other_columns_pass_untouched(spark, sf):
    """Columns with the names that stages use themselves keep their values."""
    path, _ = sf
    names = ["place", "end", "hits", "items", "spans", "n_words", "n_hit", "score", "evidence", "__id", "__hash", "__others",
             "id", "hash", "row", "_may", "_slot", "whole", "stays"]
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr(
        "*", *[f"concat('{n} of ', coalesce(doc_id, -1)) AS `{n}`" for n in names])
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, path)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r == before[r["doc_id"]] for r in rows if not 2000 <= (r["doc_id"] or 0) < 3000), name


def test_run(spark, sf, docs_of, table_dir):
    path, _ = sf
    got = corpus_pipeline.run(spark, path)
    assert got.columns == [*docs_of([""]).columns, "shard"] and got.count() > 100
    assert {r["shard"] for r in got.collect()} <= set(range(16))
    empty = table_dir(documents=docs_of([]), labels=spark.createDataFrame([], LABELS),
                      benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0
