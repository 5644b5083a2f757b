"""Texts reach Python a few megabytes at a time, and nothing else changes."""

import pyarrow as pa
from pyspark.sql import functions as F

from askorpus.operators import chunking, newspage
from askorpus.operators.slices import slices


def test_slices_are_bounded_and_complete():
    texts = ["é" * 3, None, "x" * 50, "", None, "abc", "d" * 9, "e"]
    parts = list(slices(pa.array(texts, pa.string()), most_bytes=10, most_rows=3))
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 3 for p in parts)
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in parts)
    assert ["x" * 50] in parts
    part = pa.array(["skipped", *texts], pa.string()).slice(1)
    assert [t for p in slices(part, 10, 3) for t in p] == texts
    assert list(slices(pa.array([], pa.string()))) == []


def test_workers_hold_a_part_of_a_batch(spark):
    page = "<article>" + "x" * 100_000
    for column in (chunking.recursive_splitter(), chunking.span_splitter(), newspage._read_pages):
        texts = [page] * 200 + [None]
        outs = list(column.func(iter([pa.array(texts, pa.string())])))
        assert sum(map(len, outs)) == len(texts)
        assert max(map(len, outs)) <= 21


def test_splits_and_pages_of_a_full_batch(spark):
    text = F.when(F.col("id") % 7 != 0, F.concat(F.lit("Una frase. "), F.repeat(F.col("id").cast("string"), 400)))
    d = spark.range(3000).repartition(1).select("id", text.alias("text"))
    split = chunking.recursive_splitter(100, 10)
    for r in d.select("id", "text", split("text").alias("c"), chunking.span_splitter(100, 10)("text").alias("s")).collect():
        want = None if r.text is None else chunking.split_text(r.text, 100, 10)
        assert r.c == want
        assert (r.s and [r.text[a:b] for a, b in r.s]) == want
    html = F.when(F.col("id") % 5 != 0, F.concat(
        F.lit("<article><h1>T "), F.col("id").cast("string"), F.lit("</h1><a href='/account/login'></a></article>")))
    for r in spark.range(3000).repartition(1).select("id", newspage.read_page(html).alias("p")).collect():
        assert r.p is not None and r.p.title == (f"T {r.id}" if r.id % 5 else None)
        assert r.p.has_login == r.p.article_closed == (True if r.id % 5 else None)
