"""How often the store moves and writes the rows of a change."""

import glob
import os

from pyspark.sql import functions as F

from askorpus.plans import ingest as ing
from askorpus.sources import store as st


def docs(spark, a, b, h):
    return spark.range(a, b).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit(h).alias("content_hash"))


def test_rows_that_stay_are_written_once(spark, tmp_path, monkeypatch):
    """Neither the rows of a new table nor those a bucket keeps are written out beside the table."""
    names, staged = [], st.staged
    monkeypatch.setattr(st, "staged", lambda df, name: (names.append(name), staged(df, name))[1])
    store = st.Store(spark, str(tmp_path / "s"), ing.TABLES)
    store.commit({"docs": st.Change(docs(spark, 0, 100, "h"))})
    assert names == []
    store.commit({"docs": st.Change(docs(spark, 90, 120, "i"), docs(spark, 0, 30, "h").select("url"))})
    assert names == ["store-rows", "store-keys"]
    got = {r.url: r.content_hash for r in store.read("docs").collect()}
    assert got == {f"u{k}": "h" if k < 90 else "i" for k in range(30, 120)}


def test_a_large_change_is_not_moved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "MOVED_BYTES", 0)
    store = st.Store(spark, str(tmp_path / "s"), ing.TABLES, buckets=2)
    for h in "ab":
        store.commit({"docs": st.Change(docs(spark, 0, 4000, h).repartition(5))})
        if h == "a":
            # a file of each task
            assert len(glob.glob(f"{store.root}/docs/bucket=*/*.parquet")) == 10
        assert store.read("docs").where(F.col("content_hash") == h).count() == store.read("docs").count() == 4000
    store.compact()
    assert len(glob.glob(f"{store.root}/docs/bucket=*/*.parquet")) == 2 and store.read("docs").distinct().count() == 4000


def test_buckets_that_lose_all_rows_go(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"), ing.TABLES, buckets=4)
    store.commit({"docs": st.Change(docs(spark, 0, 50, "h"))})
    touched = store.commit({"docs": st.Change(replaced=docs(spark, 0, 50, "h").select("url"))})["docs"]
    assert len(touched) == 4 and not [p for p in os.listdir(f"{store.root}/docs") if p.startswith("bucket=")]
    assert store.read("docs").count() == 0
