"""Incremental ingest against a store."""

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from askorpus.functions import urls
from askorpus.operators.chunking import line_splitter
from askorpus.plans import ingest as ing
from askorpus.providers import HashingEmbedder
from askorpus.schemas import RAW_DOC
from askorpus.sources import rawdocs
from askorpus.sources.store import Change, Store


def para(word):
    """A line long enough to keep, starting with the word."""
    return (word + " " + "relleno " * 20).strip()


def raw(spark, docs):
    rows = [(u, "s", None, t, hashlib.sha256(t.encode()).hexdigest(), "2024-01-01T00:00:00Z")
            for u, t in docs.items()]
    return spark.createDataFrame(rows, RAW_DOC)


def run(store, docs, **kw):
    out = ing.ingest(store, raw(store.spark, docs), line_splitter, HashingEmbedder(8), **kw)
    return {r.url: (r.kind, r.n_chunks) for r in out.collect()}


def stored(store):
    rows = store.read("chunks").orderBy("url", "chunk_index").collect()
    return {(r.url, r.chunk_index): r.content.split(" ")[0] for r in rows}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), ing.TABLES)


def text(*words):
    return "\n".join(para(w) for w in words)


def test_lifecycle(store):
    docs = {"u1": text("a", "b"), "u2": text("c"), "u3": "corto"}
    assert run(store, docs) == {"u1": ("inserted", 2), "u2": ("inserted", 1), "u3": ("empty", 0)}
    assert stored(store) == {("u1", 0): "a", ("u1", 1): "b", ("u2", 0): "c"}
    again = run(store, docs)
    assert {k for k, _ in again.values()} == {"unchanged"}
    assert len(stored(store)) == 3

    # an edit that keeps one chunk, and a document that shrinks to nothing useful
    docs.update(u1=text("a", "x"), u2="nada", u4=text("d"))
    assert run(store, docs) == {
        "u1": ("updated", 2), "u2": ("empty", 0), "u3": ("unchanged", 0), "u4": ("inserted", 1)}
    assert stored(store) == {("u1", 0): "a", ("u1", 1): "x", ("u4", 0): "d"}
    assert {v[0] for v in run(store, docs).values()} == {"unchanged"}

    row = store.read("chunks").filter("url = 'u4'").first()
    assert row.chunk_id == store.spark.range(1).select(urls.chunk_id(F.lit("u4"), F.lit(0))).first()[0]
    assert len(row.embedding) == 8 and row.document_id == int(hashlib.sha1(b"u4").hexdigest()[:12], 16)


def test_back_and_forth(store):
    """A text that returns to an earlier version does not revive old rows."""
    for words in (("a", "b"), ("c",), ("a", "b")):
        run(store, {"u": text(*words)})
        assert stored(store) == {("u", i): w for i, w in enumerate(words)}


def test_first_copy_wins_by_slug(store):
    docs = {f"u{i}": text("same", f"own{i}") for i in range(6)}
    run(store, docs)
    first = min(docs, key=lambda u: hashlib.sha1(u.encode()).hexdigest())
    kept = stored(store)
    assert [k for k, w in kept.items() if w == "same"] == [(first, 0)]
    # numbering counts kept chunks only
    assert {k for k in kept if k[0] != first} == {(u, 0) for u in docs if u != first}
    # case and spacing do not make a chunk new
    assert run(store, {**docs, "new": para("SAME").upper().replace(" ", "  ")})["new"] == ("empty", 0)


def test_copies_within_a_document(store):
    assert run(store, {"u": text("a", "a", "b", "a")}) == {"u": ("inserted", 2)}
    assert stored(store) == {("u", 0): "a", ("u", 1): "b"}


def test_compat_loses_unchanged_chunks(store):
    run(store, {"u": text("a", "b")}, compat=True)
    assert run(store, {"u": text("a", "x")}, compat=True) == {"u": ("updated", 1)}
    assert stored(store) == {("u", 0): "x"}
    # nothing new: old chunks and old hash stay, so it is tried again
    assert run(store, {"u": "nada"}, compat=True) == {"u": ("empty", 0)}
    assert run(store, {"u": "nada"}, compat=True) == {"u": ("empty", 0)}
    assert stored(store) == {("u", 0): "x"}


def test_dry_run(store):
    run(store, {"u": text("a"), "v": text("b")})
    before = stored(store)
    kinds = run(store, {"u": text("a"), "v": text("c"), "w": "x"}, only_dry_run=True)
    assert kinds == {"u": ("unchanged", 0), "v": ("would-update", 0), "w": ("would-insert", 0)}
    assert stored(store) == before


def test_prune(store):
    run(store, {"u": text("a"), "v": text("b")})
    run(store, {"u": text("a")})
    assert len(stored(store)) == 2
    run(store, {"u": text("a")}, prune=True)
    assert stored(store) == {("u", 0): "a"}
    assert run(store, {"v": text("b")}) == {"v": ("inserted", 1)}


def test_summary(spark, store):
    out = ing.ingest(store, raw(spark, {"u": text("a", "b"), "v": "x"}), line_splitter, HashingEmbedder(8))
    assert {tuple(r) for r in ing.summarise(out).collect()} == {("inserted", 1, 2), ("empty", 1, 0)}


def test_a_run_that_died_is_repaired_by_repeating_it(store, monkeypatch):
    run(store, {"u": text("a"), "v": text("b")})
    whole, died = Store._apply, []

    def dies(self, name, change):
        if name == "docs" and not died:
            died.append(name)
            raise RuntimeError("lost")
        return whole(self, name, change)

    monkeypatch.setattr(Store, "_apply", dies)
    with pytest.raises(RuntimeError):
        run(store, {"u": text("c"), "v": text("b"), "w": text("d")})
    # chunks were written, their hashes were not: the same outcome again, and no row twice
    assert run(store, {"u": text("c"), "v": text("b"), "w": text("d")}) == {
        "u": ("updated", 1), "v": ("unchanged", 0), "w": ("inserted", 1)}
    assert stored(store) == {("u", 0): "c", ("v", 0): "b", ("w", 0): "d"}
    assert store.read("chunks").count() == 3


def files(store, name):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.root}/{name}/bucket=*/*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, store):
    rows = spark.range(200).selectExpr("concat('u', id) AS url", "'h' AS content_hash")
    assert store.commit({"docs": Change(rows)}) == {"docs": []}
    before = files(store, "docs")
    changed = rows.filter("url = 'u7'").withColumn("content_hash", F.lit("new"))
    touched = store.commit({"docs": Change(changed, rows.filter("url IN ('u8', 'nobody')").select("url"))})["docs"]
    assert 1 <= len(touched) <= 2
    after = files(store, "docs")
    rewritten = {f for f in before if any(f"/bucket={b}/" in f for b in touched)}
    assert set(before) - set(after) == rewritten
    assert all(after[f] == before[f] for f in before if f not in rewritten)
    got = {r.url: r.content_hash for r in store.read("docs").collect()}
    assert len(got) == 199 and got["u7"] == "new" and "u8" not in got
    # new keys are added beside what is there
    assert store.commit({"docs": Change(spark.createDataFrame([("new", "h")], rows.schema))}) == {"docs": []}
    assert set(after) < set(files(store, "docs")) and store.read("docs").count() == 200


def test_same_change_twice_and_other_bucket_counts(spark, store):
    rows = spark.range(40).selectExpr("concat('u', id) AS url", "'h' AS content_hash")
    for _ in range(2):
        store.commit({"docs": Change(rows)})
    assert store.read("docs").count() == 40
    other = Store(spark, store.root, ing.TABLES, buckets=5)
    other.commit({"docs": Change(rows.withColumn("content_hash", F.lit("i")), rows.select("url"))})
    assert {tuple(r) for r in other.read("docs").collect()} == {(f"u{k}", "i") for k in range(40)}
    other.commit({"docs": Change(replaced=rows.select("url"))})
    assert other.read("docs").count() == 0
    other.commit({"docs": Change(rows.limit(0)), "chunks": Change(replaced=rows.select("url"))})
    assert other.read("chunks").count() == 0


def test_compact_and_reset(store):
    run(store, {"u": text("a"), "v": text("b")})
    run(store, {"u": text("c"), "v": text("b")})
    before = stored(store)
    store.compact()
    assert stored(store) == before
    assert run(store, {"u": text("d"), "v": text("b")})["v"] == ("unchanged", 0)
    with pytest.raises(ValueError):
        store.reset()
    store.reset(confirm=True)
    assert not store.exists("docs") and stored(store) == {}


def test_raw_json_files(spark, tmp_path):
    for name, body in {
        "a.json": json.dumps({"url": "u1", "source": "s", "title": None, "text": 'say "hi"\n',
                              "content_hash": "h", "fetched_at": "t", "extra": 1}, indent=2),
        "b.json": '{"url": "u2", "text": ', "c.json": "[]", "d.txt": '{"url":"no"}',
    }.items():
        (tmp_path / name).write_text(body, "utf-8")
    parsed = rawdocs.parse_raw(rawdocs.read_json_texts(spark, str(tmp_path)))
    assert [r.url for r in rawdocs.good_docs(parsed).collect()] == ["u1"]
    assert rawdocs.bad_docs(parsed).count() == 2
    # the substring is looked for in the JSON text, escapes and all
    texts = rawdocs.read_json_texts(spark, str(tmp_path))
    assert rawdocs.parse_raw(texts, only='\\"hi\\"\\n').count() == 1
    assert rawdocs.parse_raw(texts, only='"hi"').count() == 0
    out = str(tmp_path / "out")
    rawdocs.write_json_files(rawdocs.good_docs(parsed), out)
    back = spark.read.schema(RAW_DOC).json(out).collect()
    assert [(r.url, r.text, r.title) for r in back] == [("u1", 'say "hi"\n', None)]


def test_many_documents_in_a_json_file_come_back(spark, tmp_path):
    docs = spark.range(1000).selectExpr(
        "concat('u', id) AS url", "'s' AS source", "if(id % 3 = 0, null, 'T') AS title",
        "concat('{', id, '}\n{\"x\"}') AS text", "sha2(cast(id AS string), 256) AS content_hash",
        "'2024-01-01T00:00:00Z' AS fetched_at").select(RAW_DOC.fieldNames())
    out = str(tmp_path / "json")
    rawdocs.write_json_files(docs.coalesce(2), out)
    parsed = rawdocs.parse_raw(rawdocs.read_json_texts(spark, out))
    assert rawdocs.bad_docs(parsed).count() == 0
    assert sorted(map(tuple, rawdocs.good_docs(parsed).collect())) == sorted(map(tuple, docs.collect()))


def test_a_large_file_of_lines_is_split(spark, tmp_path):
    """Many tasks read one file of documents; no value holds more than a document."""
    docs = spark.range(4000).selectExpr(
        "concat('u', id) AS url", "'s' AS source", "'T' AS title", "repeat('text ', 20) AS text", "'h' AS content_hash",
        "'2024-01-01T00:00:00Z' AS fetched_at").select(RAW_DOC.fieldNames())
    docs.coalesce(1).write.json(str(tmp_path / "json"))
    (tmp_path / "json" / "one.json").write_text('{\n"url": "own",\n"text": "x"\n}')
    (tmp_path / "json" / "long.json").write_text('{\n"url": "' + "y" * 5000 + '"\n}')
    (tmp_path / "json" / "mixed.json").write_text('{"url": "m1"}\n{"url": "m2"}\n\n{"url": \n{"url": "m3"}\n')
    (tmp_path / "json" / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        texts = rawdocs.read_json_texts(spark, str(tmp_path / "json"), longest=1000)
        rows = texts.withColumn("task", F.spark_partition_id()).cache()
        assert rows.filter("contains(value, '\"u1')").select("task").distinct().count() >= 5
        assert rows.agg(F.max(F.length("value"))).first()[0] < 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    parsed = rawdocs.parse_raw(rows)
    urls_read = {r.url for r in rawdocs.good_docs(parsed).collect()}
    assert urls_read == {f"u{k}" for k in range(4000)} | {"own", "m1", "m2", "m3"}
    assert rawdocs.bad_docs(parsed).count() == 2  # the cut line and the long file; one of no bytes is no document


def test_embedder_is_unit_length(spark):
    df = spark.createDataFrame([("uno dos dos",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(HashingEmbedder(16).column(F.col("t"))).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and sum(got[1]) == 0 and got[2] is None
