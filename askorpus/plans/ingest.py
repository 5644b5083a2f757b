"""Incremental ingest: raw documents to chunks.

Text moves as little as possible. What changed is decided on (url, hash) alone, and the changed
urls reach the scan of the texts as a broadcast or, when there are many, as a bitmap;
first-wins on (hash, slug, position) alone; chunk text is shuffled once, when
the surviving positions are joined back to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askorpus.functions import text as tx
from askorpus.functions import urls
from askorpus.operators.chunking import Splitter, explode_chunks
from askorpus.operators.membership import wide_semi
from askorpus.operators.partitioning import spread
from askorpus.providers import Embedder
from askorpus.schemas import CHUNK, DOC_STATE
from askorpus.sources.staging import staged
from askorpus.sources.store import Change, Store, Table

TABLES = {
    "chunks": Table(CHUNK, "url"),
    "docs": Table(DOC_STATE, "url"),
}


@dataclass(frozen=True)
class Ingest:
    """What a run found and what it would write."""

    outcomes: DataFrame  # url, kind, n_chunks
    chunks: DataFrame | None = None  # new rows
    stale: DataFrame | None = None  # urls whose stored chunks go away
    docs: DataFrame | None = None  # (url, content_hash) to remember


def classify(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, content_hash, known, same) for every raw document, without its text."""
    old = stored.select("url", F.col("content_hash").alias("_old"))
    return raw.select("url", "content_hash").join(old, "url", "left").select(
        "url", "content_hash", F.col("_old").isNotNull().alias("known"),
        F.coalesce(F.col("_old") == F.col("content_hash"), F.lit(False)).alias("same"))


def stored_hashes(chunks: DataFrame) -> DataFrame:
    """Document state recovered from a chunk table that has no state table."""
    return chunks.groupBy("url").agg(F.min("content_hash").alias("content_hash"))


def dry_run(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, kind, n_chunks) a run would report; 'empty' cannot be known yet."""
    return classify(raw, stored).select(
        "url", F.when(F.col("same"), "unchanged").when(F.col("known"), "would-update")
        .otherwise("would-insert").alias("kind"), F.lit(0).cast("bigint").alias("n_chunks"))


def candidates(docs: DataFrame, splitter: Splitter) -> DataFrame:
    """Chunks with their hash, which is null where the chunk is not worth keeping.

    Not filtered here: a filter would be pushed below the projection and the
    text normalised twice. ``worth_keeping`` filters what has been written.
    """
    pieces = explode_chunks(
        spread(docs.select("url", urls.slug(F.col("url")).alias("slug"), "title", "source",
                           "content_hash", "text")), splitter)
    flat = F.col("_flat")
    return (pieces.withColumn("_flat", tx.normalise(F.col("content")))
            .withColumn("chunk_hash", F.when(
                tx.quality_ok(F.col("content"), flat), tx.normalised_hash(flat)))
            .drop("_flat"))


def worth_keeping(found: DataFrame) -> DataFrame:
    return found.filter(F.col("chunk_hash").isNotNull())


def keep_first(found: DataFrame, known: DataFrame | None) -> DataFrame:
    """(slug, pos, chunk_index) of chunks whose hash is new, earliest copy only.

    Known hashes join the same aggregate under a smaller order key, so the
    anti-join and the first-wins rule cost one shuffle of narrow rows, and a
    hash copied a billion times is combined before it. Hashes travel as bytes,
    half the size of their hex text and in the same order.
    """
    entries = found.select(F.unhex("chunk_hash").alias("h"), F.struct(
        F.lit(1).alias("fresh"), F.unhex("slug").alias("slug"), F.col("pos")).alias("at"))
    if known is not None:
        entries = entries.unionAll(known.select(F.unhex("chunk_hash"), F.struct(
            F.lit(0).alias("fresh"), F.unhex(F.lit("")).alias("slug"), F.lit(-1).alias("pos"))))
    first = entries.groupBy("h").agg(F.min("at").alias("at")).filter("at.fresh = 1")
    within = Window.partitionBy("slug").orderBy("pos")
    return first.select(F.lower(F.hex("at.slug")).alias("slug"), "at.pos").withColumn(
        "chunk_index", (F.row_number().over(within) - 1).cast("int"))


def build_chunks(found: DataFrame, kept: DataFrame, embedder: Embedder | None) -> DataFrame:
    rows = found.join(kept, ["slug", "pos"]).select(
        urls.chunk_id(F.col("url"), F.col("chunk_index")).alias("chunk_id"),
        urls.document_id(F.col("url")).alias("document_id"),
        "chunk_index", "url", "title", "source", "content", "content_hash", "chunk_hash")
    vector = embedder.column(F.col("content")) if embedder else F.lit(None).cast("array<float>")
    return rows.withColumn("embedding", vector)


def plan_ingest(raw: DataFrame, stored: DataFrame | None, chunks: DataFrame | None,
                splitter: Splitter, embedder: Embedder | None = None,
                compat: bool = False) -> Ingest:
    """One ingest run over ``raw`` (one row per URL).

    ``stored`` and ``chunks`` are the current state, or None on the first run,
    which then needs no lookups at all. By default a chunk is a duplicate only
    of documents that stay as they are, and a document left without chunks loses
    its old ones. ``compat`` keeps the older rules: every stored chunk counts,
    the document's own included, and a document left without chunks keeps them.
    """
    if stored is None:
        state = changed = None
        pending = raw
    else:
        state = staged(classify(raw, stored), "ingest-state")
        # a table of its own, so that its size decides how text is joined to it
        changed = staged(state.filter("not same").select("url"), "ingest-changed")
        pending = wide_semi(raw, changed, ["url"])

    known = None
    if chunks is not None and state is not None:
        known = chunks.select("url", "chunk_hash")
        if not compat:
            known = known.join(changed, "url", "left_anti")

    found = worth_keeping(staged(candidates(pending, splitter), "ingest-chunks"))
    kept = staged(keep_first(found, known), "ingest-kept")

    counts = kept.groupBy("slug").agg(F.count("*").alias("n_chunks"))
    if state is None:
        state = raw.select("url", "content_hash", F.lit(False).alias("known"),
                           F.lit(False).alias("same"))
    counted = (state.withColumn("slug", urls.slug(F.col("url")))
               .join(counts, "slug", "left").drop("slug")
               .withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))))
    result = counted.withColumn(
        "kind", F.when(F.col("same"), "unchanged").when(F.col("n_chunks") == 0, "empty")
        .when(F.col("known"), "updated").otherwise("inserted"))

    written = ["inserted", "updated"] if compat else ["inserted", "updated", "empty"]
    done = result.filter(F.col("kind").isin(written))
    return Ingest(
        outcomes=result.select("url", "kind", "n_chunks"),
        chunks=build_chunks(found, kept, embedder),
        stale=done.filter("known").select("url"),
        docs=done.select("url", "content_hash"))


def drop_stale(chunks: DataFrame, stale: DataFrame) -> DataFrame:
    """Stored chunks that survive a run."""
    return chunks.join(stale, "url", "left_anti")


def summarise(outcomes: DataFrame) -> DataFrame:
    """Documents and chunks per outcome."""
    return outcomes.groupBy("kind").agg(
        F.count("*").alias("n_docs"), F.sum("n_chunks").cast("bigint").alias("n_chunks"))


def ingest(store: Store, raw: DataFrame, splitter: Splitter, embedder: Embedder,
           only_dry_run: bool = False, compat: bool = False, prune: bool = False) -> DataFrame:
    """Run against a store; returns the outcome per URL.

    ``prune`` also removes documents that are no longer in ``raw``.
    """
    first = not store.exists("docs")
    stored = store.read("docs")
    if only_dry_run:
        return dry_run(raw, stored)
    run = plan_ingest(raw, None if first else stored, None if first else store.read("chunks"),
                      splitter, embedder, compat)
    outcomes = staged(run.outcomes, "ingest-outcomes")
    stale = run.stale
    if prune:
        stale = stale.unionAll(stored.select("url").join(raw.select("url"), "url", "left_anti"))
    stale, docs = staged(stale, "ingest-stale"), staged(run.docs, "ingest-docs")
    # hashes last: until they are there, a repeated run finds the same documents changed
    store.commit({
        "chunks": Change(run.chunks, stale),
        "docs": Change(docs, stale),
    })
    return outcomes
