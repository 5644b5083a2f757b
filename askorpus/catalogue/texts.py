"""Queries over documents, pages and benchmark texts: scalars, chunks, ingest."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from askorpus.catalogue.registry import (
    DOC_TITLE, DOC_URL, chunk_hash_sql, doc_url, documents, embed_sql, norm_sql, plain_sql,
    quality_sql, query, strip_sql, table, texts, uuid5_sql)
from askorpus.catalogue.splitting import split_sql
from askorpus.functions import text as tx
from askorpus.functions import urls
from askorpus.operators.chunking import explode_chunks, line_splitter, recursive_splitter, span_splitter
from askorpus.operators.ordering import first_per_key
from askorpus.operators.packing import SHORTEST_CONTEXT_BLOCK, context_block, pack
from askorpus.operators.stats import corpus_stats, stats_note
from askorpus.plans import ingest as ing
from askorpus.providers import HashingEmbedder
from askorpus.schemas import RAW_DOC
from askorpus.sources import rawdocs
from askorpus.sources.staging import shared_dir
from askorpus.sources.store import Store

# -- identifiers and scalars ------------------------------------------------


@query(f"""
SELECT doc_id, sha1({DOC_URL}) AS slug,
       ('0x' || substr(sha1({DOC_URL}), 1, 12))::BIGINT AS document_id,
       sha256(text) AS content_hash
FROM documents""")
def content_identity(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", urls.slug(F.col("url")).alias("slug"),
                    urls.document_id(F.col("url")).alias("document_id"),
                    tx.content_hash(F.col("text")).alias("content_hash"))


@query(f"""
SELECT doc_id, {uuid5_sql(DOC_URL + " || '#' || n_chars")} AS chunk_id FROM documents""")
def chunk_uuid5(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", urls.chunk_id(doc_url(), F.col("n_chars")).alias("chunk_id"))


@query(f"""
SELECT {chunk_hash_sql('text')} AS chunk_hash,
       arg_min(doc_id, sha1({DOC_URL})) AS first_doc, count(*) AS copies
FROM documents GROUP BY 1""")
def normalised_dedup(spark, sf_dir):
    d = documents(spark, sf_dir).select(
        "doc_id", urls.slug(F.col("url")).alias("slug"),
        tx.chunk_hash(F.col("text")).alias("chunk_hash"))
    return d.groupBy("chunk_hash").agg(
        F.min_by("doc_id", "slug").alias("first_doc"), F.count("*").alias("copies"))


@query(f"""
SELECT doc_id, {quality_sql('text')} AS ok, length({norm_sql('text')}) AS n_chars_squeezed,
       upper(substr(p, 1, 1)) || lower(substr(p, 2)) AS pretty
FROM (SELECT *, trim(replace(source || '-' || lang || '-TEXT', '-', ' ')) p FROM documents)""")
def quality_filter(spark, sf_dir):
    d = texts(spark, sf_dir, "documents")
    slug = F.concat_ws("-", "source", "lang", F.lit("TEXT"))
    return d.select("doc_id", tx.quality_ok(F.col("text")).alias("ok"),
                    F.length(tx.normalise(F.col("text"))).cast("bigint").alias("n_chars_squeezed"),
                    tx.prettify(slug).alias("pretty"))


def _markdown(html):
    linked = F.regexp_replace(html, r'<a href="([^"]*)">([^<]*)</a>', r"[$2]($1)")
    return F.regexp_replace(linked, r"<[^>]*>", " ")


_MD = r"""regexp_replace(regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g'), '<[^>]*>', ' ', 'g')"""


@query(f"""
SELECT page_id, {quality_sql('md')} AS ok, length({norm_sql(plain_sql('md'))}) AS plain_chars,
       length({norm_sql('md')}) AS all_chars
FROM (SELECT page_id, {_MD} AS md FROM pages)""")
def markdown_quality(spark, sf_dir):
    p = texts(spark, sf_dir, "pages").select("page_id", _markdown(F.col("html")).alias("md"))
    md = F.col("md")
    return p.select(
        "page_id", tx.quality_ok(md).alias("ok"),
        F.length(tx.normalise(tx.without_markdown_links(md))).cast("bigint").alias("plain_chars"),
        F.length(tx.normalise(md)).cast("bigint").alias("all_chars"))


# -- raw documents ----------------------------------------------------------


def _json_texts(spark, sf_dir):
    """Raw JSON text per document; the German ones are cut short, so corrupt."""
    d = documents(spark, sf_dir)
    body = rawdocs.to_json_text(F.col("url"), F.col("source"), F.col("title"), F.col("text"),
                                F.col("content_hash"), F.lit("2024-01-01T00:00:00Z"))
    cut = F.when(F.col("lang") == "de", F.substr(body, F.lit(1), F.length(body) - 9)).otherwise(body)
    return d.select(cut.alias("value"))


@query(f"""
SELECT {DOC_URL} AS url, source, {DOC_TITLE} AS title, sha256(text) AS text_hash,
       sha256(text) AS content_hash
FROM documents WHERE lang <> 'de' AND contains(source, 'src1')""")
def raw_documents(spark, sf_dir):
    good = rawdocs.good_docs(rawdocs.parse_raw(_json_texts(spark, sf_dir), only='"source":"src1'))
    return good.select("url", "source", "title", F.sha2("text", 256).alias("text_hash"),
                       "content_hash")


@query("SELECT count(*) AS n_corrupt FROM documents WHERE lang = 'de'")
def raw_corrupt(spark, sf_dir):
    return rawdocs.bad_docs(rawdocs.parse_raw(_json_texts(spark, sf_dir))).agg(
        F.count("*").alias("n_corrupt"))


@query(f"""
SELECT sha256(text) AS url, count(*) AS fetches, max(doc_id) AS newest FROM documents GROUP BY 1""")
def newest_fetch(spark, sf_dir):
    d = documents(spark, sf_dir)
    fetched = d.select(
        F.col("content_hash").alias("url"), "source", "title", "text", "content_hash",
        F.timestamp_seconds("doc_id").cast("string").alias("fetched_at"), "doc_id")
    newest = rawdocs.newest_per_url(fetched).select("url", F.col("doc_id").alias("newest"))
    return d.groupBy(F.col("content_hash").alias("url")).agg(
        F.count("*").alias("fetches")).join(newest, "url").select("url", "fetches", "newest")


# -- chunks and ingest ------------------------------------------------------


def _stored(spark, sf_dir):
    """State of an earlier run: labelled documents, those of low quality with
    another hash than they have now."""
    return table(spark, sf_dir, "labels").join(
        documents(spark, sf_dir).select("doc_id", "url", "content_hash"), "doc_id").select(
        "url", F.when(F.col("quality") == 1, F.col("content_hash"))
        .otherwise(F.sha2(F.col("content_hash"), 256)).alias("content_hash"))


def _stored_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return ing.worth_keeping(ing.candidates(d, line_splitter)).select(
        "url", "pos", "content_hash", "chunk_hash")


@query(f"""
SELECT {DOC_URL} AS url,
       CASE WHEN quality = 1 THEN 'unchanged' WHEN quality IS NOT NULL THEN 'would-update'
            ELSE 'would-insert' END AS kind
FROM documents LEFT JOIN labels USING (doc_id)""")
def ingest_dry_run(spark, sf_dir):
    return ing.dry_run(documents(spark, sf_dir), _stored(spark, sf_dir)).select("url", "kind")


_PIECES = f"""
d AS (SELECT {DOC_URL} url, sha1({DOC_URL}) slug, {DOC_TITLE} title, text, sha256(text) content_hash, quality
      FROM documents LEFT JOIN labels USING (doc_id)),
lines AS (SELECT d.*, z.pos, trim(z.line) AS content
          FROM d, unnest(string_split(text, chr(10))) WITH ORDINALITY AS z(line, pos)),
pieces AS (SELECT *, {chunk_hash_sql('content')} AS chunk_hash FROM lines WHERE {quality_sql('content')})"""


@query(f"""
WITH {_PIECES},
known AS (SELECT DISTINCT chunk_hash FROM pieces WHERE quality = 1),
fresh AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY slug, pos) rn
          FROM pieces WHERE quality IS DISTINCT FROM 1
          AND chunk_hash NOT IN (SELECT chunk_hash FROM known)),
kept AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) - 1 AS i FROM fresh WHERE rn = 1)
SELECT {uuid5_sql("url || '#' || i")} AS chunk_id, ('0x' || substr(slug, 1, 12))::BIGINT AS document_id,
       i AS chunk_index, url, title, content, content_hash, chunk_hash
FROM kept""")
def ingest_lines(spark, sf_dir):
    run = ing.plan_ingest(documents(spark, sf_dir), _stored(spark, sf_dir),
                          _stored_chunks(spark, sf_dir), line_splitter)
    return run.chunks.select("chunk_id", "document_id", F.col("chunk_index").cast("bigint"), "url",
                             "title", "content", "content_hash", "chunk_hash")


# the same pieces from the recursive splitter
_SPLIT = f"""
{split_sql('documents', 'doc_id', 'text')},
d AS (SELECT doc_id, {DOC_URL} url, sha1({DOC_URL}) slug, {DOC_TITLE} title, source, sha256(text) content_hash, quality
      FROM documents LEFT JOIN labels USING (doc_id)),
pieces AS (SELECT d.*, pos, content, {chunk_hash_sql('content')} AS chunk_hash
           FROM chunks JOIN d ON d.doc_id = chunks.k WHERE {quality_sql('content')})"""


def _outcomes_sql(known: str, empty: str, pieces: str = _PIECES) -> str:
    return f"""
WITH RECURSIVE {pieces},
known AS (SELECT DISTINCT chunk_hash FROM pieces WHERE {known}),
fresh AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY slug, pos) rn
          FROM pieces WHERE quality IS DISTINCT FROM 1
          AND chunk_hash NOT IN (SELECT chunk_hash FROM known)),
counts AS (SELECT url, count(*) n FROM fresh WHERE rn = 1 GROUP BY url),
kinds AS (SELECT url, coalesce(n, 0) n, CASE WHEN quality = 1 THEN 'unchanged' WHEN n IS NULL THEN 'empty'
          WHEN quality IS NOT NULL THEN 'updated' ELSE 'inserted' END kind, quality
          FROM d LEFT JOIN counts USING (url))
SELECT kind, count(*) AS n_docs, sum(n)::BIGINT AS n_chunks,
       count(*) FILTER (WHERE quality = 0 AND {empty}) AS n_stale
FROM kinds GROUP BY kind"""


def _outcomes(spark, sf_dir, compat):
    run = ing.plan_ingest(documents(spark, sf_dir), _stored(spark, sf_dir),
                          _stored_chunks(spark, sf_dir), line_splitter, compat=compat)
    stale = run.stale.withColumn("stale", F.lit(True))
    marked = run.outcomes.join(stale, "url", "left")
    totals = ing.summarise(marked)
    return totals.join(marked.groupBy("kind").agg(F.count("stale").alias("n_stale")), "kind")


@query(_outcomes_sql("quality = 1", "true"))
def ingest_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir, compat=False)


@query(_outcomes_sql("quality IS NOT NULL", "kind <> 'empty'"))
def ingest_outcomes_compat(spark, sf_dir):
    return _outcomes(spark, sf_dir, compat=True)


@query(f"""
WITH {_PIECES}
SELECT url, count(*) AS n_chunks, min(chunk_hash) AS least_hash
FROM pieces WHERE quality = 1 GROUP BY url""")
def stale_delete(spark, sf_dir):
    changed = _stored(spark, sf_dir).withColumnRenamed("content_hash", "_old").join(
        documents(spark, sf_dir).select("url", "content_hash"), "url").filter(
        "_old <> content_hash").select("url")
    return ing.drop_stale(_stored_chunks(spark, sf_dir), changed).groupBy("url").agg(
        F.count("*").alias("n_chunks"), F.min("chunk_hash").alias("least_hash"))


@query(f"""
WITH {_PIECES}
SELECT url, min(content_hash) AS content_hash FROM pieces WHERE quality IS NOT NULL GROUP BY url""")
def existing_hash(spark, sf_dir):
    return ing.stored_hashes(_stored_chunks(spark, sf_dir))


@query(f"""
WITH RECURSIVE {split_sql('documents', 'doc_id', 'text')}
SELECT k AS doc_id, pos, length(content) AS n_chars, sha256(content) AS content_hash FROM chunks""")
def chunk_split(spark, sf_dir):
    chunks = explode_chunks(documents(spark, sf_dir).select("doc_id", "text"), recursive_splitter())
    return chunks.select("doc_id", F.col("pos").cast("bigint"), F.length("content").cast("bigint").alias("n_chars"),
                         F.sha2("content", 256).alias("content_hash"))


@query("""
SELECT doc_id, true AS same_pieces, true AS in_order, true AS within_size, 0 AS uncovered FROM documents
WHERE text IS NOT NULL""")
def chunk_cover(spark, sf_dir):
    """Of every document: its chunks are the pieces at their places, in order, at most 600
    long, and no character but blanks is outside them."""
    d = documents(spark, sf_dir).select("doc_id", "text").filter("text IS NOT NULL")
    split = d.select("doc_id", "text", recursive_splitter()(F.col("text")).alias("chunks"),
                     span_splitter()(F.col("text")).alias("spans"))
    pieces = F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    starts = F.transform("spans", lambda s: s["start"])
    # how far the text is covered before each span, and what lies between
    ends = F.transform("spans", lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.array_max(
        F.transform(F.slice("spans", 1, F.greatest(i, F.lit(1))), lambda p: p["end"]))))
    gaps = F.zip_with("spans", ends, lambda s, e: F.substring(
        F.col("text"), e + 1, F.greatest(s["start"] - e, F.lit(0))))
    last = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0))
    outside = F.concat(F.array_join(gaps, ""), F.substring(F.col("text"), last + 1, F.length("text")))
    return split.select(
        "doc_id", (pieces == F.col("chunks")).alias("same_pieces"), (F.array_sort(starts) == starts).alias("in_order"),
        F.forall("spans", lambda s: s["end"] - s["start"] <= 600).alias("within_size"),
        F.length(F.regexp_replace(outside, r"(?U)\s", "")).alias("uncovered"))


@query(f"""
SELECT {DOC_URL} AS url, source, {DOC_TITLE} AS title, sha256(text) AS text_hash, sha256(text) AS content_hash,
       '2024-01-02T03:04:05Z' AS fetched_at FROM documents""")
def raw_roundtrip(spark, sf_dir):
    """Documents written as JSON and read back by the reader of raw documents."""
    path = f"{shared_dir(spark)}/roundtrip-{uuid4().hex}"
    docs = documents(spark, sf_dir).withColumn("fetched_at", F.lit("2024-01-02T03:04:05Z"))
    rawdocs.write_json_files(docs.select(RAW_DOC.fieldNames()), path)
    back = rawdocs.good_docs(rawdocs.parse_raw(rawdocs.read_json_texts(spark, path)))
    return back.select("url", "source", "title", F.sha2("text", 256).alias("text_hash"), "content_hash", "fetched_at")


@query(f"""
WITH RECURSIVE {_SPLIT},
fresh AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY slug, pos) rn FROM pieces),
kept AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) - 1 AS i FROM fresh WHERE rn = 1)
SELECT {uuid5_sql("url || '#' || i")} AS chunk_id, ('0x' || substr(slug, 1, 12))::BIGINT AS document_id,
       i AS chunk_index, url, title, content_hash, chunk_hash, 64::BIGINT AS dim
FROM kept""")
def ingest_first_run(spark, sf_dir):
    """Whole ingest of an empty store with the real splitter and embedder."""
    run = ing.plan_ingest(documents(spark, sf_dir), None, None, recursive_splitter(),
                          HashingEmbedder())
    return run.chunks.select("chunk_id", "document_id", F.col("chunk_index").cast("bigint"), "url", "title",
                             "content_hash", "chunk_hash", F.size("embedding").cast("bigint").alias("dim"))


@query(f"SELECT kind, n_docs, n_chunks FROM ({_outcomes_sql('quality = 1', 'true', _SPLIT)})")
def ingest_changed_run(spark, sf_dir):
    """Second run with the real splitter: part unchanged, part changed, part new."""
    d = documents(spark, sf_dir)
    old = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    chunks = ing.worth_keeping(ing.candidates(old, recursive_splitter())).select("url", "chunk_hash")
    run = ing.plan_ingest(d, _stored(spark, sf_dir), chunks, recursive_splitter())
    return ing.summarise(run.outcomes)


@query(f"""
WITH RECURSIVE versions AS (
  SELECT doc_id * 2 v, text t FROM documents
  UNION ALL SELECT doc_id * 2 + 1, substr(text, 201) FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
{split_sql('versions', 'v', 't')},
d AS (SELECT doc_id, {DOC_URL} url, sha1({DOC_URL}) slug, quality FROM documents LEFT JOIN labels USING (doc_id)),
pieces AS (SELECT d.*, chunks.k % 2 = 1 AS was, pos, content, {chunk_hash_sql('content')} AS chunk_hash
           FROM chunks JOIN d ON d.doc_id = chunks.k // 2 WHERE {quality_sql('content')}),
one AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY slug, pos) rn FROM pieces
        WHERE quality IS NOT NULL AND was = (quality = 0)),
one_kept AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) - 1 AS i FROM one WHERE rn = 1),
two AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY slug, pos) rn FROM pieces
        WHERE NOT was AND quality IS DISTINCT FROM 1
        AND chunk_hash NOT IN (SELECT chunk_hash FROM one_kept WHERE quality = 1)),
two_kept AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) - 1 AS i FROM two WHERE rn = 1)
SELECT {uuid5_sql("url || '#' || i")} AS chunk_id, url, i AS chunk_index, sha256(content) AS text_hash, chunk_hash
FROM (SELECT * FROM one_kept WHERE quality = 1 UNION ALL SELECT * FROM two_kept)""")
def store_after_change(spark, sf_dir):
    """The whole chunk table after two runs: labelled documents, those of low quality in an
    earlier version, then all documents as they are now."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid4().hex}", ing.TABLES)
    now = documents(spark, sf_dir).select("doc_id", "url", "source", "title", "text", "content_hash")
    labelled = now.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn(
        "text", F.expr("IF(quality = 0, substring(text, 201), text)"))
    before = labelled.withColumn("content_hash", F.sha2("text", 256)).drop("doc_id", "quality")
    for docs in (before, now.drop("doc_id")):
        ing.ingest(store, docs, recursive_splitter(), HashingEmbedder())
    return store.read("chunks").select("chunk_id", "url", F.col("chunk_index").cast("bigint"),
                                       F.sha2("content", 256).alias("text_hash"), "chunk_hash")


@query(f"""
WITH {embed_sql('e', 'documents', 'doc_id', 'text')}
SELECT k AS doc_id, CASE WHEN w = 0 THEN 0 ELSE w END AS weighted, n_nonzero
FROM (SELECT k, round(list_sum(list_transform(vec, lambda x, i: x * i)), 4) AS w,
      len(list_filter(vec, lambda x: x <> 0)) AS n_nonzero FROM e)""")
def embed_documents(spark, sf_dir):
    d = texts(spark, sf_dir, "documents").select(
        "doc_id", HashingEmbedder().column(F.col("text")).alias("v"))
    weighted = F.aggregate(
        F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    rounded = F.round(weighted, 4)  # -0.0 and 0.0 are shown alike
    return d.select("doc_id", F.when(rounded == 0, 0.0).otherwise(rounded).alias("weighted"),
                    F.size(F.filter("v", lambda x: x != 0)).cast("bigint").alias("n_nonzero"))


# -- corpus counts and packing ----------------------------------------------

_CATEGORY = r"/([a-z]{2})/[^/]+"


@query(rf"""
SELECT regexp_extract(url, '{_CATEGORY}', 1) AS category, count(DISTINCT url) AS n
FROM pages WHERE regexp_matches(url, '{_CATEGORY}') GROUP BY 1""")
def page_stats(spark, sf_dir):
    """Every line of a page stands for a chunk, so URLs repeat."""
    chunks = table(spark, sf_dir, "pages").select("url", F.explode(F.split("html", "</p>")))
    return corpus_stats(chunks, _CATEGORY)


@query(rf"""
WITH c AS (SELECT regexp_extract(url, '{_CATEGORY}', 1) category, count(DISTINCT url) n
           FROM pages WHERE regexp_matches(url, '{_CATEGORY}') GROUP BY 1)
SELECT sum(n)::BIGINT AS total, count(*) AS categories,
       'La biblioteca científica de portal indexada en esta base de conocimiento contiene ' || sum(n)::BIGINT ||
       ' resúmenes de noticias y artículos científicos, distribuidos en ' || count(*) ||
       ' especialidades médicas: ' ||
       string_agg(upper(substr(category, 1, 1)) || lower(substr(category, 2)) || ' (' || n || ')', ', '
                  ORDER BY n DESC, category) || '.' AS note
FROM c""")
def corpus_note(spark, sf_dir):
    return stats_note(corpus_stats(table(spark, sf_dir, "pages"), _CATEGORY), "portal")


_BLOCK = (f"'[#' || doc_id || ' · ' || coalesce({DOC_TITLE}, {DOC_URL}) || ']' || chr(10) || "
          f"{DOC_URL} || chr(10) || {strip_sql('text')} || chr(10)")


@query(f"""
WITH b AS (SELECT source, doc_id, {_BLOCK} AS block FROM documents),
r AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY doc_id) used,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) rank FROM b)
SELECT source, doc_id, rank, used::BIGINT AS used, sha256(block) AS block_hash FROM r WHERE used <= 6000""")
def context_pack(spark, sf_dir):
    d = documents(spark, sf_dir)
    blocks = d.select("source", "doc_id", context_block(
        F.col("doc_id"), F.col("title"), F.col("url"), F.col("text")).alias("block"))
    packed = pack(blocks, ["source"], [F.col("doc_id")], 6000, shortest=SHORTEST_CONTEXT_BLOCK)
    return packed.select("source", "doc_id", F.col("rank").cast("bigint"), "used",
                         F.sha2("block", 256).alias("block_hash"))


@query(f"""
SELECT count(*) AS chunk_count, true AS ok, true AS db_ok, true AS ollama_ok,
       'qwen3:8b' AS llm_model, 'qwen3-embedding:0.6b' AS embed_model
FROM documents""")
def health(spark, sf_dir):
    from askorpus.config import Settings
    from askorpus.plans.health import health as report

    return report(spark, lambda: table(spark, sf_dir, "documents"),
                  lambda: table(spark, sf_dir, "conversations"), lambda: True, Settings())
