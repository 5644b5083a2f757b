"""Turn fetched pages into raw documents, and say what happened to each URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askorpus.functions import text as tx
from askorpus.operators import newspage as np_
from askorpus.operators.ordering import first_per_key
from askorpus.operators.partitioning import narrow_to, spread
from askorpus.schemas import EXTRACT, T
from askorpus.sources.staging import staged
from askorpus.sources.store import Change, Store, Table

TABLES = {"raw": Table(T.StructType([
    T.StructField("url", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("content_hash", T.StringType()), T.StructField("fetched_at", T.StringType()),
]), "url")}

_EXTRACT = T.StructType(list(EXTRACT.fields) + [T.StructField("_corrupt", T.StringType())])


def process_pages(fetched: DataFrame, news_sources: Sequence[str], news_site: str) -> DataFrame:
    """One row per fetched URL with its text or the reason it has none.

    ``fetched`` is (url, source, html, extract, error): ``html`` is the raw page
    (null if that fetch failed), ``extract`` the extractor's JSON and ``error``
    why the extractor failed, if it did.
    """
    may_be_news = F.col("source").isin(list(news_sources)) if news_sources else F.lit(False)
    news_html = F.when(may_be_news, F.col("html"))
    read = spread(fetched).withColumn("page", np_.read_page(news_html)).withColumn(
        "doc", F.from_json("extract", _EXTRACT,
                           {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    item = read.withColumn("news", np_.news_item(F.col("page"), F.col("url"))).withColumn(
        "markdown", tx.strip(F.coalesce("doc.content.markdown", F.lit(""))))

    is_news = F.col("news").isNotNull()
    walled = may_be_news & F.coalesce(np_.is_login_page(F.col("html")), F.lit(False))
    final_url = F.lower(F.coalesce("doc.metadata.url", F.lit("")))
    reason = (
        F.when(is_news, F.lit(None).cast("string"))
        .when(walled, F.lit("login wall"))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("extract").isNull(), F.lit("no extract"))
        .when(F.col("doc._corrupt").isNotNull(), F.lit("json parse"))
        .when(F.length("markdown") < tx.MIN_PAGE_CHARS, F.concat(
            F.lit("empty content (len="), F.length("markdown").cast("string"), F.lit(")")))
        .when(F.contains(final_url, F.lit(np_.LOGIN_PATH)), F.lit("login wall")))
    text = F.when(is_news, np_.news_text(F.col("news"), news_site)).otherwise(F.col("markdown"))
    return item.select(
        F.when(is_news, F.col("news.canonical_url")).otherwise(F.col("url")).alias("url"),
        F.col("url").alias("asked"), "source", is_news.alias("is_news"),
        F.when(is_news, F.col("news.title")).otherwise(F.col("doc.metadata.title")).alias("title"),
        reason.alias("failure"), F.when(reason.isNull(), text).alias("text"),
    ).withColumn("content_hash", tx.content_hash(F.col("text")))


def fetch_results(processed: DataFrame, existing: DataFrame | None, force: bool) -> DataFrame:
    """Adds status and reason: fetched, skipped (same content as stored) or failed."""
    if existing is None or force:
        joined = processed.withColumn("same", F.lit(False))
    else:
        old = narrow_to(existing.select("url", F.col("content_hash").alias("_old")), processed, "url")
        joined = processed.join(old, "url", "left").withColumn(
            "same", F.coalesce(F.col("_old") == F.col("content_hash"), F.lit(False))).drop("_old")
    failed = F.col("failure").isNotNull()
    return joined.select(
        "*",
        F.when(failed, "failed").when(F.col("same"), "skipped").otherwise("fetched").alias("status"),
        F.when(failed, F.col("failure")).when(F.col("same"), "hash unchanged")
        .when(F.col("is_news"), "news summary").otherwise("").alias("reason"))


def report(results: DataFrame) -> DataFrame:
    return results.select("url", "source", "status", "reason")


def payloads(results: DataFrame, fetched_at: str) -> DataFrame:
    """Documents to store. Pages that share a canonical URL give one document."""
    rows = results.filter(F.col("status") == "fetched").select(
        "url", "source", "title", "text", "content_hash",
        F.lit(fetched_at).alias("fetched_at"), "asked")
    news_twins = first_per_key(rows, ["url"], ["asked"])
    return news_twins.drop("asked")


def count_statuses(results: DataFrame) -> DataFrame:
    return results.groupBy("source", "status").agg(F.count("*").alias("n"))


def crawl(store: Store, fetched: DataFrame, news_sources: Sequence[str], news_site: str,
          fetched_at: str, force: bool = False) -> DataFrame:
    """Process a batch of fetched pages into the raw table; returns the results."""
    existing = store.read("raw") if store.exists("raw") else None
    processed = staged(process_pages(fetched, news_sources, news_site), "crawl-pages")
    results = staged(fetch_results(processed, existing, force), "crawl")
    docs = staged(payloads(results, fetched_at), "crawl-docs")
    store.commit({"raw": Change(docs, docs.select("url"))})
    return report(results)
