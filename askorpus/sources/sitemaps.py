"""Crawl frontier: sitemaps, discovered links and seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.config import Site
from askorpus.functions import urls
from askorpus.functions.text import strip
from askorpus.operators.ordering import first_per_key, top_n_per_key
from askorpus.sources.staging import staged

_XML = "url array<struct<loc string>>, sitemap array<struct<loc string>>, _corrupt string"
_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def parse_sitemaps(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Replace the XML column with ``pages``, ``children`` and ``broken``."""
    doc = F.from_xml(F.col(xml), _XML, _PERMISSIVE)
    kept = [c for c in files.columns if c != xml]

    def locs(entries):
        return F.filter(
            F.transform(F.coalesce(entries, F.array().cast("array<struct<loc:string>>")),
                        lambda e: strip(e["loc"])),
            lambda u: F.length(u) > 0)

    return (files.select(*kept, F.col(xml).isNull().alias("_missing"), doc.alias("d"))
            .select(*kept, locs(F.col("d.url")).alias("pages"),
                    locs(F.col("d.sitemap")).alias("children"),
                    (F.col("_missing") | F.col("d._corrupt").isNotNull()).alias("broken")))


def expand_sitemaps(roots: DataFrame, files: DataFrame, hosts: Mapping[str, str]) -> DataFrame:
    """Follow index files level by level: (source, url, order) in reading order.

    ``roots`` is (source, sitemap), ``files`` is (sitemap, xml). The driver only
    loops over levels, as many as the files have; each level is one join. A sitemap
    inside itself is not entered again, so cycles end; one listed twice is read
    twice. A source with a sitemap that cannot be read yields nothing.
    """
    level = roots.select("source", "sitemap", F.array().cast("array<int>").alias("order"),
                         F.array("sitemap").alias("inside"))
    pages, broken = [], []
    while True:
        # Written out, a level has a known size: XML is shuffled to meet it only
        # when it is too large to broadcast.
        level = staged(level, "sitemap-level")
        if level.isEmpty():
            break
        read = staged(parse_sitemaps(files.join(level, "sitemap")), "sitemap-read")
        pages.append(read.select("source", "order", F.posexplode("pages").alias("p", "url")))
        broken.append(read.filter("broken").select("source"))
        broken.append(level.join(read.select("sitemap"), "sitemap", "left_anti").select("source"))
        level = (read.select("source", "order", "inside", F.posexplode("children").alias("p", "sitemap"))
                 .filter(~F.array_contains("inside", F.col("sitemap")))
                 .select("source", "sitemap", F.concat("order", F.array("p")).alias("order"),
                         F.concat("inside", F.array("sitemap")).alias("inside")))
    bad = staged(reduce(DataFrame.unionAll, broken).distinct(), "sitemap-broken")
    found = reduce(DataFrame.unionAll, pages).select(
        "source", urls.canonical(F.col("url"), hosts).alias("url"),
        F.concat("order", F.array("p")).alias("order"))
    return found.join(bad, "source", "left_anti")


def discover_links(pages: DataFrame, pattern: str, hosts: Mapping[str, str],
                   html: str = "html", index_url: str = "url") -> DataFrame:
    """Paths a page links to, as canonical URLs: keeps the other columns, adds pos."""
    kept = [c for c in pages.columns if c != html]
    found = pages.select(*kept, F.posexplode(
        F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("pos", "_path"))
    full = F.concat(urls.origin(F.col(index_url)), F.col("_path"))
    return found.withColumn("link", urls.canonical(full, hosts)).drop("_path")


def discovery_rules(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    """(source, url, number, pattern): which links to take from which index page."""
    return spark.createDataFrame(
        [(site.name, index, number, pattern) for site in sites for number, (index, pattern) in enumerate(site.discovery)],
        "source string, url string, number int, pattern string")


def discovered(rules: DataFrame, pages: DataFrame, hosts: Mapping[str, str]) -> DataFrame:
    """Links of the index pages that ``rules`` name: (source, url, order). The pages are read once,
    however many rules there are; a page with several is searched by each."""
    found = pages.select("url", "html").join(rules, "url").select(
        "source", "url", "number", F.posexplode(F.regexp_extract_all("html", F.col("pattern"), F.lit(1))).alias("pos", "_path"))
    full = F.concat(urls.origin(F.col("url")), F.col("_path"))
    return found.select("source", urls.canonical(full, hosts).alias("url"), F.array("number", "pos").alias("order"))


def seeds(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    return spark.createDataFrame(
        [(site.name, url, [i]) for site in sites for i, url in enumerate(site.seeds)],
        "source string, url string, order array<int>")


def merge_frontier(groups: Sequence[DataFrame], limit: int = 0) -> DataFrame:
    """Ordered union without repeats: earlier groups, then earlier positions, win."""
    tagged = [g.select("source", "url", F.lit(n).alias("priority"), "order")
              for n, g in enumerate(groups)]
    merged = first_per_key(
        reduce(DataFrame.unionAll, tagged), ["source", "url"], ["priority", "order"])
    return head_per_source(merged, limit)


def head_per_source(frontier: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` URLs of each source; 0 keeps all."""
    if limit <= 0:
        return frontier
    return top_n_per_key(
        frontier, ["source"], [F.col("priority"), F.col("order")], limit).drop("rank")


def frontier(spark: SparkSession, sites: Sequence[Site], files: DataFrame, pages: DataFrame,
             hosts: Mapping[str, str], limit: int = 0) -> DataFrame:
    """URLs to fetch. Sites with seeds are merged and made distinct; the others
    are their sitemap as it is, repeats included."""
    roots = spark.createDataFrame([(s.name, s.sitemap_url) for s in sites],
                                  "source string, sitemap string")
    listed = expand_sitemaps(roots, files, hosts)
    seeded = [s for s in sites if s.seeds]
    names = [s.name for s in seeded]
    merged = merge_frontier([seeds(spark, seeded), discovered(discovery_rules(spark, seeded), pages, hosts),
                             listed.filter(F.col("source").isin(names))], limit)
    plain = listed.filter(~F.col("source").isin(names)).select("source", "url", F.lit(0).alias("priority"), "order")
    return merged.unionAll(head_per_source(plain, limit))
