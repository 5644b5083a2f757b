"""URLs, sitemaps, frontier, news pages and crawl outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from askorpus.catalogue.registry import DOC_TITLE, DOC_URL, documents, norm_sql, query, strip_sql, table, texts
from askorpus.functions import text as tx
from askorpus.functions import urls
from askorpus.operators import newspage
from askorpus.plans import crawl as cr
from askorpus.sources import failures, sitemaps
from askorpus.sources.staging import staged

# Configuration of an invented crawl over the pages table.
HOSTS = {
    "blog.tionsh.example.net": "https://www.tionsh.example.net",
    "thther.example.org": "https://www.thther.example.org",
    "blog.ththan.example.net": "https://blog.ththan.example.net",
    "ththre.example.com": "https://www.ththre.example.com",
}
SOURCES = ("tionsh", "thth", "example.net", "example.com")
LINK = r'href="(/[A-Za-z0-9-]+/?)"'

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?(.*)$"


def _host_sql(url: str) -> str:
    return f"lower(regexp_extract({url}, '{_PARTS}', 2))"


def _canonical_sql(url: str) -> str:
    branches = " ".join(f"WHEN '{h}' THEN '{o}'" for h, o in HOSTS.items())
    return (f"coalesce(CASE {_host_sql(url)} {branches} END || regexp_extract({url}, '{_PARTS}', 3), {url})")


def _source_sql(url: str) -> str:
    branches = " ".join(f"WHEN contains({_host_sql(url)}, '{s}') THEN '{s}'" for s in SOURCES)
    return f"CASE {branches} END"


@query(rf"""
SELECT page_id, {_canonical_sql('url')} AS canonical, {_source_sql('url')} AS source,
       regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path
FROM pages""")
def url_canonical(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.canonical(u, HOSTS).alias("canonical"),
        urls.source_of(u, SOURCES).alias("source"), urls.path(u).alias("path"))


_ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
_LINKS = f"""
found AS (SELECT page_id, url, z.pos - 1 AS pos, {_canonical_sql(_ORIGIN + " || z.path")} AS link
          FROM pages, unnest(regexp_extract_all(html, '{LINK}', 1)) WITH ORDINALITY AS z(path, pos))"""


@query(f"""
WITH {_LINKS}
SELECT link, arg_min(page_id, (page_id, pos)) AS first_page, arg_min(pos, (page_id, pos)) AS first_pos,
       count(*) AS n
FROM found GROUP BY link""")
def link_discovery(spark, sf_dir):
    found = sitemaps.discover_links(texts(spark, sf_dir, "pages"), LINK, HOSTS)
    at = F.struct("page_id", "pos")
    return found.groupBy("link").agg(
        F.min(at)["page_id"].alias("first_page"),
        F.min(at)["pos"].cast("bigint").alias("first_pos"), F.count("*").alias("n"))


def _escape(c):
    return F.replace(c, F.lit("&"), F.lit("&amp;"))


def _sitemap_files(spark, sf_dir):
    """Per page: an index file naming one sitemap, and that sitemap with the
    page and its links. Sitemaps of hosts with 'spam' in them are cut short."""
    p = table(spark, sf_dir, "pages")
    paths = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    links = F.transform(paths, lambda x: F.concat(urls.origin(F.col("url")), x))
    entries = F.transform(F.concat(F.array("url"), links), lambda u: F.concat(
        F.lit("<url><loc> "), _escape(u), F.lit("\n</loc></url>")))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    whole = F.concat(F.lit(f"{head}<urlset {space}>"), F.array_join(entries, ""), F.lit("</urlset>"))
    cut = F.when(F.contains("url", F.lit("spam")), F.substr(whole, F.lit(1), F.length(whole) - 12))
    listing = p.select(F.concat(F.lit("sm/"), F.col("page_id").cast("string")).alias("sitemap"),
                       F.coalesce(cut, whole).alias("xml"))
    index = p.select(
        F.concat(F.lit("ix/"), F.col("page_id").cast("string")).alias("sitemap"),
        F.concat(F.lit(f"{head}<sitemapindex {space}><sitemap><loc>sm/"),
                 F.col("page_id").cast("string"), F.lit("</loc></sitemap></sitemapindex>")).alias("xml"))
    roots = p.select(urls.authority(F.col("url")).alias("source"),
                     F.concat(F.lit("ix/"), F.col("page_id").cast("string")).alias("sitemap"))
    return roots, listing.unionAll(index)


_HOST = _host_sql("url")


@query(f"""
WITH {_LINKS},
raw_links AS (SELECT page_id, url, z.pos, {_ORIGIN} || z.path AS link
              FROM pages, unnest(regexp_extract_all(html, '{LINK}', 1)) WITH ORDINALITY AS z(path, pos)),
listed AS (SELECT {_HOST} source, {_canonical_sql('url')} AS url, '[0,0]' AS position FROM pages
           UNION ALL SELECT {_HOST}, {_canonical_sql('link')}, '[0,' || pos || ']' FROM raw_links)
SELECT source, url, position, count(*) AS n FROM listed WHERE NOT contains(source, 'spam') GROUP BY ALL""")
def sitemap_urls(spark, sf_dir):
    """Two levels of sitemaps; a host with a broken one yields nothing."""
    roots, files = _sitemap_files(spark, sf_dir)
    found = sitemaps.expand_sitemaps(roots, files, HOSTS)
    return found.groupBy("source", "url", F.to_json("order").alias("position")).agg(
        F.count("*").alias("n"))


def _frontier_groups(spark, sf_dir):
    """Seeds: the pages; then their links; then the pages once more as written."""
    p = table(spark, sf_dir, "pages")
    source = urls.source_of(F.col("url"), SOURCES).alias("source")
    key = F.col("page_id").cast("int")
    seeds = p.select(source, urls.canonical(F.col("url"), HOSTS).alias("url"), F.array(key).alias("order"))
    links = sitemaps.discover_links(p, LINK, HOSTS).select(
        source, F.col("link").alias("url"), F.array(key, F.col("pos")).alias("order"))
    again = p.select(source, "url", F.array(key).alias("order"))
    return [seeds, links, again]


_FRONTIER = f"""
{_LINKS},
listed AS (SELECT {_source_sql('url')} source, {_canonical_sql('url')} AS url, 0 priority, page_id a, -1 b FROM pages
  UNION ALL SELECT {_source_sql('url')}, link, 1, page_id, pos FROM found
  UNION ALL SELECT {_source_sql('url')}, url, 2, page_id, -1 FROM pages),
merged AS (SELECT source, url, min((priority, a, b)) AS first FROM listed GROUP BY source, url)"""


@query(f"""
WITH {_FRONTIER} SELECT source, url, first[1]::BIGINT AS priority FROM merged""")
def frontier(spark, sf_dir):
    merged = sitemaps.merge_frontier(_frontier_groups(spark, sf_dir))
    return merged.select("source", "url", F.col("priority").cast("bigint"))


@query(f"""
WITH {_FRONTIER},
r AS (SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY first) rank FROM merged)
SELECT source, url FROM r WHERE rank <= 25""")
def frontier_limit(spark, sf_dir):
    """At most 25 URLs per source, in frontier order."""
    return sitemaps.merge_frontier(_frontier_groups(spark, sf_dir), limit=25).select("source", "url")


# -- news pages built from the documents ------------------------------------


def _news_html(text, title, day, og, kicker):
    body = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(
        F.lit('<html><head><meta property="og:url" content="'), og,
        F.lit('"/></head><body><h1>logo</h1><h3 class="Primary x">'), kicker,
        F.lit('</h3><br><article class="n"><header><h1>'), title,
        F.lit('</h1><small class="date">'), day, F.lit('</small></header><div class="formatted"><p>'),
        body, F.lit('</p></div><div><a href="/Account/Login?r=1">MAS</a></div></article></body></html>'))


_NEWS = "https://news.example.test/biblioteca-cientifica/noticias-actualidad/"


def _pages_of_docs(spark, sf_dir):
    """English documents as pages of the news site, the others as extractor output.

    By source: src1x pages are detail pages; of the others those with a line break
    are listings and the rest login pages. Toxic documents failed to fetch.
    """
    d = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ident = F.col("doc_id").cast("string")
    title = F.concat(F.lit("T "), ident)
    long_source = F.length("source") == 5
    broken = F.contains("text", F.lit("\n"))
    og = (F.when(long_source, F.concat(F.lit(_NEWS), F.col("lang"), F.lit("/"), ident))
          .when(broken, F.concat(F.lit(_NEWS), F.col("lang"), F.lit("/")))
          .otherwise(F.lit("https://news.example.test/Account/Login")))
    kicker = F.when(F.col("quality") == 1, F.lit(" Salud\n oral ")).otherwise(F.lit(""))
    html = _news_html(F.col("text"), title, F.lit("el 05/11/2024."), og, kicker)
    english = F.col("lang") == "en"
    extract = F.to_json(F.struct(
        F.struct(F.when(F.col("lang") == "es", F.lit("https://x/Account/Login?u=1"))
                 .otherwise(F.col("url")).alias("url"), F.col("title").alias("title")).alias("metadata"),
        F.struct(F.concat(F.lit("\n "), F.col("text"), F.lit(" \n")).alias("markdown")).alias("content")))
    return d.select(
        "doc_id", "url", F.when(english, "portal").otherwise("site").alias("source"),
        F.when(english, html).alias("html"), extract.alias("extract"),
        F.when(F.col("toxic") == 1, "timeout>40s").alias("error"), "quality", "text")


_FETCHED = f"""
p AS (SELECT doc_id, {DOC_URL} AS asked, lang, text, {DOC_TITLE} AS title, quality, toxic,
        lang = 'en' AS english, length(source) = 5 AS detail, contains(text, chr(10)) AS broken
      FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT *, {norm_sql('text')} AS summary, {strip_sql('text')} AS markdown,
        english AND detail AND length({norm_sql('text')}) >= 40 AS is_news,
        english AND NOT detail AND NOT broken AS walled FROM p),
f AS (SELECT *, CASE WHEN is_news THEN NULL WHEN walled THEN 'login wall'
        WHEN toxic = 1 THEN 'timeout>40s'
        WHEN length(markdown) < 50 THEN 'empty content (len=' || length(markdown) || ')'
        WHEN lang = 'es' THEN 'login wall' END AS failure,
      CASE WHEN is_news THEN '{_NEWS}' || lang || '/' || doc_id ELSE asked END AS url,
      CASE WHEN is_news THEN concat_ws(chr(10), '[RESUMEN_PUBLICO_PORTAL]',
        'Este es únicamente el resumen público de una noticia de portal. El artículo completo requiere iniciar sesión en el portal de profesionales de la salud.',
        '', 'Título: T ' || doc_id, CASE WHEN quality = 1 THEN 'Especialidad: Salud oral' END,
        'Fecha: 05/11/2024', 'Resumen: ' || summary) ELSE markdown END AS body FROM n),
r AS (SELECT *, failure IS NULL AND coalesce(quality, 0) = 1 AND NOT is_news AS same FROM f)"""


def _processed(spark, sf_dir):
    return staged(cr.process_pages(_pages_of_docs(spark, sf_dir), ["portal"], "portal"), "pages")


def _existing(spark, sf_dir):
    """High-quality documents were stored before with the text they have now."""
    d = documents(spark, sf_dir).join(
        table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")
    return d.select("url", tx.content_hash(tx.strip(F.col("text"))).alias("content_hash"))


@query(f"""
WITH {_FETCHED}
SELECT url, CASE WHEN english THEN 'portal' ELSE 'site' END AS source,
       CASE WHEN failure IS NOT NULL THEN 'failed' WHEN same THEN 'skipped' ELSE 'fetched' END AS status,
       CASE WHEN failure IS NOT NULL THEN failure WHEN same THEN 'hash unchanged'
            WHEN is_news THEN 'news summary' ELSE '' END AS reason
FROM r""")
def crawl_results(spark, sf_dir):
    return cr.report(cr.fetch_results(_processed(spark, sf_dir), _existing(spark, sf_dir), force=False))


@query(f"""
WITH {_FETCHED}
SELECT url, CASE WHEN is_news THEN 'T ' || doc_id ELSE title END AS title, sha256(body) AS content_hash,
       length(body) AS n_chars
FROM r WHERE failure IS NULL AND NOT same""")
def crawl_payloads(spark, sf_dir):
    docs = cr.payloads(
        cr.fetch_results(_processed(spark, sf_dir), _existing(spark, sf_dir), force=False), "2024-01-01")
    return docs.select("url", "title", "content_hash",
                       F.length("text").cast("bigint").alias("n_chars"))


@query(f"""
WITH {_FETCHED}
SELECT CASE WHEN english THEN 'portal' ELSE 'site' END AS source,
       CASE WHEN failure IS NOT NULL THEN 'failed' ELSE 'fetched' END AS status, count(*) AS n
FROM r GROUP BY 1, 2""")
def crawl_counts_forced(spark, sf_dir):
    return cr.count_statuses(
        cr.fetch_results(_processed(spark, sf_dir), _existing(spark, sf_dir), force=True))


@query(f"""
WITH {_FETCHED}
SELECT doc_id, is_news, walled AS is_login,
       CASE WHEN is_news THEN 'T ' || doc_id END AS title,
       CASE WHEN is_news AND quality = 1 THEN 'Salud oral' END AS subtitle,
       CASE WHEN is_news THEN '05/11/2024' END AS date,
       CASE WHEN is_news THEN sha256(summary) END AS summary_hash
FROM n WHERE english""")
def news_items(spark, sf_dir):
    p = _pages_of_docs(spark, sf_dir).filter(F.col("source") == "portal")
    item = p.withColumn("page", newspage.read_page(F.col("html"))).withColumn(
        "item", newspage.news_item(F.col("page"), F.col("url")))
    return item.select(
        "doc_id", F.col("item").isNotNull().alias("is_news"),
        newspage.is_login_page(F.col("html")).alias("is_login"), "item.title", "item.subtitle",
        "item.date", F.sha2("item.summary", 256).alias("summary_hash"))


@query(r"""
SELECT page_id, regexp_replace(replace(regexp_extract(html, '<article><h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;?', '&', 'g') AS title
FROM pages""")
def page_titles(spark, sf_dir):
    """Heading inside the article of every page, read by the page parser."""
    page = texts(spark, sf_dir, "pages").withColumn("page", newspage.read_page(F.col("html")))
    return page.select("page_id", F.col("page.title").alias("title"))


@query(f"""
WITH {_FETCHED}
SELECT CASE WHEN contains({_host_sql('url')}, 'example') THEN 'example' END AS source, url,
       url || chr(9) || failure AS line
FROM r WHERE failure IS NOT NULL""")
def failure_log(spark, sf_dir):
    """Failures written as log lines and read back, one row per URL to retry."""
    lines = failures.failure_lines(
        cr.fetch_results(_processed(spark, sf_dir), _existing(spark, sf_dir), force=False))
    again = failures.parse_failures(lines, ["example"])
    return again.join(lines.select(F.substring_index("value", "\t", 1).alias("url"),
                                   F.col("value").alias("line")), "url").select("source", "url", "line")


@query(f"""
WITH {_FETCHED},
k AS (SELECT url, row_number() OVER (ORDER BY url) rank FROM r WHERE failure IS NOT NULL)
SELECT 'example' AS source, url FROM k WHERE rank <= 20""")
def retry_frontier(spark, sf_dir):
    """First 20 failed URLs per source, for a retry run."""
    lines = failures.failure_lines(
        cr.fetch_results(_processed(spark, sf_dir), _existing(spark, sf_dir), force=False))
    return failures.retry_frontier(failures.parse_failures(lines, ["example"]), limit=20)
