"""Where registered queries and their check SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.functions import urls
from askorpus.operators.partitioning import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, for queries that work hard on every row."""
    return spread(table(spark, sf_dir, name))


def doc_url(doc_id: Column | str = "doc_id") -> Column:
    return F.concat(F.lit("https://example.test/d/"), F.col(doc_id).cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the shape of raw documents."""
    return texts(spark, sf_dir, "documents").select(
        "doc_id", doc_url().alias("url"), "source", "lang",
        F.when(F.col("lang") != "fr", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
        .alias("title"), "text", F.sha2("text", 256).alias("content_hash"))


def thread_id(conv: str = "conv_id") -> Column:
    return urls.uuid5(F.concat(F.lit("c"), F.col(conv).cast("string")))


def message_id(conv: str = "conv_id", turn: str = "turn") -> Column:
    return urls.uuid5(F.concat(F.lit("m"), F.col(conv).cast("string"), F.lit("."),
                               F.col(turn).cast("string")))


# -- the same things in SQL -------------------------------------------------

DOC_URL = "'https://example.test/d/' || doc_id"
DOC_TITLE = "CASE WHEN lang <> 'fr' THEN 'Doc ' || doc_id END"


def uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
            f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab') || "
            f"substr({h},18,3) || '-' || substr({h},21,12))")


def plain_sql(c: str) -> str:
    for _ in range(3):
        c = rf"regexp_replace({c}, '!\[[^\]]*\]\([^)]*\)', '', 'g')"
        c = rf"regexp_replace({c}, '\[[^\]]*\]\([^)]*\)', '', 'g')"
    return c


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def quality_sql(c: str) -> str:
    return f"(length({strip_sql(c)}) >= 80 AND length({norm_sql(plain_sql(c))}) >= 80)"


def chunk_hash_sql(c: str) -> str:
    return rf"sha256(regexp_replace(lower({strip_sql(c)}), '\s+', ' ', 'g'))"


def any_of_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


def embed_sql(name: str, source: str, key: str, text: str, dim: int = 64) -> str:
    """CTEs giving ``name``(key, vec) for the hashing embedder."""
    return rf"""
{name}_w AS (SELECT {key} k, unnest(regexp_split_to_array(lower({text}), '\s+')) w FROM {source}),
{name}_s AS (SELECT k, ('0x' || substr(md5(w), 1, 8))::BIGINT n FROM {name}_w WHERE w <> ''),
{name}_v AS (SELECT k, n % {dim} slot, sum(CASE WHEN (n // {dim}) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE v
             FROM {name}_s GROUP BY 1, 2),
{name}_n AS (SELECT k, sqrt(sum(v * v)) norm FROM {name}_v GROUP BY k),
{name} AS (
  SELECT f.k, list((coalesce(CASE WHEN norm > 0 THEN v / norm ELSE 0 END, 0)::FLOAT)::DOUBLE ORDER BY f.slot) vec
  FROM (SELECT {key} k, slot FROM {source}, range({dim}) r(slot)) f
  LEFT JOIN {name}_v v ON v.k = f.k AND v.slot = f.slot LEFT JOIN {name}_n n ON n.k = f.k
  GROUP BY f.k)"""
