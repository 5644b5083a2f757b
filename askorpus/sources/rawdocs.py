"""Raw documents: JSON files in, keyed table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askorpus.functions.urls import slug
from askorpus.functions.values import parse_time
from askorpus.operators.ordering import first_per_key
from askorpus.schemas import RAW_DOC
from askorpus.sources.staging import staged

_WITH_CORRUPT = T.StructType(
    list(RAW_DOC.fields) + [T.StructField("_corrupt", T.StringType())])


# A document that spans lines is read as one value; beyond this it is reported as corrupt.
LONGEST_FILE = 256 << 20


def read_json_texts(spark: SparkSession, path: str, longest: int = LONGEST_FILE) -> DataFrame:
    """One row per document in the *.json files under ``path``: (file, value).

    A file holds one document, which may span lines, or one document on each line. Lines are read
    first, so a file of many documents is split over tasks; it is known by most of its
    lines being objects. Only the other files, at most ``longest`` bytes each, are read whole.
    """
    source = spark.read.option("pathGlobFilter", "*.json")
    lines = source.text(path).select(
        F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_size").alias("size"), "value").filter(F.trim("value") != "")
    whole_line = F.rlike("value", F.lit(r"^\s*\{.*\}\s*$"))
    kinds = staged(lines.groupBy("at", "file", "size").agg(
        (F.count_if(whole_line) * 2 > F.count("*")).alias("per_line")), "json-kinds")
    by_line = kinds.filter("per_line").select("at")
    records = lines.join(by_line, "at", "left_semi").select("file", "value")
    # the size is compared when files are listed, so larger ones are not opened
    single = (source.text(path, wholetext=True).filter(F.col("_metadata.file_size") <= longest)
              .select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_name").alias("file"), "value")
              .join(by_line, "at", "left_anti").select("file", "value"))
    beyond = kinds.filter(~F.col("per_line") & (F.col("size") > longest)).select(
        "file", F.concat(F.lit("too long for one document: "), F.col("size")).alias("value"))
    return records.unionAll(single).unionAll(beyond)


def parse_raw(texts: DataFrame, only: str | None = None, value: str = "value") -> DataFrame:
    """Parse JSON texts; rows that do not parse have a non-null ``_corrupt``.

    ``only`` looks for a substring in the JSON text itself, escapes included.
    """
    if only:
        texts = texts.filter(F.contains(value, F.lit(only)))
    parsed = F.from_json(F.col(value), _WITH_CORRUPT, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return texts.select(parsed.alias("d")).select(
        *[F.col(f"d.{f}").alias(f) for f in RAW_DOC.fieldNames()],
        F.coalesce(F.col("d._corrupt"), F.when(F.col("d.url").isNull(), F.lit("no url")))
        .alias("_corrupt"))


def good_docs(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def bad_docs(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("_corrupt").isNotNull()).select("_corrupt")


def to_json_text(url: Column, source: Column, title: Column, text: Column,
                 content_hash: Column, fetched_at: Column) -> Column:
    return F.to_json(F.struct(
        url.alias("url"), source.alias("source"), title.alias("title"), text.alias("text"),
        content_hash.alias("content_hash"), fetched_at.alias("fetched_at")),
        {"ignoreNullFields": "false"})


def write_json_files(docs: DataFrame, path: str) -> None:
    """JSON lines, spread by slug; for exchange with readers of JSON."""
    docs.select(RAW_DOC.fieldNames()).repartition(slug(F.col("url"))).write.mode(
        "overwrite").option("ignoreNullFields", "false").json(path)


def newest_per_url(docs: DataFrame) -> DataFrame:
    """One row per URL: a later fetch overwrites an earlier one."""
    return first_per_key(
        docs.withColumn("_age", -F.unix_micros(parse_time(F.col("fetched_at")))),
        ["url"], ["_age"]).drop("_age")
