"""Failure log: TSV of url and reason, and what to retry from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.functions import urls
from askorpus.functions.text import strip
from askorpus.operators.ordering import top_n_per_key


def failure_lines(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "failed").select(
        F.concat_ws("\t", "url", "reason").alias("value"))


def write_failures(results: DataFrame, path: str) -> None:
    """Overwrite the log; a run without failures leaves an empty one."""
    failure_lines(results).write.mode("overwrite").text(path)


def read_failures(spark: SparkSession, path: str, sources: Sequence[str]) -> DataFrame:
    return parse_failures(spark.read.text(path), sources)


def parse_failures(lines: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(source, url) per usable line. Blank lines and unknown hosts are left out.

    Rows rather than one list per source: a single source may own most of them.
    """
    url = strip(F.substring_index(F.col("value"), "\t", 1))
    return (lines.select(url.alias("url")).filter(F.length("url") > 0)
            .select(urls.source_of(F.col("url"), sources).alias("source"), "url")
            .filter(F.col("source").isNotNull()))


def unknown_hosts(lines: DataFrame, sources: Sequence[str]) -> DataFrame:
    url = strip(F.substring_index(F.col("value"), "\t", 1))
    return lines.select(url.alias("url")).filter(
        (F.length("url") > 0) & urls.source_of(F.col("url"), sources).isNull())


def lines_not_of(lines: DataFrame, tried: DataFrame) -> DataFrame:
    """Lines whose URL was not tried: unknown hosts, other sites, beyond a limit."""
    url = strip(F.substring_index(F.col("value"), "\t", 1))
    return lines.withColumn("url", url).filter(F.length("url") > 0).join(
        tried.select("url").distinct(), "url", "left_anti").select("value")


def retry_frontier(failures: DataFrame, site: str = "all", limit: int = 0) -> DataFrame:
    """URLs of a retry run, in URL order within each source."""
    chosen = failures if site == "all" else failures.filter(F.col("source") == site)
    if limit > 0:
        chosen = top_n_per_key(chosen, ["source"], [F.col("url")], limit).drop("rank")
    return chosen
