"""Health: is the store readable, does the model answer, how many chunks are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.config import Settings


def health_row(chunks: DataFrame, settings: Settings, db_ok: bool, model_ok: bool | None) -> DataFrame:
    """``model_ok`` is None where no model was asked; then ``ok`` is unknown too,
    unless the store already fails."""
    asked = F.lit(model_ok).cast("boolean")
    return chunks.agg(F.count("*").alias("chunk_count")).select(
        (F.lit(db_ok) & asked).alias("ok"), F.lit(db_ok).alias("db_ok"),
        asked.alias("ollama_ok"), F.lit(settings.llm_model).alias("llm_model"),
        F.lit(settings.embed_model).alias("embed_model"), "chunk_count")


def answers_without_error(probe: Callable[[], object]) -> bool:
    try:
        return probe() is not False
    except Exception:
        return False


def health(spark: SparkSession, read_chunks: Callable[[], DataFrame],
           read_threads: Callable[[], DataFrame], model_probe: Callable[[], object] | None,
           settings: Settings) -> DataFrame:
    """One row. A table that cannot be read counts 0 chunks rather than failing."""
    db_ok = answers_without_error(lambda: read_threads().limit(1).count())
    chunks = spark.range(0)
    if answers_without_error(lambda: read_chunks().limit(1).count()):
        chunks = read_chunks()
    model_ok = None if model_probe is None else answers_without_error(model_probe)
    return health_row(chunks, settings, db_ok, model_ok)
