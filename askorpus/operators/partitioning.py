"""Sizes: spreading small inputs, and cutting large ones to a batch of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Input per core below which a scan is likely to leave cores idle.
SMALL_BYTES_PER_CORE = 16 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate. Nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def narrow_to(large: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of ``large`` whose key occurs in ``batch``.

    An outer or anti join cannot broadcast the side it keeps, so a small batch
    joined to a large table would make the table shuffle. Cut to the batch's
    keys first, the table is only scanned: a small key set is broadcast to it.
    """
    return large.join(batch.select(key).distinct(), key, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input too small to give every core a row group of its own.

    Such a table is read by one or two tasks, and everything up to the next
    shuffle would run in them. A large input has partitions to spare and is left
    alone, so nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * SMALL_BYTES_PER_CORE else df
