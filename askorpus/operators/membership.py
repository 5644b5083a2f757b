"""Wide rows that a set of keys may concern, told apart without moving them.

A semi or anti join whose key side is too large to broadcast shuffles the wide side, text and all,
to find what is often a few rows. Here the keys first become a bitmap: one bit for each hash slot,
64 slots a row, at most ``MOST_BITS`` slots in all. Its size has a fixed bound, so it can always
be broadcast to the scan. Rows whose slot is empty are not among the keys and stay where
they are; only the rest is joined exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askorpus.operators.partitioning import estimated_bytes
from askorpus.sources.staging import staged

# Slots are 2 to the power of these; the most take 16 MB as (word, bits) rows.
LEAST_BITS, MOST_BITS = 12, 26
# Slots for each key, as a power of 2, while there are enough.
SPARSE = 4


def _slot(keys: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def bitmap(wanted: DataFrame, keys: Sequence[str], most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """(_word, _bits) of the slots of ``wanted``'s keys, and the power of 2 of all slots."""
    many = wanted.select(*keys).count()
    bits = min(most_bits, max(LEAST_BITS, many.bit_length() + SPARSE))
    words = wanted.select(_slot(keys, bits).alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_slot % 64 AS INT))")).alias("_bits"))
    return staged(words, "bitmap"), bits


def marked(wide: DataFrame, wanted: DataFrame, keys: Sequence[str], most_bits: int = MOST_BITS,
           name: str = "_may") -> DataFrame:
    """``wide`` with a flag that is false only where the key is not in ``wanted``.

    ``wanted`` is read twice and should be written out. A null key is in no set of keys.
    """
    words, bits = bitmap(wanted, keys, most_bits)
    slot = _slot(keys, bits)
    rows = wide.withColumn("_slot", slot).withColumn("_word", F.expr("_slot div 64"))
    hit = F.expr("(_bits & shiftleft(1L, CAST(_slot % 64 AS INT))) <> 0")
    return rows.join(F.broadcast(words), "_word", "left").select(
        *wide.columns, F.coalesce(hit, F.lit(False)).alias(name))


def sendable(df: DataFrame) -> bool:
    """Whether the optimiser would broadcast ``df`` by its own estimate."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit = int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)) if text != "-1" else -1
    return estimated_bytes(df) <= limit


def wide_semi(wide: DataFrame, wanted: DataFrame, keys: Sequence[str], most_bits: int = MOST_BITS) -> DataFrame:
    """Rows of ``wide`` whose key is in ``wanted``; other rows are dropped where they are read."""
    if sendable(wanted):
        return wide.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    may = marked(wide, wanted, keys, most_bits).where("_may").drop("_may")
    return may.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def wide_anti(wide: DataFrame, wanted: DataFrame, keys: Sequence[str], most_bits: int = MOST_BITS) -> DataFrame:
    """Rows of ``wide`` whose key is not in ``wanted``; most of them are never moved."""
    if sendable(wanted):
        return wide.join(wanted.select(*keys).distinct(), list(keys), "left_anti").select(*wide.columns)
    flagged = marked(wide, wanted, keys, most_bits)
    doubtful = flagged.where("_may").drop("_may").join(wanted.select(*keys).distinct(), list(keys), "left_anti")
    return flagged.where("NOT _may").drop("_may").select(*wide.columns).unionAll(doubtful.select(*wide.columns))
