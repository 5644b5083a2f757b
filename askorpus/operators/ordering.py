"""First-wins and last-N per key, shaped so that one hot key cannot fill a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in ``order``.

    An aggregate rather than a row_number window: the map side keeps one row
    per key, so a key holding a third of the input still shuffles only one row
    per task. Equal positions are settled by the other columns, so repeating a
    lost task gives the same row.
    """
    rest = [*order, *(c for c in df.columns if c not in keys and c not in order)]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """At most ``n`` rows per key with their 1-based rank.

    The optimiser puts a group limit in front of the shuffle, so each task
    sends at most ``n`` rows per key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def last_n_per_key(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Last ``n`` rows per key; sort by ``order`` to read them oldest first.

    Equal positions are settled by the other columns, so the choice does not
    depend on how the rows are spread.
    """
    ties = [F.col(c).desc() for c in sorted(df.columns) if c not in keys and c != order]
    return top_n_per_key(df, keys, [F.col(order).desc(), *ties], n, "_back").drop("_back")


def list_per_key(df: DataFrame, keys: Sequence[str], order: str,
                 item: Column, name: str) -> DataFrame:
    """Ordered array per key. Only for groups already cut to a few rows."""
    collected = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(collected, lambda x: x["v"]).alias(name))
