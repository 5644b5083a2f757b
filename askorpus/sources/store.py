"""Keyed Parquet tables in hash buckets of their key.

A bucket is a folder. Rows with new keys are added to their buckets as further files. Where a change
replaces or removes rows that exist, Spark rewrites just the buckets they lie in, by dynamic partition
overwrite: it puts the new files in place of the old when all of them are written, so the rows that stay are
read from the very buckets. Applying the same change again gives the same table, so a run that was cut short
is repaired by repeating it. One writer at a time; with a table format at hand, replace ``commit``
by its MERGE.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askorpus.operators.membership import wide_anti
from askorpus.operators.partitioning import estimated_bytes
from askorpus.sources.staging import staged

# Buckets of a table. Choose so many that one of them is a few hundred megabytes.
BUCKETS = 16
# A change of at most so many bytes is moved, to make one file of each bucket. Of a larger one every
# task adds its own file to a bucket, and no row moves.
MOVED_BYTES = 64 << 20


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    key: str


@dataclass(frozen=True)
class Change:
    """Rows to write, and (optionally) a one-column frame of keys to remove. Stored rows with
    the key of a written row are replaced."""

    rows: DataFrame | None = None
    replaced: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), dict(tables), buckets

    # -- reading -----------------------------------------------------------

    def exists(self, name: str) -> bool:
        """Whether the table has ever been written."""
        return self._fs().exists(self._path(f"{self.root}/{name}"))

    def read(self, name: str) -> DataFrame:
        """Current rows of a table."""
        return self._stored(name).drop("bucket")

    def _stored(self, name: str) -> DataFrame:
        full = T.StructType([*self.tables[name].schema.fields, T.StructField("bucket", T.IntegerType())])
        if not self.exists(name):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.root}/{name}")

    # -- writing -----------------------------------------------------------

    def commit(self, changes: Mapping[str, Change]) -> dict[str, list[int]]:
        """Apply changes table by table, in their order; returns the buckets rewritten in each."""
        return {name: self._apply(name, change) for name, change in changes.items()}

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _apply(self, name: str, change: Change) -> list[int]:
        table = self.tables[name]
        rows, exists = None, self.exists(name)
        if change.rows is not None:
            rows = change.rows.select(*table.schema.fieldNames()).withColumn("bucket", self._bucket(F.col(table.key)))
            if exists:
                # written out first: rows are read several times, and may come from the files that are about to be replaced
                rows = staged(rows, "store-rows")
        touched = []
        if exists:
            keys = [f.select(table.key) for f in (rows, change.replaced) if f is not None]
            keys = staged((keys[0].unionAll(keys[1]) if len(keys) > 1 else keys[0]).distinct(), "store-keys")
            # keys and bucket numbers only; there are no more numbers than buckets
            hit = self._stored(name).select(table.key, "bucket").join(keys, table.key, "left_semi")
            touched = sorted(r[0] for r in hit.select("bucket").distinct().collect())
            if touched:
                stored = self._stored(name).filter(F.col("bucket").isin(touched))
                kept = wide_anti(stored, keys, [table.key])
                # which buckets keep rows is asked of keys alone, before the files change
                left = stored.select(table.key, "bucket").join(keys, table.key, "left_anti").select("bucket")
                if rows is not None:
                    new = rows.filter(F.col("bucket").isin(touched))
                    kept, left = kept.unionByName(new), left.unionAll(new.select("bucket"))
                self._overwrite(kept, name, touched, {r[0] for r in left.distinct().collect()})
        if rows is not None:
            self._write(rows.filter(~F.col("bucket").isin(touched)) if touched else rows, name, "append")
        return touched

    def _overwrite(self, kept: DataFrame, name: str, touched: list[int], full: set[int]) -> None:
        """Put ``kept`` in place of the buckets; one without rows is not part of the overwrite and goes."""
        if full:
            self._write(kept, name, "overwrite")
        for bucket in set(touched) - full:
            self._fs().delete(self._path(f"{self.root}/{name}/bucket={bucket}"), True)

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        if estimated_bytes(df) <= MOVED_BYTES:
            df = df.repartition("bucket")
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")

    def compact(self) -> None:
        """Write every bucket as one set of files again. Nobody may write meanwhile."""
        for name in self.tables:
            if self.exists(name):
                self._write(staged(self._stored(name), "store-compact").repartition("bucket"), name, "overwrite")

    def reset(self, confirm: bool = False) -> None:
        """Delete every table of this store. Raw documents live elsewhere and stay."""
        if not confirm:
            raise ValueError("reset deletes all tables; pass confirm=True")
        self._fs().delete(self._path(self.root), True)

    # -- files -------------------------------------------------------------

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(
            self.spark.sparkContext._jsc.hadoopConfiguration())
