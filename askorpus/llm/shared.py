"""What several operators need: staged tables, ordered prefix sums, row groups of bounded size."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from askorpus.sources.staging import shared_dir

# Rows a task works on at a time in Python; long texts make such a group large enough.
ROWS_AT_ONCE = 512
# Bytes of one column in such a group of rows, where a row is not longer by itself.
BYTES_AT_ONCE = 8 << 20
# Bytes of an Arrow batch that Spark hands to Python, where texts are read row by row.
BATCH_BYTES = 4 << 20


class Scratch:
    """Tables written to the shared folder and read back, so lost executors cost only
    the tasks that were running. ``drop`` deletes what later steps no longer read."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{job}-{uuid4().hex}"
        self.made: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.made[name] = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_counted(self, df: DataFrame, name: str, value: Column | None = None) -> tuple[DataFrame, int | None]:
        """``put``, and the sum of ``value`` or else the number of the rows, taken while they are written. A
        sum over no rows is None, a number 0."""
        seen = Observation()
        what = F.count(F.lit(1)) if value is None else F.sum(value)
        out = self.put(df.observe(seen, what.alias("seen")), name)
        # Spark may leave out an observation of rows that it knows to be none
        found = seen.get.get("seen")
        return out, 0 if value is None and found is None else found

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.made.pop(name))
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in batches of a few megabytes, not of 10,000 rows. A
    batch is held by the task and by its Python worker at once. Rows and results stay the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_now = spark.conf.get(key).lower().removesuffix("b")
    if not bytes_now.isdigit() or int(bytes_now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tokens_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def apart(docs: DataFrame, uses: list[str]) -> DataFrame:
    """The columns that an operator uses, and all others in one column, so that none of them can meet
    a column that the operator makes."""
    rest = [F.col(c) for c in docs.columns if c not in uses]
    return docs.select(*uses, F.struct(*rest or [F.lit(0).alias("none")]).alias("__others"))


def together(rows: DataFrame, docs: DataFrame, uses: list[str]) -> DataFrame:
    """The columns of ``docs`` again, untouched, of rows made from ``apart(docs, uses)``."""
    return rows.select(*[F.col(c) if c in uses else F.col("__others")[c].alias(c) for c in docs.columns])


def with_running_totals(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                        values: dict[str, Column]) -> DataFrame:
    """Adds, for each of ``values``, its sum over the rows of the same keys that come earlier.

    ``bucket`` must not decrease along ``order``. Each (keys, bucket) is summed on its own
    and only the bucket sums are accumulated per key, so a key holding a third of all
    rows is spread over as many tasks as it has buckets. Null keys are a key of their own.
    """
    inputs = {name: f"__value_{name}" for name in values}
    rows = df.withColumn("__bucket", bucket).withColumns(
        {inputs[name]: value.cast("long") for name, value in values.items()})
    sums = rows.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(c) for c in inputs.values()])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "__bucket", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in inputs.values()])
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__in{c}": F.coalesce(F.sum(c).over(within), F.lit(0))
                             for c in inputs.values()})
    left, right = rows.alias("r"), bases.alias("b")
    same = reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
                                   for k in [*keys, "__bucket"]])
    return left.join(right, same).select(
        *[F.col(f"r.{c}") for c in df.columns if c not in values],
        *[(F.col(f"b.{c}") + F.col(f"r.__in{c}")).alias(name) for name, c in inputs.items()])


def with_columns_by_arrow(df: DataFrame, reads: list[str], ddl: str, make,
                          keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with the columns of ``ddl``, replacing those of the
    same name.

    ``make()`` is called once per task and returns a function from the Arrow columns named
    in ``reads`` to a list of value lists, one per new column. Other columns pass through
    untouched, whatever their type; a text that is not kept is not sent back.
    """
    added = T._parse_datatype_string(ddl)
    names = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    extra = [r for r in reads if r not in names]
    places = [names.index(r) if r in names else len(names) + extra.index(r) for r in reads]
    schema = T.StructType([df.schema[c] for c in names] + list(added.fields))
    arrow_types = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                values = work(*[part.column(p) for p in places])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(names)], *[pa.array(v, type=t) for v, t in zip(values, arrow_types)]],
                    names=schema.names)
            pa.default_memory_pool().release_unused()

    return df.select(*names, *[F.col(r).alias(f"__in_{r}") for r in extra]).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, heavy: int, rows: int = ROWS_AT_ONCE, size: int = BYTES_AT_ONCE):
    """Parts of an Arrow batch of at most ``rows`` rows, and ``size`` bytes of column ``heavy``
    unless one row has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(heavy)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        fits = int(np.searchsorted(ends, base + size, "right")) - at
        many = min(rows, batch.num_rows - at, max(1, fits))
        yield batch.slice(at, many)
        at += many
    pa.default_memory_pool().release_unused()
