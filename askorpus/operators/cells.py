"""Exact nearest neighbours over vectors stored in cells, reading only cells that may hold one.

``build_cells`` gives every vector to the nearest of a bounded number of pivots and stores each cell as
rings: up to ``RING`` vectors of similar distance to the pivot, with the least and
greatest of these distances. By the triangle inequality no vector of a ring is nearer to a query
than the gap between the query's own distance to the pivot and the ring. So

* the rings with the smallest gap in the nearest cells give each query k candidates and with
  them a bound for its k-th distance;
* of all other rings only those whose gap is within the bound are read.

Cells are folders of a Parquet table, so a join on the cell skips the others at the scan. Queries
are a table: they are dealt to rings by joins, in groups of bounded size, and never come to the
driver. A ring keeps its k best for each query, and Spark merges those per task and then per query.
Many equal vectors make many rings of one cell, not one large group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from askorpus.functions import vectors as vx
from askorpus.operators.ordering import top_n_per_key
from askorpus.operators.topk import Best
from askorpus.sources.staging import staged

# Pivots at most, and vectors of a cell while there are fewer.
CELLS, PER_CELL = 1024, 4096
# Vectors of a ring.
RING = 1024
# Queries that are compared with a ring at a time.
GROUP = 256
# Bytes of vectors for each task that writes rings.
TASK_BYTES = 64 << 20
# Distances to pivots are rounded; a ring this much farther than the bound is still read.
_SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """An index: where its rings lie and what every search needs, at most ``CELLS`` rows."""

    spark: SparkSession
    path: str
    schema: T.StructType
    pivots: np.ndarray
    stats: dict[int, tuple[int, float, float]]  # vectors, least and greatest distance to the pivot
    key_type: T.DataType

    def rings(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _lengths(vectors: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(vectors.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"a vector has another length than {dim}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), dim).astype(np.float64)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to each pivot."""
    out = np.empty((len(rows), len(pivots)))
    for a in range(0, len(rows), 1024):
        part = rows[a:a + 1024]
        squared = (part ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * part @ pivots.T
        out[a:a + 1024] = np.sqrt(np.maximum(squared, 0))
    return out


def build_cells(corpus: DataFrame, key: str, vector: str, path: str, cells: int | None = None,
                ring: int = RING) -> Cells:
    """Store the vectors of ``corpus`` at ``path``. Rows with a null vector are left out, one
    of another length than the rest is an error."""
    spark = corpus.sparkSession
    usable = corpus.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where("vector IS NOT NULL")
    many, dim = usable.agg(F.count("*"), F.max(F.size("vector"))).first()
    wanted = cells or min(CELLS, max(1, -(-many // PER_CELL)))
    # pivots are a bounded sample, the same in every run
    sample = usable.select("vector").distinct().orderBy(F.xxhash64("vector")).limit(wanted).collect() if many else []
    if any(len(r[0]) != dim for r in sample):
        raise ValueError(f"a vector has another length than {dim}")
    pivots = np.array([r[0] for r in sample], np.float64).reshape(len(sample), dim or 0)
    key_type = usable.schema["key"].dataType
    assigned = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()),
                             *usable.schema.fields])

    def assign(batches):
        for batch in batches:
            away = _distances(_lengths(batch.column(1), dim), pivots)
            cell = np.argmin(away, axis=1) if len(away) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell]), *batch.columns],
                names=assigned.names)

    rings = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
        T.StructField("n", T.IntegerType()), T.StructField("ring", T.StringType()),
        T.StructField("keys", T.ArrayType(key_type)), T.StructField("vectors", usable.schema["vector"].dataType)])

    def cut(batches):
        held: list[pa.RecordBatch] = []

        def made(last: bool):
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cell = rows.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:]):
                open_end = b == len(cell) and not last
                while b - a >= ring or (a < b and not open_end):
                    part = rows.slice(a, min(ring, b - a))
                    a += len(part)
                    away = part.column("away").to_numpy()
                    keys, vectors = (part.column(c).combine_chunks() for c in ("key", "vector"))
                    # the vectors of a task differ, so its first key names a ring
                    name = f"{int(cell[a - 1])}:{away[0]!r}:{keys[0].as_py()}:{len(part)}"
                    yield [int(cell[a - 1]), away[0], away[-1], len(part), name, keys, vectors.flatten()]
                if a < b:
                    held.extend(rows.slice(a, b - a).to_batches())

        def batch_of(found):
            lists = [pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(len(r[k]) for r in found)]), pa.int32()), pa.concat_arrays([r[k] for r in found]))
                for k in (5, 6)]
            plain = [pa.array([r[k] for r in found], to_arrow_type(rings.fields[k].dataType)) for k in range(5)]
            return pa.RecordBatch.from_arrays([*plain, *lists], names=rings.names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8 * ring and (found := list(made(False))):
                yield batch_of(found)
        if held and sum(b.num_rows for b in held) and (found := list(made(True))):
            yield batch_of(found)

    tasks = max(1, -(-many * (dim or 0) * 4 // TASK_BYTES))
    ordered = usable.mapInArrow(assign, assigned).repartitionByRange(tasks, "cell", "away", "key")
    (ordered.sortWithinPartitions("cell", "away", "key").mapInArrow(cut, rings)
     .write.mode("overwrite").partitionBy("cell").parquet(path))
    index = Cells(spark, path, T.StructType([*rings.fields[1:], rings.fields[0]]), pivots, {}, key_type)
    for r in index.rings().groupBy("cell").agg(F.sum("n"), F.min("low"), F.max("high")).collect():
        index.stats[r[0]] = (r[1], r[2], r[3])
    return index


def _reach(index: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(query, vector, cell, away, near) of the cells that may hold one of the k nearest; ``near`` are
    the nearest ones with k vectors together."""
    cells = np.array(sorted(index.stats), np.int64)
    many, low, high = (np.array([index.stats[c][i] for c in cells.tolist()]) for i in range(3))
    pivots = index.pivots[cells]
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("away", T.DoubleType()), T.StructField("near", T.BooleanType())])

    def run(batches):
        for batch in batches:
            away = _distances(_lengths(batch.column(1), pivots.shape[1]), pivots)
            least = np.maximum(0, np.maximum(away - high, low - away))
            # so many vectors lie within these distances: a first bound for the k-th
            order = np.argsort(away + high, axis=1, kind="stable")
            enough = np.argmax(np.cumsum(many[order], axis=1) >= min(k, many.sum()), axis=1)
            bound = np.take_along_axis(away + high, order, 1)[np.arange(len(away)), enough]
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(many[order], axis=1) - many[order]
            near = np.zeros(away.shape, bool)
            np.put_along_axis(near, order, before < k, 1)
            row, cell = np.nonzero((least <= bound[:, None] * (1 + _SLACK) + _SLACK) | near)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row)) for c in batch.columns), pa.array(cells[cell], pa.int32()),
                 pa.array(away[row, cell]), pa.array(near[row, cell])], names=schema.names)

    return queries.mapInArrow(run, schema)


def _scan(index: Cells, pairs: DataFrame, k: int, out: T.StructType) -> DataFrame:
    """The k best (query, key, distance) of each ring for the queries of ``pairs`` (query, vector, bound,
    cell, ring), none farther than its bound."""
    sizes = pairs.groupBy("cell", "ring").agg(F.count("*").alias("_n"))
    dealt = pairs.join(sizes, ["cell", "ring"]).withColumn(
        "_part", F.pmod(F.xxhash64("query"), F.ceil(F.col("_n") / GROUP)))
    groups = staged(dealt.groupBy("cell", "ring", "_part").agg(
        F.collect_list(F.struct("query", "vector", "bound")).alias("asked")), "ring-queries")
    # the cell is a folder: the join prunes those that nobody asked for. The filter drops nothing;
    # Spark prunes by a join only if the other side looks selective
    joined = index.rings().select("cell", "ring", "keys", "vectors").join(groups.where(F.size("asked") > 0), ["cell", "ring"]).select(
        "keys", "vectors", F.col("asked.query").alias("queries"), F.flatten("asked.vector").alias("targets"),
        F.col("asked.bound").alias("bounds"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, vectors, queries, targets, bounds = (batch.column(c)[row].values for c in range(5))
                asked = targets.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(queries), -1)
                limit = bounds.to_numpy(zero_copy_only=False)
                best = Best(asked, k)
                best.limit = np.minimum(best.limit, limit * (1 + _SLACK) + _SLACK)
                places = np.arange(len(keys))
                best.add(places, vectors.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1))
                which, near, distance = best.rows()
                yield pa.RecordBatch.from_arrays(
                    [queries.take(pa.array(which, pa.int64())), keys.take(pa.array(near, pa.int64())), pa.array(distance)],
                    names=out.names)

    return joined.mapInArrow(run, out)


def nearest_in_cells(index: Cells, queries: DataFrame, k: int, key: str = "key", query_key: str = "query_id",
                     query_vector: str = "vector", metric: str = "l2sq") -> DataFrame:
    """k nearest vectors of every query, exactly as ``topk.nearest_batch``: (query_key, key, distance,
    rank). Query keys are unique; a query with a null vector has no neighbours."""
    if metric not in vx.METRICS:
        raise ValueError(f"metric must be one of {vx.METRICS}")
    asked = queries.select(F.col(query_key).alias("query"), F.col(query_vector).alias("vector")).where("vector IS NOT NULL")
    out = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField("key", index.key_type),
                        T.StructField("distance", T.DoubleType())])
    named = [F.col("query").alias(query_key), F.col("key").alias(key), "distance", "rank"]
    if not index.stats:
        return index.spark.createDataFrame([], out).withColumn("rank", F.lit(0)).select(*named)
    reach = staged(_reach(index, asked, k), "cell-reach")
    rings = index.rings().select("cell", "ring", "low", "high", "n")
    gap = F.greatest(F.lit(0.0), F.col("away") - F.col("high"), F.col("low") - F.col("away"))
    order = Window.partitionBy("query").orderBy("gap", "cell", "ring")
    # k rings always hold k vectors; most often one does
    first = top_n_per_key(reach.where("near").join(rings, "cell").select("query", "vector", "cell", "ring", "n", gap.alias("gap")),
                          ["query"], [F.col("gap"), F.col("cell"), F.col("ring")], k, "_place")
    first = first.withColumn("_before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(
        F.coalesce("_before", F.lit(0)) < k)
    first = staged(first.select("query", "vector", "cell", "ring", F.lit(float("inf")).alias("bound")), "first-rings")
    hits = staged(top_n_per_key(_scan(index, first, k, out), ["query"], [F.col("distance"), F.col("key")], k), "first-hits")
    bounds = hits.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
    near = F.sqrt("bound") * (1 + _SLACK) + _SLACK
    rest = (reach.join(bounds, "query").join(rings, "cell").where(gap <= near)
            .join(first.select("query", "cell", "ring"), ["query", "cell", "ring"], "left_anti")
            .select("query", "vector", "cell", "ring", "bound"))
    more = _scan(index, staged(rest, "other-rings"), k, out)
    best = top_n_per_key(hits.drop("rank").unionAll(more), ["query"], [F.col("distance"), F.col("key")], k)
    if metric == "l2":
        best = best.withColumn("distance", F.sqrt("distance"))
    return best.select(*named)
