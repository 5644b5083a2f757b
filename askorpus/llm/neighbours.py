"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample (``SAMPLE`` vectors): a node is cut by the
hyperplane between the centres of two groups that start from two random points. All
vectors are then put into a leaf of every tree. A query walks all trees through one shared
priority queue, ordered by its smallest distance from the hyperplanes on the way, and
takes leaves in that order. How many leaves that is, is measured on the sample: the number
with which ``RECALL`` of the sample's true neighbours are found, so spread-out vectors cost
more leaves and clustered ones few. Candidates in those leaves are ranked by their exact
distance. Every vector is in the index and no leaf is cut short.

Equal vectors are one entry with their smallest ids, as no more of them can be among the
nearest k. Leaves are dealt by (tree, leaf, block of queries, salt); a task holds a block
of queries and reads the leaf's vectors.

Defined cases: rows without an id, and vectors that are null, empty, all zero, or hold null
or non-finite components, take no part, neither do vectors of another length than the most
frequent one; ties go to the smaller id; a repeated row is the same vector; with fewer
candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, table

K = 10
EVERY = 100          # queries are the rows whose id this divides
SAMPLE = 20_000
TREES = 20
LEAF = 64            # sample vectors in a leaf
PROBES = 200         # sample queries that measure the number of leaves
RECALL = 0.98
SEED = 11
QUERIES_HELD = 2048
VECTORS_A_TASK = 1 << 16


class Tree:
    """Hyperplanes of one tree as arrays; a child below 0 is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, leaf: int, draw: np.random.Generator):
        self.normals, self.offsets, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(sample, np.arange(len(sample)), leaf, draw)
        self.normals = np.array(self.normals).reshape(-1, sample.shape[1])
        self.offsets = np.array(self.offsets)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, sample, rows, leaf, draw) -> int:
        normal = self._normal(sample[rows], draw) if len(rows) > leaf else None
        if normal is None:
            self.leaves += 1
            return -self.leaves
        heights = sample[rows] @ normal[0]
        below = heights <= normal[1]
        if not 0.1 <= below.mean() <= 0.9:
            normal = (normal[0], float(np.median(heights)))
            below = heights <= normal[1]
            if below.all():
                self.leaves += 1
                return -self.leaves
        at = len(self.offsets)
        self.normals.append(normal[0])
        self.offsets.append(normal[1])
        self.children.append([0, 0])
        left = self._grow(sample, rows[below], leaf, draw)
        right = self._grow(sample, rows[~below], leaf, draw)
        self.children[at] = [left, right]
        return at

    @staticmethod
    def _normal(points, draw):
        some = points if len(points) <= 1000 else points[draw.choice(len(points), 1000, replace=False)]
        a, b = some[draw.choice(len(some), 2, replace=False)]
        for _ in range(8):
            if not np.any(a != b):
                return None
            side = some @ (a - b) <= (a + b) @ (a - b) / 2
            if side.all() or not side.any():
                break
            a, b = some[~side].mean(axis=0), some[side].mean(axis=0)
        width = np.linalg.norm(a - b)
        return ((a - b) / width, float((a + b) @ (a - b) / 2 / width)) if width > 0 else None

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root, np.int64)
        while True:
            inside = np.flatnonzero(at >= 0)
            if not len(inside):
                return -at - 1
            node = at[inside]
            right = np.einsum("ij,ij->i", points[inside], self.normals[node]) > self.offsets[node]
            at[inside] = self.children[node, right.astype(np.int64)]


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.trees = [Tree(sample, leaf, draw) for _ in range(trees)]
        self.visits = sum(t.leaves for t in self.trees)

    def leaves_near(self, point: np.ndarray, most: int):
        """(tree, leaf) in the order of the shared queue."""
        heights = [t.normals @ point - t.offsets for t in self.trees]
        queue = [(-np.inf, k, t.root) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        out = []
        while queue and len(out) < most:
            far, k, at = heapq.heappop(queue)
            if at < 0:
                out.append((k, -at - 1))
                continue
            height = heights[k][at]
            left, right = self.trees[k].children[at]
            heapq.heappush(queue, (max(far, height), k, int(left)))
            heapq.heappush(queue, (max(far, -height), k, int(right)))
        return out

    def measure(self, sample: np.ndarray, k: int, probes: int, recall: float) -> None:
        """Sets ``visits`` to the leaves with which ``recall`` of the true neighbours are found."""
        if len(sample) <= k + 1:
            return
        chosen = np.random.default_rng(SEED).choice(len(sample), min(probes, len(sample)), replace=False)
        homes = np.stack([t.leaf_of(sample) for t in self.trees], axis=1)
        needed = []
        for q in chosen:
            far = ((sample - sample[q]) ** 2).sum(axis=1)
            far[q] = np.inf
            place = {v: n + 1 for n, v in enumerate(self.leaves_near(sample[q], self.visits))}
            for x in np.argpartition(far, k)[:k]:
                needed.append(min(place[t, int(leaf)] for t, leaf in enumerate(homes[x])))
        self.visits = int(np.quantile(needed, recall, method="higher"))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    most = lengths.first()
    return rows.where(F.size("v") == (most[0] if most else 0))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _to_leaves(batches, forest, queries: bool):
    """A row for every tree and leaf a vector is in, or that a query reads."""
    for batch in batches:
        ids, points = batch.column("id").to_numpy(), _matrix(batch.column("v"))
        if not len(ids):
            continue
        if queries:
            near = [forest.value.leaves_near(p, forest.value.visits) for p in points]
            rows = np.repeat(np.arange(len(ids)), [len(n) for n in near])
            tree, leaf = np.array([v for n in near for v in n]).reshape(-1, 2).T
        else:
            homes = np.stack([t.leaf_of(points) for t in forest.value.trees], axis=1)
            rows = np.repeat(np.arange(len(ids)), homes.shape[1])
            tree, leaf = np.tile(np.arange(homes.shape[1]), len(ids)), homes.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(ids[rows]),
             batch.column("v").take(pa.array(rows))], names=["tree", "leaf", "id", "v"])


def _rank(batches, k: int):
    """The nearest k of each leaf part for each query held; queries come first in a part."""
    at, ids, points, best = None, [], None, []

    def nearest():
        out = []
        for q, found in zip(ids, best):
            out += [(q, x, d) for d, x in heapq.nsmallest(k, found)]
        return out

    def batch_of(rows):
        q, x, d = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(d, pa.float64())], names=["q", "x", "d"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("tree", "leaf", "block", "salt")], axis=1)
        role, own, rows = batch.column("role").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("v"))
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), n]
        done = []
        for lo, hi in zip(edges, edges[1:]):
            part = tuple(keys[lo])
            if part != at:
                done += nearest()
                at, ids, points, best = part, [], [], []
            split = lo + int(np.searchsorted(role[lo:hi], 1))
            ids += own[lo:split].tolist()
            points += list(rows[lo:split])
            best += [[] for _ in range(split - lo)]
            if split == hi:
                continue
            for j, p in enumerate(points):
                far = np.sqrt(((rows[split:hi] - p) ** 2).sum(axis=1))
                bound = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
                if len(best[j]) >= k:
                    bound = min(bound, max(best[j])[0])
                near = np.flatnonzero(far <= bound)
                best[j] = heapq.nsmallest(k, best[j] + list(zip(far[near].tolist(), own[split:hi][near].tolist())))
        yield batch_of(done)
    yield batch_of(nearest())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, trees: int = TREES,
            leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the nearest rows of ``vectors`` other
    than the row of its own id. Both have (vec_id, embedding); queries are rows of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    key = {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}
    rows = scratch.put(usable(vectors).withColumns(key), "rows")
    order = Window.partitionBy("k1", "k2").orderBy("vec_id")
    # as many ids of equal vectors as can matter: k, and the query's own
    kept = rows.dropDuplicates(["k1", "k2", "vec_id"]).withColumn(
        "n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    entries = scratch.put(kept.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("id"), F.min_by("v", "vec_id").alias("v"),
        F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the sample is bounded and only fits the trees; every entry is indexed below
    share = max(1, -(-total // sample))
    fitted = np.array([r[0] for r in entries.where(
        F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(share)) == 0).select("v").limit(2 * sample).collect()])
    if not len(fitted):
        fitted = np.array([r[0] for r in entries.select("v").limit(sample).collect()])
    forest = Forest(fitted, trees, leaf)
    forest.measure(fitted, k, PROBES, recall)
    sent = spark.sparkContext.broadcast(forest)

    asked = usable(queries).withColumns(key).select("vec_id", *key).distinct()
    asked = scratch.put(asked.join(entries.select("k1", "k2", "id"), ["k1", "k2"]).select(
        F.col("vec_id").alias("query_id"), F.col("id").alias("q")), "asked")
    points = entries.join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi").select("id", "v")
    schema = "tree int, leaf int, id long, v array<double>"
    visits = points.mapInArrow(partial(_to_leaves, forest=sent, queries=True), schema)
    visits = scratch.put(visits, "visits")
    index = scratch.put(entries.select("id", "v").mapInArrow(
        partial(_to_leaves, forest=sent, queries=False), schema), "index")
    leaf_key, place = ["tree", "leaf"], F.xxhash64("id")
    sizes = visits.groupBy(*leaf_key).agg(F.ceil(F.count(F.lit(1)) / QUERIES_HELD).cast("int").alias("blocks")).join(
        index.groupBy(*leaf_key).agg(F.ceil(F.count(F.lit(1)) / VECTORS_A_TASK).cast("int").alias("salts")), leaf_key)
    sizes = scratch.put(sizes, "sizes")
    part = [*leaf_key, "block", "salt"]
    held = visits.join(sizes, leaf_key).withColumns(
        {"block": F.pmod(place, F.col("blocks")).cast("int"), "role": F.lit(0)}).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    read = index.join(sizes, leaf_key).withColumns(
        {"salt": F.pmod(place, F.col("salts")).cast("int"), "role": F.lit(1)}).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [*part, "role", "id", "v"]
    dealt = held.select(*columns).unionByName(read.select(*columns)).repartition(*part).sortWithinPartitions(*part, "role")
    ranked = dealt.mapInArrow(partial(_rank, k=k + 1), "q long, x long, d double").groupBy("q", "x").agg(
        F.min("d").alias("d"))
    best = Window.partitionBy("q").orderBy("d", "x")
    top = ranked.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    items = top.join(entries.select(F.col("id").alias("x"), "ids"), "x").select(
        "q", "d", F.explode("ids").alias("vec_id"))
    items = items.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(
        F.col("n") <= k + 1)
    pairs = asked.join(items.select("q", "d", "vec_id"), "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", F.col("d").alias("score"))


def op2_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op2_forest_neighbours": op2_forest_neighbours}
ORACLES: dict[str, str] = {}
