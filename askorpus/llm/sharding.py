"""K-d tree partitioning into shards of nearly equal bytes.

Documents with equal texts are one point, so copies never end in different shards. A
point's dimensions are metadata (length, smallest id, source, language) and its weight is
the size of all its copies. Every node of a level is split at the same time: along the
dimension that is widest in it, at the weighted median, found exactly by four rounds of
histograms that narrow the median's place from 52 bits to one value. Ties in a dimension
are ordered by the text's hash. Only histograms are shuffled, and nothing but the number of
open nodes reaches the driver.

Points heavier than a whole shard get a shard each before the tree divides the rest.

Defined cases: a null text has no bytes, like an empty one, and both are one group; null
metadata counts as the least value; repeated rows are copies; an empty table has no
shards. Other columns pass through; those named like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, table, with_running_totals

SHARDS = 16
BITS = 20            # of a dimension; the hash that orders ties has 32 more
STEP = 13            # bits of the split's place that one histogram settles
KEY = ["k1", "k2"]

# SQL expressions over a document's columns and __bytes, its size.
DIMENSIONS = {
    "length": "__bytes",
    "id": "doc_id",
    "source": "crc32(cast(source AS binary))",
    "lang": "crc32(cast(lang AS binary))",
}


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _keys() -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    return {"k1": F.xxhash64(text), "k2": F.crc32(text.cast("binary"))}


def points(docs: DataFrame, dimensions: dict[str, str] = DIMENSIONS) -> DataFrame:
    """(k1, k2, weight, a number for each dimension) of each distinct text."""
    rows = docs.withColumns({**_keys(), "__bytes": size_of()})
    found = rows.groupBy(*KEY).agg(
        F.sum("__bytes").alias("weight"),
        *[F.min(F.expr(c).cast("double")).alias(f"d_{name}") for name, c in dimensions.items()])
    return found


def scaled(found: DataFrame, names: list[str]) -> DataFrame:
    """Dimensions as numbers of BITS bits between their least and largest value."""
    bounds = found.agg(*[f(n).alias(f"{m}_{n}") for n in names for m, f in (("lo", F.min), ("hi", F.max))]).first()
    columns = []
    for n in names:
        low, high = bounds[f"lo_{n}"], bounds[f"hi_{n}"]
        wide = low is not None and high > low
        value = F.floor((F.col(n) - low) / (high - low) * ((1 << BITS) - 1)) if wide else F.lit(0)
        columns.append(F.coalesce(value, F.lit(0)).cast("long").alias(n))
    return found.select(*KEY, "weight", *columns)


def _heavy(scratch: Scratch, rows: DataFrame, shards: int):
    """Points that outweigh an even share of what lighter points leave: (rows, their number)."""
    total, count, bound = rows.agg(F.sum("weight")).first()[0] or 0, 0, None
    while shards - count > 1:
        share = total / (shards - count)
        # at most as many points as shards can exceed a share
        over = [r[0] for r in rows.where((F.col("weight") > share) & (
            F.lit(True) if bound is None else F.col("weight") <= bound)).select("weight").collect()]
        if not over:
            break
        over.sort(reverse=True)
        over = over[:shards - count - 1]
        total, count, bound = total - sum(over), count + len(over), min(over) - 1
    if not count:
        return None, 0
    order = Window.orderBy(F.desc("weight"), *KEY)
    top = rows.select(*KEY, "weight").orderBy(F.desc("weight"), *KEY).limit(count)
    return scratch.put(top.select(*KEY, (F.row_number().over(order) - 1).alias("shard")), "heavy"), count


def _split_level(scratch: Scratch, rows: DataFrame, names: list[str], level: int) -> DataFrame:
    """Rows (.., node, first, leaves) with every node of two or more leaves split once."""
    dims = F.array(*[F.col(n) for n in names])
    spread = F.array(*[F.max(n) - F.min(n) for n in names])
    nodes = rows.where("leaves > 1").groupBy("node", "leaves").agg(
        F.sum("weight").alias("total"), spread.alias("spread"))
    nodes = nodes.select(
        "node", F.array_position("spread", F.array_max("spread")).cast("int").alias("dim"),
        (F.col("total") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("target"),
        F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below"))
    nodes = scratch.put(nodes, f"nodes-{level}")
    placed = rows.join(F.broadcast(nodes.select("node", "dim")), "node", "left").withColumn(
        "x", F.element_at(dims, F.coalesce("dim", F.lit(1))) * (1 << 32) + F.pmod("k1", F.lit(1 << 32)))
    # a row for each node: the tree has no more nodes than shards
    for step in range(-(-(BITS + 32) // STEP) - 1, -1, -1):
        width = 1 << (STEP * step)
        near = placed.where("leaves > 1").join(F.broadcast(nodes.select("node", "target", "lo", "below")), "node")
        near = near.where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("lo") + (width << STEP)))
        sums = near.groupBy("node", "target", "lo", "below", F.floor((F.col("x") - F.col("lo")) / width).alias("bin")).agg(
            F.sum("weight").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + F.col("below")
        cum = sums.withColumn("upto", upto).where("upto >= target")
        first = cum.groupBy("node").agg(F.min(F.struct("bin", "w", "upto", "lo", "target")).alias("m"))
        nodes = scratch.put(first.select(
            "node", F.col("m.target").alias("target"), (F.col("m.lo") + F.col("m.bin") * width).alias("lo"),
            (F.col("m.upto") - F.col("m.w")).alias("below"), F.col("m.w").alias("w")), f"nodes-{level}-{step}")
    # the median point goes where it leaves the halves closer to their targets
    cut = nodes.select("node", F.when(
        F.col("below") + F.col("w") - F.col("target") <= F.col("target") - F.col("below"),
        F.col("lo") + 1).otherwise(F.col("lo")).alias("cut"))
    joined = placed.join(F.broadcast(cut), "node", "left")
    half = F.floor(F.col("leaves") / 2)
    right = F.col("x") >= F.col("cut")
    kept = [c for c in rows.columns if c not in ("node", "first", "leaves")]
    done = F.col("cut").isNull()
    return scratch.put(joined.select(
        *kept, F.when(done, F.col("first")).when(right, F.col("first") + half).otherwise(F.col("first")).alias("node"),
        F.when(done | ~right, F.col("first")).otherwise(F.col("first") + half).alias("first"),
        F.when(done, F.col("leaves")).when(right, F.col("leaves") - half).otherwise(half).cast("long").alias("leaves")),
        f"level-{level}")


def assign(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None,
           dimensions: dict[str, str] = DIMENSIONS) -> DataFrame:
    """(k1, k2, shard) of each distinct text. Give ``shards``, or ``target_bytes`` and
    ``shards=None`` to have as many shards as keep to that size."""
    scratch = Scratch(docs.sparkSession, "sharding")
    names = [f"d_{n}" for n in dimensions]
    rows = scaled(scratch.put(points(docs, dimensions), "points"), names)
    if shards is None:
        shards = max(1, math.ceil((rows.agg(F.sum("weight")).first()[0] or 0) / target_bytes))
    heavy, taken = _heavy(scratch, rows, shards)
    if heavy is not None:
        rows = rows.join(F.broadcast(heavy.select(*KEY)), KEY, "left_anti")
    rows = scratch.put(rows.select(
        *KEY, "weight", *names, F.lit(taken).cast("long").alias("node"),
        F.lit(taken).cast("long").alias("first"), F.lit(shards - taken).cast("long").alias("leaves")), "root")
    for level in range(max(0, math.ceil(math.log2(max(1, shards - taken))))):
        rows = _split_level(scratch, rows, names, level)
    placed = rows.select(*KEY, F.col("first").cast("int").alias("shard"))
    return placed if heavy is None else placed.unionByName(heavy.select(*KEY, F.col("shard").cast("int")))


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None,
                    dimensions: dict[str, str] = DIMENSIONS) -> DataFrame:
    """Adds ``shard`` to every row of ``docs``; rows with equal texts share one."""
    names = [c for c in docs.columns if c != "shard"]
    places = assign(docs, shards, target_bytes, dimensions).select(
        *[F.col(k).alias(f"__{k}") for k in KEY], "shard")
    keyed = docs.select(*names).withColumns({f"__{k}": c for k, c in _keys().items()})
    return keyed.join(places, [f"__{k}" for k in KEY]).select(*names, "shard")


def op5_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    places = assign(docs)
    rows = docs.select("doc_id", size_of().alias("size"), *[c.alias(k) for k, c in _keys().items()])
    rows = rows.join(places, KEY).withColumn("spot", F.xxhash64("doc_id", "k1"))
    slots = with_running_totals(rows, ["shard"], F.pmod("spot", F.lit(1024)),
                                [F.pmod("spot", F.lit(1024)), F.col("spot"), F.col("doc_id"), F.col("k2")],
                                {"slot": F.lit(1)})
    return slots.select("doc_id", "size", F.col("k2").alias("text_crc32"), F.lit("bytes").alias("law"),
                        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_kdtree_shards": op5_kdtree_shards}
ORACLES: dict[str, str] = {}
