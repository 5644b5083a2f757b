"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order (null last) have the weights 1, 2, 3, repeating, and share all
words; a source is asked for at most ``MOST`` times its words and what exceeds that is shared
again. Words are handed out in blocks of ``BLOCK``: the next block goes to the source with
the highest quotient target / (2 blocks + 1), ties to the earlier source. The same rule
gives a source's blocks to its shards by their words. A shard of a source is a stream of
its documents in an order drawn from ``SEED``; its quota takes the stream as often as it
fits in whole and then the blocks from its start.

Only one row for each source and shard reaches the driver: sums, at most ``MOST_SOURCES``
sources. Documents are never gathered.

Defined cases: more sources than that are an error before anything is sent; a document
without words has size 0 and is taken 0 times; repeated rows are documents of their own;
null ids are ordered by text; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, apart, table, together, tokens_of, with_running_totals

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 64
SHARDS = 16
SEED = "mix-1"
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Words asked of each source: shares by weight, none above ``most`` times its size."""
    left, open_ids, out = sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_ids:
        total = sum(weights[i] for i in open_ids)
        over = [i for i in open_ids if weights[i] * left > most * sizes[i] * total]
        if not over:
            for i in open_ids:
                out[i] = weights[i] * left / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)
        open_ids = [i for i in open_ids if i not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int, capacity: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), ties to the earlier; none beyond its capacity.

    Seats whose quotient is surely high enough are handed out at once, by a divisor that
    leaves a few over; those go one by one.
    """
    def at(divisor):
        return [min(c, int(v / divisor + 0.5)) if v > 0 else 0 for v, c in zip(votes, capacity)]

    given = [0] * len(votes)
    low, high = 0.0, 2.0 * sum(votes) + 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        some = at(middle)
        if sum(some) <= seats:
            given, high = some, middle
        else:
            low = middle
    # one step back where rounding may have favoured a later source
    given = [max(0, g - 1) for g in given]
    queue = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, given, capacity)) if g < c and v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < capacity[i]:
            heapq.heappush(queue, (-votes[i] / (2 * given[i] + 1), i))
    return given


def quotas(streams: list[tuple], block: int = BLOCK, most: int = MOST, weights=WEIGHTS) -> list[tuple]:
    """(source, shard, source_size, target, words) for each (source, shard, size)."""
    names = sorted({s for s, _, _ in streams}, key=lambda s: (s is None, s or ""))
    by: dict = {n: [] for n in names}
    for s, j, w in sorted(streams, key=lambda r: r[1]):
        by[s].append((j, w))
    sizes = [sum(w for _, w in by[n]) for n in names]
    asked = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], most)
    room = [[-(-most * w // block) for _, w in by[n]] for n in names]
    blocks = sainte_lague(asked, round(sum(asked) / block), [sum(r) for r in room])
    out = []
    for n, size, target, mine, seats in zip(names, sizes, asked, room, blocks):
        given = [min(q * block, most * w) for (_, w), q in zip(by[n], sainte_lague([float(w) for _, w in by[n]], seats, mine))]
        # what blocks are too coarse for goes word by word to shards that still have room
        short = int(target) - sum(given)
        for k, (j, w) in enumerate(by[n]):
            more = min(max(0, short), most * w - given[k])
            short -= more
            out.append((n, j, size, target, given[k] + more))
    return out


def _order() -> Column:
    """A document's place in its stream, as hexadecimal digits drawn from the seed."""
    return F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"),
                             F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.substring("place", 25, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def streams_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, size, place, shard)."""
    return docs.select("doc_id", "source", tokens_of(F.col("text")).alias("size"),
                       _order().alias("place")).withColumn("shard", _shard(shards))


def plan_mix(scratch: Scratch, docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: int = MOST):
    """(documents with before, source_size, target, whole, rest, taken; quotas): whole is how
    often the stream is taken, rest how many words from its start are taken once more."""
    spark = docs.sparkSession
    rows = scratch.put(streams_of(docs, shards), "rows")
    sums = scratch.put(rows.groupBy("source", "shard").agg(F.sum("size").alias("size")), "sums")
    if sums.count() > MOST_SOURCES * shards:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix groups of them instead")
    sums = sums.collect()
    words = {(r[0], r[1]): r[2] for r in sums}
    plan = [(s, j, size, target, *divmod(w, max(1, words[s, j])))
            for s, j, size, target, w in quotas([tuple(r) for r in sums], block, most)]
    plan = spark.createDataFrame(plan, "source string, shard int, source_size long, target double, whole long, rest long")
    placed = with_running_totals(rows, ["source", "shard"], F.substring("place", 1, 2), [F.col("place"), F.col("size")],
                                 {"before": F.col("size")}).alias("d")
    # the plan has a row for each source and shard
    joined = placed.join(F.broadcast(plan).alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))
                         & (F.col("d.shard") == F.col("q.shard")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return joined.select("d.*", "source_size", "target", "whole", "rest", extra.cast("long").alias("extra"),
                         (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: int = MOST) -> DataFrame:
    """The mix itself: each document as many times as it is taken. Documents stay whole; the
    one at the end of a stream's quota counts if at least half of it is inside."""
    scratch = Scratch(docs.sparkSession, "mixing")
    planned = scratch.put(plan_mix(scratch, docs, block, shards, most), "planned")
    # where each stream's quota ends: a row for each source and shard
    ends = planned.groupBy("source", "shard").agg(
        F.first("whole").alias("whole"),
        F.max(F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), F.col("place"))).alias("end"))
    uses = ["doc_id", "text", "source"]
    rows = apart(docs, uses).withColumn("place", _order()).withColumn("__shard", _shard(shards)).alias("d")
    joined = rows.join(F.broadcast(ends).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source"))
                       & (F.col("d.__shard") == F.col("e.shard")))
    times = F.col("e.whole") + F.when(F.col("place") <= F.col("end"), 1).otherwise(0)
    copies = joined.where(times > 0).select("d.*", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("__copy"))
    return together(copies, docs, uses)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_mix(Scratch(spark, "mixing"), docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_source_mix": op3_source_mix}
ORACLES: dict[str, str] = {}
