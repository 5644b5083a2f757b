"""Exact ranked search with posting lists in geometric blocks.

Documents are cut into shards of bounded size. Within a shard the posting list of a term is
clustered: each document goes to the pivot whose vector is most like its own (random
projections of the weighted vectors), and clusters are cut into small blocks. A block
stores the largest impact that any of its documents has for each term, a vector above all of
theirs. A query adds up its weights over that vector; if even this sum is below what the
query's ``top``-th best document is known to reach, the block is skipped, and else its
documents are scored in full. So a document is never lost: only exact bounds decide.

Two more exact bounds save lists. Scores of the documents that hold a query's rarest terms give a
first floor for its ``top``-th best score over all shards. And frequent terms whose largest
contributions together stay below the floor need no lists: a document that holds no other term
of the query can not reach it. Blocks are built for the lists that some query opens, and
keep the coordinates that such queries ask for.

Steps: read texts once, keeping each document's query terms; sum statistics; floors; index and
search shard by shard, where the lists stay in the memory of the task that needs them.
Queries are taken in batches of bounded size, each with a pass of its own; only the best of each
query are shuffled.

Weights and impacts: w = floor(1000 ln((2N+2)/(2df+1))), impact = 10^9 tf div (1000 tf + 20 m),
m = 50 + (50 n N div L); the score of a document is the sum of w * impact over the query's
distinct terms.

Defined cases: a null or empty text has no terms and is not found; a query without terms gives no
rows; repeated documents and queries are ranked as often as they occur; equal scores go to
the smaller doc_id, a null one last; scores of 0 are left out; empty tables give no rows.
Columns other than doc_id, item_id and text are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askorpus.llm.decontaminate import words_of
from askorpus.llm.shared import Scratch, slices, table

TOP = 50
# Documents of a block; documents and postings of a shard.
BLOCK = 16
SHARD, POSTINGS = 4096, 1 << 20
# Bytes of text whose words a task holds at a time, where a text is not longer by itself.
TEXT = 2 << 20
# Term occurrences of the queries that are searched in one pass.
QUERY_TERMS = 1 << 17
# A floor looks at a query's rarest terms until they have so many postings for each result.
PROBED = 20
# Numbers by which vectors are compared when blocks are formed.
SKETCH = 32
LAST = np.iinfo(np.int64).max


@dataclass
class Queries:
    """A batch of queries; ``terms`` holds distinct term ids, ``ids`` the ids as given."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    ids: list
    weight: np.ndarray | None = None
    floor: np.ndarray | None = None
    opened: list[np.ndarray] | None = None

    @classmethod
    def read(cls, rows) -> "Queries":
        vocabulary: dict[bytes, int] = {}
        terms = [np.array(sorted({vocabulary.setdefault(w, len(vocabulary)) for w in words}), np.int64) for _, words in rows]
        return cls(vocabulary, terms, [i for i, _ in rows])

    def weights_of(self, query: int) -> np.ndarray:
        """Weight of every term, 0 for those not in the query."""
        own = np.zeros(len(self.vocabulary), np.int64)
        own[self.terms[query]] = self.weight[self.terms[query]]
        return own

    def probed(self, frequency: np.ndarray, top: int) -> list[np.ndarray]:
        """The rarest terms of each query."""
        out = []
        for own in self.terms:
            order = own[np.argsort(frequency[own], kind="stable")]
            many = int(np.searchsorted(np.cumsum(frequency[order]), PROBED * top)) + 1
            out.append(order[:many])
        return out

    def open_lists(self, largest: np.ndarray) -> None:
        """Leaves closed the terms of least contribution that together stay below the floor."""
        self.opened = []
        for own, floor in zip(self.terms, self.floor.tolist()):
            most = self.weight[own] * largest[own]
            order = np.argsort(most, kind="stable")
            closed = int(np.searchsorted(np.cumsum(most[order]), floor))
            self.opened.append(own[order[closed:]][::-1])


    def coordinates(self) -> dict[int, np.ndarray]:
        """Terms of the queries that open each list."""
        lists = np.concatenate([*(np.repeat(o, len(t)) for o, t in zip(self.opened, self.terms)), np.zeros(0, np.int64)])
        asked = np.concatenate([*(np.tile(t, len(o)) for o, t in zip(self.opened, self.terms)), np.zeros(0, np.int64)])
        size = max(1, len(self.vocabulary))
        keys = np.unique(lists * size + asked)
        found, starts = np.unique(keys // size, return_index=True)
        return dict(zip(found.tolist(), np.split(keys % size, starts[1:])))


def forward(docs: DataFrame, queries) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term: all its terms counted, query terms kept."""
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"

    def run(batches):
        vocabulary = queries.value.vocabulary
        size = max(1, len(vocabulary))
        for batch in batches:
            for part in slices(batch, 1, size=TEXT):
                words = [words_of(t) for t in part.column(1).to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                ids = np.fromiter(map(vocabulary.get, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
                keys, tfs = np.unique((np.repeat(np.arange(len(n)), n) * size + ids)[ids >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * size), pa.int32())
                there = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(keys % size, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))],
                    names=["doc_id", "n", "terms", "tfs"]).filter(there)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def frequencies(rows: DataFrame) -> DataFrame:
    """(term, df), summed."""
    def run(batches):
        met = np.zeros(0, np.int64)
        for batch in batches:
            counts = np.bincount(batch.column(0).flatten().to_numpy())
            met = np.pad(met, (0, max(0, len(counts) - len(met))))
            met[:len(counts)] += counts
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(met[at])], names=["term", "df"])

    return rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Shard:
    """Documents of a shard: ``ends`` bounds each one's terms and impacts."""

    ids: pa.Array
    ends: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms of ``rows`` lie, row after row, and where each row begins there."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(self.ends[rows] - starts, sizes) + np.arange(int(sizes.sum())), starts

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of rows that have terms."""
        at, starts = self.entries(rows)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], starts) if len(rows) else np.zeros(0, np.int64)

    def lists(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all posting lists, and where each term's list begins."""
        order = np.argsort(self.terms, kind="stable")
        owner = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        return owner[order], np.searchsorted(self.terms[order], np.arange(size + 1))

    def sketch(self, weights: np.ndarray, size: int) -> np.ndarray:
        """Random projection of each document's weighted vector, of length 1."""
        signs = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (size, SKETCH))
        value = (weights[self.terms] * self.impacts).astype(np.float32)[:, None]
        out = np.zeros((len(self.ends) - 1, SKETCH), np.float32)
        for a in range(0, len(out), 512):
            rows = np.arange(a, min(a + 512, len(out)))
            rows = rows[self.ends[rows + 1] > self.ends[rows]]
            at, starts = self.entries(rows)
            if len(at):
                out[rows] = np.add.reduceat(signs[self.terms[at]] * value[at], starts, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def shards(batches, stats):
    """Shards of (doc_id, n, terms, tfs) rows with a query term, with impacts from the totals."""
    many, words = stats
    held, size = [], 0

    def made():
        rows = pa.Table.from_batches(held).combine_chunks()
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        ends = column["terms"].offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        tfs = column["tfs"].flatten().to_numpy().astype(np.int64)
        # n * N may pass 64 bits
        m = np.array([50 + 50 * n * many // words for n in column["n"].to_pylist()], np.int64)
        impacts = 10**9 * tfs // (1000 * tfs + 20 * np.repeat(m, np.diff(ends)))
        return Shard(column["doc_id"], ends, column["terms"].flatten().to_numpy().astype(np.int64), impacts)

    for batch in batches:
        batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("terms")), 0))
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            held.append(part)
            size += len(part.column("terms").flatten())
            if sum(b.num_rows for b in held) >= SHARD or size >= POSTINGS:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def best(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by id."""
    return np.lexsort((ids, -scores))[:top]


def floors(rows: DataFrame, queries, probed, stats, top: int) -> DataFrame:
    """(kind, key, value): the best scores of each query among the documents with its rarest terms
    (kind 0, by task), and the largest impact of each term (kind 1)."""
    def run(batches):
        own, lists = queries.value, probed.value
        size = len(own.vocabulary)
        found: dict[int, np.ndarray] = {}
        largest = np.zeros(size, np.int64)
        for shard in shards(batches, stats):
            np.maximum.at(largest, shard.terms, shard.impacts)
            rows, starts = shard.lists(size)
            for q, terms in enumerate(lists):
                parts = [rows[starts[t]:starts[t + 1]] for t in terms.tolist()]
                near = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                if len(near):
                    scores = np.append(found.get(q, np.zeros(0, np.int64)), shard.scores(near, own.weights_of(q)))
                    found[q] = -np.sort(-scores)[:top]
        keys = np.repeat(np.array(list(found), np.int32), [len(s) for s in found.values()])
        values = np.concatenate([*found.values(), np.zeros(0, np.int64)])
        at = np.flatnonzero(largest)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], [len(keys), len(at)]), pa.int32()), pa.array(np.append(keys, at), pa.int32()),
             pa.array(np.append(values, largest[at]), pa.int64())], names=["kind", "key", "value"])

    return rows.mapInArrow(run, "kind int, key int, value long")


def blocks_of(rows: np.ndarray, sketch: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """A posting list ordered by block, and where its blocks begin."""
    if len(rows) <= size:
        return rows, np.zeros(1, np.int64)
    pivots = rows[::size]
    near = np.argmax(sketch[rows] @ sketch[pivots].T, axis=1)
    order = np.argsort(near, kind="stable")
    near = near[order]
    fresh = np.append(True, near[1:] != near[:-1])
    begun = np.flatnonzero(fresh)
    place = np.arange(len(near)) - begun[np.cumsum(fresh) - 1]
    return rows[order], np.flatnonzero(place % size == 0)


class Index:
    """Blocks of one shard: the lists (terms) that queries open, the rows of each block and the
    largest impacts in it. ``met`` and ``read`` count blocks whose bound was asked for, and
    those that had to be read."""

    def __init__(self, shard: Shard, weight: np.ndarray, wanted: dict[int, np.ndarray]):
        self.shard = shard
        self.order = pa.compute.fill_null(shard.ids, LAST).to_numpy()
        self.met = self.read = 0
        size = len(weight)
        postings, starts = shard.lists(size)
        sketch = shard.sketch(weight, size)
        inside = np.zeros(size, bool)
        self.list_of: dict[int, int] = {}
        first, ordered, block_rows, block_maxima, terms, maxima = [], [], [], [], [], []
        blocks = placed = held = 0
        for t, coordinates in wanted.items():
            rows = postings[starts[t]:starts[t + 1]]
            if not len(rows):
                continue
            rows, begins = blocks_of(rows, sketch)
            inside[coordinates] = True
            at, _ = shard.entries(rows)
            block = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
            block = np.repeat(block, shard.ends[rows + 1] - shard.ends[rows])
            good = inside[shard.terms[at]]
            inside[coordinates] = False
            keys = block[good] * size + shard.terms[at[good]]
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], shard.impacts[at[good]][order]
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, values = keys[heads], np.maximum.reduceat(values, heads)
            self.list_of[t] = len(first)
            first.append(blocks)
            ordered.append(rows.astype(np.int32))
            block_rows.append(begins + placed)
            block_maxima.append(np.searchsorted(keys, np.arange(len(begins)) * size) + held)
            terms.append((keys % size).astype(np.int32))
            maxima.append(values.astype(np.int32))
            blocks, placed, held = blocks + len(begins), placed + len(rows), held + len(keys)
        self.blocks = np.array([*first, blocks])
        self.rows, self.max_terms, self.maxima = (
            np.concatenate([*c, np.zeros(0, np.int32)]) for c in (ordered, terms, maxima))
        self.block_rows = np.concatenate([*block_rows, [placed]])
        self.block_maxima = np.concatenate([*block_maxima, [held]])

    def bounds(self, number: int, weights: np.ndarray) -> tuple[int, np.ndarray]:
        """First block of a list, and an upper bound for each of its blocks."""
        a, b = self.blocks[number], self.blocks[number + 1]
        low, high = self.block_maxima[a], self.block_maxima[b]
        return a, np.add.reduceat(weights[self.max_terms[low:high]] * self.maxima[low:high],
                                  self.block_maxima[a:b] - low)

    def top(self, weights: np.ndarray, opened: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best documents that reach ``floor``."""
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(len(self.shard.ends) - 1, bool)
        for t in opened.tolist():
            if t not in self.list_of:
                continue
            a, bounds = self.bounds(self.list_of[t], weights)
            left = a + np.flatnonzero(bounds >= floor)
            self.met, self.read = self.met + len(bounds), self.read + len(left)
            begins, ends = self.block_rows[left], self.block_rows[left + 1]
            near = self.rows[np.repeat(begins - np.cumsum(ends - begins) + (ends - begins), ends - begins)
                             + np.arange(int((ends - begins).sum()))]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            found = self.shard.scores(near, weights)
            good = found >= floor
            rows, scores = np.append(rows, near[good]), np.append(scores, found[good])
            if len(rows) >= top:
                kept = best(self.order[rows], scores, top)
                rows, scores = rows[kept], scores[kept]
                floor = max(floor, int(scores[-1]))
        return rows, scores


def search_shards(rows: DataFrame, queries, stats, top: int) -> DataFrame:
    """(query, doc_id, score): the best of every query in each shard, which is indexed and searched
    by the same task."""
    def run(batches):
        own = queries.value
        wanted = own.coordinates()
        for shard in shards(batches, stats):
            index = Index(shard, own.weight, wanted)
            numbers, ids, scores = [], [], []
            for q, opened in enumerate(own.opened):
                if len(opened):
                    near, found = index.top(own.weights_of(q), opened, int(own.floor[q]), top)
                    numbers += [q] * len(near)
                    ids.append(shard.ids.take(pa.array(near)))
                    scores.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.concat_arrays([*ids, pa.array([], pa.int64())]),
                 pa.array(np.concatenate([*scores, np.zeros(0, np.int64)]))], names=["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query int, doc_id long, score long")


def _batches(items: DataFrame, limit: int):
    """Lists of (item_id, terms) with at most ``limit`` terms, unless one query has more."""
    held, size = [], 0
    for row in items.toLocalIterator():
        words = set(words_of(row["text"]))
        if not words:
            continue
        if held and size + len(words) > limit:
            yield held
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    if held:
        yield held


def _search_batch(docs: DataFrame, batch, scratch: Scratch, name: str, top: int) -> DataFrame | None:
    spark = docs.sparkSession
    own = Queries.read(batch)
    rows = scratch.put(forward(docs, spark.sparkContext.broadcast(own)), f"{name}_forward")
    many, words = rows.agg(F.count("*"), F.sum("n")).first()
    if not many:
        return None
    frequency = np.zeros(len(own.vocabulary), np.int64)
    for r in frequencies(rows).toLocalIterator():
        frequency[r["term"]] = r["df"]
    own.weight = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)
    first = spark.sparkContext.broadcast(own)
    probes = spark.sparkContext.broadcast(own.probed(frequency, top))
    seen = scratch.put(floors(rows, first, probes, (many, words), top), f"{name}_floors")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("value")))
    own.floor = np.ones(len(own.ids), np.int64)
    for r in seen.where("kind = 0").withColumn("place", place).where(F.col("place") <= top).where(
            F.col("place") == top).toLocalIterator():
        own.floor[r["key"]] = max(1, r["value"])
    largest = np.zeros(len(own.vocabulary), np.int64)
    for r in seen.where("kind = 1").groupBy("key").agg(F.max("value").alias("value")).toLocalIterator():
        largest[r["key"]] = r["value"]
    own.open_lists(largest)
    shared = spark.sparkContext.broadcast(own)
    found = scratch.put(search_shards(rows, shared, (many, words), top), f"{name}_found")
    scratch.drop(f"{name}_forward", f"{name}_floors")
    names = spark.createDataFrame(list(enumerate(own.ids)), "query int, item_id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The ``top`` documents (doc_id, text) of every item (item_id, text): item_id, rank, doc_id, score."""
    scratch = Scratch(docs.sparkSession, "ranking")
    found = []
    # one pass for each batch of queries; a batch is bounded, their number grows with the items
    for k, batch in enumerate(_batches(items.select(F.col("item_id").cast("long"), "text"), query_terms)):
        ranked = _search_batch(docs, batch, scratch, f"batch{k}", top)
        if ranked is not None:
            found.append(ranked)
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () r, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
q AS (SELECT item_id, row_number() OVER () q, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
qt AS (SELECT DISTINCT item_id, q, unnest(w) t FROM q),
total AS (SELECT count(*) n, sum(len(w)) l FROM d WHERE len(w) > 0),
size AS (SELECT r, doc_id, len(w) n, 100 - 50 + (50 * len(w) * (SELECT n FROM total)) // (SELECT l FROM total) m FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) tf FROM (SELECT r, unnest(w) t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT n FROM total) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) w
       FROM p GROUP BY t),
scored AS (SELECT q, item_id, p.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) score
           FROM qt JOIN p USING (t) JOIN df USING (t) JOIN size ON size.r = p.r GROUP BY q, item_id, p.r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": SQL}
