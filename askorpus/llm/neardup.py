r"""Near-duplicates by circulant MinHash, banding and exact confirmation.

Two permutations of 32-bit numbers give the whole signature: the first scatters a
document's shingles, the second is shifted circularly by k for coordinate k, and each
coordinate is the minimum (C-MinHash). Bands of coordinates give buckets.

Within a bucket not all pairs are confirmed, and none that could join two components is
left out. A first round over a few bands compares every member with one pivot of its
bucket. From then on only buckets of several components are open, and only members
outside a bucket's largest component are pivots: each first tries those of another
component that its signature agrees with most, then a few more, and in the last round all.
Links become components after every round. Signatures are compared inside tasks that hold
the pivots and read the members, so pairs only exist as rows where they are worth
confirming, and each in one band only. Every link is confirmed on the full sets.

Equal sets are collapsed to one representative before anything else, so groups of exact
copies never meet in a bucket. A distinct set has a number of its own, so it does not matter
which doc_id its rows have; numbers become doc_ids at the end.

With ``BANDS`` bands of ``ROWS`` coordinates a pair with a similarity of 0.75 meets in no
bucket with probability 2e-5, one of 0.8 with 1e-7. Documents that meet get a longer
signature of the same kind; a pair is worth confirming if at most ``MARGIN`` fewer of its
coordinates agree than the similarity, 4.5 standard deviations.

Defined cases: documents without words (null or empty texts) and documents without a
doc_id are linked with nothing and kept; component_id is the doc_id itself. Rows with the
same doc_id and the same set are copies of one document; rows with the same doc_id and
different sets are documents of their own, and where such are near each other, the smaller
set number is kept. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, table, with_columns_by_arrow
from askorpus.operators.membership import marked

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 5
# Coordinates of the longer signature of documents that meet in buckets, and how far below
# the similarity their share of agreeing coordinates may be: 4.5 deviations.
COORDINATES = 1000
MARGIN = 0.062
# (bands, or None for all; one pivot a bucket; pairs for each pivot of a bucket, or None for all)
ROUNDS = ((4, True, None), (None, False, 1), (None, False, 8), (None, False, None))
PIVOTS_HELD, MEMBERS_A_TASK = 2048, 1 << 16
SALTS = 16

LOWER = bytes(i + 0x20 if 0x41 <= i <= 0x5A else i for i in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, mixed with its length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    place = (np.arange(len(data)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
    terms = mix64((place << np.uint64(9)) + data)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
    return mix64((total[ends] - total[ends - sizes]) ^ (sizes.astype(np.uint64) * _ODD))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; the whole text is one if it is shorter."""
    own = text.encode("utf-8").translate(LOWER).split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    hashed = word_hashes(own)
    n = min(words, len(own))
    mixed = np.zeros(len(own) - n + 1, np.uint64)
    for k in range(n):
        mixed = mix64(mixed * _ODD + hashed[k:len(own) - n + 1 + k])
    return np.unique(mixed + np.uint64(n))


def _permute32(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, in place: xor-shifts and odd factors are bijections."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least value of the second permutation,
    shifted by k, over the shingles scattered by the first."""
    scattered = (mix64(shingles ^ _ODD) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    block = 512
    values = np.empty((min(block, len(scattered)), coordinates), np.uint32)
    spare = np.empty_like(values)
    for at in range(0, len(scattered), block):
        part = scattered[at:at + block]
        own = np.subtract(part[:, None], shifts, out=values[:len(part)])
        np.minimum(least, _permute32(own, spare[:len(part)]).min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * _ODD
    for column in sig.reshape(bands, -1).T:
        key = mix64(key * _MIX + column)
    return key.view(np.int64)


def _signer(words: int, bands: int, rows: int):
    def sign(texts):
        out = []
        for text in texts.to_pylist():
            own = shingle_set(text, words)
            if not len(own):
                out.append((0, None, None, []))
                continue
            sig = signature(own, bands * rows)
            out.append((len(own), int(own.sum().view(np.int64)), int(mix64(own ^ _MIX).sum().view(np.int64)),
                        band_keys(sig, bands)))
        return list(zip(*out)) if out else [[]] * 4

    return sign


SIGNED = "n_shingles long, set1 long, set2 long, bands array<long>"


def _similar(batches, percent: int):
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        a, b, left, right = batch.columns
        keep = []
        for x, y in zip(left, right):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _met(batches, least: float, best: int | None):
    """Pairs (pivot, member) of a bucket worth confirming: of different components, agreeing
    in ``least`` of the coordinates, and met in no earlier band. With ``best``, only so
    many for each pivot, those that agree most.

    Rows come by bucket part, its pivots first, so only those are held.
    """
    at, held, found = None, [], []

    def chosen():
        if best is None or not found:
            return [(p, x) for p, _, x in found]
        out, before, n = [], None, 0
        for p, _, x in sorted(found):
            n = n + 1 if p == before else 1
            before = p
            if n <= best:
                out.append((p, x))
        return out

    for batch in batches:
        key, block, salt, role, ids, comp, out = (
            batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "block", "salt", "role", "id", "comp", "out"))
        bands = batch.column("bands").flatten().to_numpy().reshape(len(ids), -1)
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        change = (np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(salt) != 0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
        done = []
        for lo, hi in zip(edges, edges[1:]):
            part = (key[lo], block[lo], salt[lo])
            if part != at:
                done += chosen()
                at, held, found = part, [], []
            split = lo + int(np.searchsorted(role[lo:hi], 1))
            for k in range(lo, split):
                held.append((int(ids[k]), comp[k], bands[k], sigs[k], int(np.flatnonzero(bands[k] == key[k])[0])))
            if split == hi:
                continue
            own, own_comp, own_bands, own_sigs, own_out = (
                v[split:hi] for v in (ids, comp, bands, sigs, out))
            for p, c, p_bands, p_sig, band in held:
                agree = (own_sigs == p_sig).mean(axis=1)
                fits = (agree >= least) & (own_comp != c) & (own != p) & (~own_out | (own > p) | (best is not None))
                for k in np.flatnonzero(fits):
                    if int((own_bands[k] == p_bands).argmax()) == band:
                        found.append((p, -float(agree[k]), int(own[k])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([min(d) for d in done], pa.int64()), pa.array([max(d) for d in done], pa.int64())], names=["a", "b"])
    done = chosen()
    yield pa.RecordBatch.from_arrays(
        [pa.array([min(d) for d in done], pa.int64()), pa.array([max(d) for d in done], pa.int64())], names=["a", "b"])


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(id, comp) of every id in ``edges`` (a, b): the smallest id it is joined to.

    Smallest label of the neighbours, then the label's own label, until the labels stay.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(
        edges.select("b", "b")).distinct()
    both = scratch.put(both, f"{name}-edges")
    value = F.col("comp").cast("decimal(38,0)")
    labels, now = scratch.put_counted(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")), f"{name}-0", value)
    total, turn = None, 0
    while now is not None and now != total:
        total, turn = now, turn + 1
        seen = labels.select(F.col("id").alias("b"), F.col("comp").alias("c"))
        nearer = both.join(seen, "b").groupBy("a").agg(F.min("c").alias("c"))
        over = labels.select(F.col("id").alias("c"), "comp")
        labels, now = scratch.put_counted(
            nearer.join(over, "c").select(F.col("a").alias("id"), "comp"), f"{name}-{turn}", value)
        scratch.drop(f"{name}-{turn - 1}")
    scratch.drop(f"{name}-edges")
    return labels


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    for side in ("a", "b"):
        own = sets.select(F.col("id").alias(side), F.col("shingles").alias(f"shingles_{side}"))
        pairs = pairs.join(own, side)
    return pairs.select("a", "b", "shingles_a", "shingles_b").mapInArrow(
        partial(_similar, percent=percent), "a long, b long")


def worth_confirming(rows: DataFrame, sigs: DataFrame, star: bool, best: int | None, percent: int) -> DataFrame:
    """Pairs (a, b) from open buckets (key, id, comp, most, n, outside).

    Pivots are the bucket's first member (``star``) or all outside its largest component.
    They are dealt over blocks and members over salts, so a large bucket is many tasks.
    """
    place = F.xxhash64("id")
    rows = rows.withColumns({
        "blocks": F.ceil(F.when(F.lit(star), 1).otherwise(F.col("outside")) / PIVOTS_HELD).cast("int"),
        "salts": F.ceil(F.col("n") / MEMBERS_A_TASK).cast("int")})
    if star:
        pivots = rows.groupBy("key").agg(F.min(F.struct(
            place.alias("h"), "id", "comp", "most", "blocks", "salts")).alias("m")).select("key", "m.*")
    else:
        pivots = rows.where("comp <> most")
    kept = ["key", "block", "salt", "role", "id", "comp", "out"]
    out = F.lit(False) if star else F.col("comp") != F.col("most")
    pivots = pivots.withColumns({"block": F.pmod(place, F.col("blocks")).cast("int"), "role": F.lit(0), "out": out}).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*kept)
    members = rows.withColumns({"salt": F.pmod(place, F.col("salts")).cast("int"), "role": F.lit(1), "out": out}).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*kept)
    part = ["key", "block", "salt"]
    dealt = pivots.unionByName(members).join(sigs, "id").repartition(*part).sortWithinPartitions(*part, "role")
    return dealt.mapInArrow(partial(_met, least=percent / 100 - MARGIN, best=best), "a long, b long").distinct()


def link_buckets(scratch: Scratch, members: DataFrame, sigs: DataFrame, sets: DataFrame,
                 percent: int, rounds=None) -> DataFrame | None:
    """(id, comp) of the ids in buckets (key, band, id), joined by confirmed links within buckets."""
    state = None
    for turn, (bands, star, best) in enumerate(rounds or ROUNDS):
        rows = members.where(F.col("band") < bands) if bands else members
        rows = rows.select("key", "id", F.col("id").alias("comp")) if state is None else rows.join(
            state, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("key").agg(
            F.max(F.struct("n", F.negative("comp").alias("c"))).alias("m"), F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("comps")).where("comps > 1")
        rows, found = scratch.put_counted(rows.join(largest.select(
            "key", F.negative("m.c").alias("most"), "n", (F.col("n") - F.col("m.n")).alias("outside")), "key"), f"open-{turn}")
        made = [f"open-{turn}"]
        if found:
            pairs, found = scratch.put_counted(worth_confirming(rows, sigs, star, best, percent), f"pairs-{turn}")
            made.append(f"pairs-{turn}")
        if found:
            edges, found = scratch.put_counted(confirmed(pairs, sets, percent), f"links-{turn}")
            made.append(f"links-{turn}")
        scratch.drop(*[n for n in made if not (found and n == f"links-{turn}")])
        if not found:  # nothing open, near or linked: the components stay
            continue
        if state is not None:  # links between the components so far
            for side in ("a", "b"):
                own = state.select(F.col("id").alias(side), F.col("comp").alias("c"))
                edges = edges.join(own, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
        merged = components(scratch, edges, f"comp-{turn}")
        scratch.drop(f"links-{turn}")
        if state is None:
            state = merged
            continue
        renamed = merged.select(F.col("id").alias("comp"), F.col("comp").alias("new"))
        known = state.join(renamed, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp"))
        fresh = merged.join(state.select("id"), "id", "left_anti")
        state = scratch.put(known.unionByName(fresh.select("id", "comp")), f"state-{turn}")
    return state


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set1, set2, component_id, kept) of every row of (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long"), "text", _text_hash())
    signed = scratch.put(with_columns_by_arrow(
        docs, ["text"], SIGNED, partial(_signer, words, bands, rows), keep=["doc_id", "text_hash"]), "signed")
    own = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a number for each distinct set, and the row that stands for it
    reps = own.groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"))
    reps = scratch.put(reps.select("set1", "set2", F.col("m.doc_id").alias("doc"), F.col("m.text_hash").alias("hash"),
                                   F.monotonically_increasing_id().alias("id")), "reps")
    # by the row that stands for a set, so that the copies of one do not meet in a task
    same = reps.withColumnsRenamed({"doc": "doc_id", "hash": "text_hash"})
    firsts = own.select("doc_id", "text_hash", "set1", "set2", "bands").join(
        same, ["doc_id", "text_hash", "set1", "set2"]).dropDuplicates(["id"])
    firsts = scratch.put(firsts.select("id", "bands"), "firsts")
    buckets = firsts.select("id", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = scratch.put(buckets.join(shared, "key"), "members")
    met = scratch.put(same.join(members.select("id").distinct(), "id").select("doc_id", "text_hash", "id"), "met")
    # texts that met no other stay where they are
    texts = marked(docs, met, ["doc_id", "text_hash"]).where("_may").join(met, ["doc_id", "text_hash"]).dropDuplicates(
        ["doc_id", "text_hash"]).select("id", "text")
    sets = scratch.put(with_columns_by_arrow(
        texts, ["text"], "shingles binary, sig binary", partial(_set_maker, words), keep=["id"]), "sets")
    sigs = scratch.put(firsts.join(sets.select("id", "sig"), "id"), "sigs")
    scratch.drop("firsts", "met")
    found = link_buckets(scratch, members, sigs, sets, percent)
    scratch.drop("members", "sets", "sigs")
    lead = F.struct("doc", "set1", "set2")
    ids = reps.withColumn("lead", lead)
    if found is not None:
        # each lead is sent SALTS times, so the rows of a large component are several tasks
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
        leads = reps.join(found, "id").groupBy("comp").agg(F.min(lead).alias("least")).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        ids = reps.join(found, "id", "left").select(
            "set1", "set2", "doc", F.coalesce("comp", "id").alias("comp"), salt).join(
            leads, ["comp", "salt"], "left").withColumn("lead", F.coalesce("least", lead))
    done = signed.join(ids.select("set1", "set2", "lead"), ["set1", "set2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return done.select(
        "doc_id", "text_hash", "n_shingles", "set1", "set2",
        F.when(linked, F.col("lead.doc")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.struct(F.col("doc_id").alias("doc"), "set1", "set2") == F.col("lead")).otherwise(True).alias("kept"))


def _text_hash() -> Column:
    return F.xxhash64("text").alias("text_hash")


def _set_maker(words: int):
    def make(texts):
        own = [shingle_set(t, words) for t in texts.to_pylist()]
        return [[s.tobytes() for s in own],
                [(signature(s, COORDINATES) & np.uint32(255)).astype(np.uint8).tobytes() for s in own]]

    return make


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the one with the smallest doc_id. Documents without
    words or without a doc_id stay; of rows that repeat both doc_id and set, one stays."""
    scratch = Scratch(docs.sparkSession, "without-neardup")
    found = scratch.put(near_duplicates(docs, words, percent).where("doc_id IS NOT NULL AND n_shingles > 0").select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "set1", "set2", "kept"), "found")
    kept = found.where("kept").groupBy("id", "set1", "set2").agg(F.min("hash").alias("hash")).select(
        "id", "hash", F.lit(True).alias("stays")).distinct()
    state = found.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).join(kept, ["id", "hash"], "left")
    # texts that go, or that are there more than once: only these are moved
    concerned = scratch.put(state.where("n > 1 OR stays IS NULL").select(
        "id", "hash", F.coalesce("stays", F.lit(False)).alias("stays")), "concerned")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64("text").alias("hash"))
    flagged = marked(rows, concerned, ["id", "hash"])
    judged = flagged.where("_may").join(concerned, ["id", "hash"], "left")
    one = judged.where("stays").dropDuplicates(["id", "hash"])
    out = flagged.where("NOT _may").select("row").unionAll(judged.where("stays IS NULL").select("row")).unionAll(one.select("row"))
    return out.select("row.*")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
      FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
          GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
          WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_id ON a = d.doc_id
"""

QUERIES = {"op9_minhash_neardup": op9_minhash_neardup}
ORACLES = {"op9_minhash_neardup": SQL}
