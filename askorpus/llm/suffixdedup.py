r"""Removes byte strings of ``LENGTH`` bytes that also start earlier in the corpus.

Cutting the corpus: two equal strings of 100 bytes hold the same least 24-byte gram (by its
hash, ties to the left) at the same place. So each run of starting places with the same
gram occurrence is one segment, and only segments of the same gram are compared, whatever
the size of the corpus. Equal segments are collapsed to the earliest; the others are
repeats as a whole. Grams with one distinct segment are done then.

The rest is dealt by gram into blocks of about ``BLOCK`` bytes. Each block is sorted into a
Burrows-Wheeler order of depth ``LENGTH``. The interval of the empty string is split
breadth first: an interval of a string s is extended backward by every group of ``STEP``
characters that precedes it, which gives the intervals of all strings longer by
``STEP`` and with them the places where the common prefix of neighbours ends. Common prefixes
come by increasing length, and the search stops at ``LENGTH``: places that are still
together start with the same 100 bytes. The earliest of them stays, the others are repeats.

A gram with more than ``HOT`` distinct segments is cut further, into single windows dealt by
their hash, so that no group has to fit in a task; equal windows are compared byte by byte.

A document comes before another with a larger doc_id, and its places by position. Segments
are compared by 128 bits of hash, windows of a block by their bytes.

Defined cases: null and empty texts have no bytes; a text under 100 bytes stays whole;
repeated rows (same doc_id and text) are one document and get the same result; null ids, and
ids that occur with several texts, come after all others, ordered by the hash of their text;
an empty table gives no rows. Ids are below 2^61. Texts are read whole.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.neardup import mix64
from askorpus.llm.shared import Scratch, table, with_columns_by_arrow

LENGTH = 100
GRAM = 24
STEP = 5
BLOCK = 1 << 20
HOT = 20_000
DOCUMENTS_AT_ONCE = 1000
# Bytes of short texts that are cut together: what is made of them stays in a core's cache.
CUT_BYTES = 1 << 15
# Bytes of pieces in a batch that is given back, where one piece is not longer by itself.
FETCH_BYTES = 8 << 20

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_FACTOR, -1, 1 << 64))
_FACTOR = np.uint64(_FACTOR)
_PLACE = np.uint64((1 << 27) - 1)   # low bits of a key: the place, so that ties go to the left
_GRAM_FACTORS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, the first most significant."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    eights, n = _eights(data), len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(_GRAM_FACTORS):
        out = mix64(out * _FACTOR + eights[8 * k:8 * k + n] * factor)
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` values in a row."""
    n = len(x) - width + 1
    blocks = np.append(x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


@lru_cache
def _power_table(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, factor, np.uint64))))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` + 1 powers; those of usual lengths are made once."""
    usual = 4 * CUT_BYTES
    return (_power_table(int(factor), usual) if n <= usual else _power_table.__wrapped__(int(factor), n))[:n + 1]


def segments_of(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    """(text, gram hash, first start, number of starts, hash of the segment's bytes) of texts of at
    least LENGTH bytes that lie one behind the other in ``data``: every start belongs to one segment."""
    grams = gram_hashes(data)
    # texts longer than a key has places for are cut into overlapping parts
    parts = []
    for at in range(0, len(data) - LENGTH + 1, 1 << 26):
        part = grams[at:at + (1 << 26) + LENGTH - GRAM]
        keys = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        parts.append((sliding_least(keys, LENGTH - GRAM + 1) & _PLACE).astype(np.int64) + at)
    least = np.concatenate(parts)
    # no segment reaches from a text into starts whose windows reach into the next one
    new = np.concatenate(([True], least[1:] != least[:-1]))
    new[begins] = True
    new[(begins + sizes - LENGTH + 1)[:-1]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(least)))
    text = np.searchsorted(begins, first, side="right") - 1
    inside = first <= (begins + sizes - LENGTH)[text]
    text, first, count = text[inside], first[inside], count[inside]
    powers, inverse = _powers(_FACTOR, len(data)), _powers(_INVERSE, len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
    content = mix64((sums[first + count + LENGTH - 1] - sums[first]) * inverse[first] + count.astype(np.uint64))
    return text, grams[least[first]], first - begins[text], count, content


def segments(data: np.ndarray):
    """The same of one text, without its number."""
    return segments_of(data, np.zeros(1, np.int64), np.array([len(data)]))[1:]


def _texts_of(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes of the texts of a column, and where each begins, the end of the last one behind them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return memoryview(data if data is not None else b""), at


def _cut(batches):
    """(m, h, d, at) of all segments; at is the start, shifted, and the number of starts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("d").to_numpy()
        data, at = _texts_of(batch.column("text"))
        out, seen, row = [[], [], [], []], 0, 0
        while row < len(ids):
            end = max(row + 1, int(np.searchsorted(at, at[row] + CUT_BYTES, side="right")) - 1)
            own = np.frombuffer(data[at[row]:at[end]], np.uint8)
            text, grams, first, count, content = segments_of(own, at[row:end] - at[row], np.diff(at[row:end + 1]))
            for column, values in zip(out, (grams.view(np.int64), content.view(np.int64), ids[row:end][text], first << 8 | count)):
                column.append(values)
            seen, row = seen + end - row, end
            if seen >= DOCUMENTS_AT_ONCE:
                yield _joined(out)
                out, seen = [[], [], [], []], 0
        if out[0]:
            yield _joined(out)


def _joined(columns):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["m", "h", "d", "at"])


def _collapse(batches):
    """From rows by (m, h, d, at): repeats of an equal segment (open false), and the earliest
    segments of grams that have several (open true)."""
    last, waiting = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in ("m", "h", "d", "at")], axis=1)
        before = np.concatenate(([last if last is not None else rows[0]], rows[:-1]))
        new_gram = rows[:, 0] != before[:, 0]
        if last is None:
            new_gram[0] = True
        new = new_gram | (rows[:, 1] != before[:, 1])
        same = ~new & (rows[:, 2] == before[:, 2]) & (rows[:, 3] == before[:, 3])
        last = rows[-1]
        repeats = rows[~new & ~same]
        starts = np.flatnonzero(new)
        firsts = rows[starts]
        opens = new_gram[starts]
        if waiting is not None:
            firsts, opens = np.concatenate((waiting[None], firsts)), np.concatenate(([True], opens))
            waiting = None
        if len(firsts):
            followed = np.append(firsts[1:, 0] == firsts[:-1, 0], False)
            if opens[-1]:
                waiting = firsts[-1]
            firsts = firsts[~opens | followed]
        both = np.concatenate((repeats, firsts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0]), pa.array(both[:, 2]), pa.array(both[:, 3]),
             pa.array(np.arange(len(both)) >= len(repeats))], names=["m", "d", "at", "open"])


def _fetch(batches):
    """The bytes of each document's open segments; those of hot grams as single windows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, begins = _texts_of(batch.column("text"))
        wanted = batch.column("wanted")
        row = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
        gram, at, hot = (c.to_numpy(zero_copy_only=False) for c in wanted.flatten().flatten())
        d, start, count = batch.column("d").to_numpy()[row], at >> 8, at & 255
        from_ = begins[row] + start
        # rows of the batch that is given back: a whole segment, or each window of one
        many = np.where(hot, count, 1)
        ends = np.cumsum(many * (np.where(hot, 1, count) + LENGTH - 1))
        done = 0
        while done < len(at):
            size = int(ends[done - 1]) if done else 0
            end = max(done + 1, int(np.searchsorted(ends, size + FETCH_BYTES, side="right")))
            take = np.repeat(np.arange(done, end), many[done:end])
            step = np.arange(len(take)) - np.repeat(np.cumsum(many[done:end]) - many[done:end], many[done:end])
            n = np.where(hot[take], 1, count[take])
            lo = from_[take] + step
            own = b"".join([data[a:b] for a, b in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist())])
            offsets = np.concatenate(([0], np.cumsum(n + LENGTH - 1)))
            key = gram[take].copy()
            single = np.flatnonzero(hot[take])
            if len(single):
                key[single] = _window_hashes(own, offsets[single])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(d[take]), pa.array(start[take] + step << 8 | n), pa.array(hot[take]),
                 pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own)])],
                names=["m", "d", "at", "hot", "bytes"])
            done = end


def _window_hashes(data: bytes, begins: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each of ``begins``."""
    eights, out = _eights(np.frombuffer(data, np.uint8)), np.zeros(len(begins), np.uint64)
    for ahead in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        out = mix64(out * _FACTOR + eights[begins + ahead])
    return out.view(np.int64)


def depth_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of ``text`` ordered by the ``depth`` bytes from each, by doubling ranks.

    Where two ranks and a place fit into 64 bits, they are sorted as one number, which is several
    times faster than finding an order; the longest blocks are ordered without their places.
    """
    n = len(text)
    bits = np.uint64(n.bit_length())
    packed, places = 3 * bits <= 64, np.arange(n, dtype=np.uint64)
    known = min(depth, 5 if packed else 8)
    keys = _eights(np.concatenate((text, np.zeros(8, np.uint8))))[:n] >> np.uint64(64 - 8 * known)
    while True:
        if packed:
            ordered = np.sort(keys << bits | places)
            order = (ordered & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
            ordered >>= bits
        else:
            order = np.argsort(keys)
            ordered = keys[order]
        if known == depth:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])), dtype=np.uint64)
        ahead = min(known, depth - known)
        keys = rank << bits
        keys[:n - ahead] |= rank[ahead:] + np.uint64(1)
        known += ahead


def together(text: np.ndarray, order: np.ndarray, depth: int = LENGTH, step: int = STEP) -> np.ndarray:
    """For each row of ``order``, whether it starts another interval of common prefix ``depth``.

    ``ends`` marks where the common prefix of neighbours is shorter than the length reached.
    The group of ``step`` characters before a suffix extends its interval backward; rows stay
    together only if they have the same group and their suffixes beyond it are in one interval.
    """
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = _eights(np.concatenate((text, np.zeros(8, np.uint8))))[:n] >> np.uint64(64 - 8 * step)
    beyond = place[np.minimum(order + step, n - 1)]
    ends = np.concatenate(([True], group[order[1:]] != group[order[:-1]]))
    active = np.flatnonzero(~ends)
    own, other = beyond[active], beyond[active - 1]
    interval = np.empty(n, np.int32)
    for _ in range(step, depth, step):
        np.cumsum(ends, out=interval)
        apart = interval.take(own) != interval.take(other)
        ends[active[apart]] = True
        # rows that were told apart stay so; a few of them are not worth moving all the others
        if 8 * np.count_nonzero(apart) > len(active):
            active, own, other = active[~apart], own[~apart], other[~apart]
        if not len(active):
            break
    return ends


def repeats_in(pieces: list[bytes], counts: list[int]) -> list[tuple[int, int, int]]:
    """(piece, start, number of starts) of the windows that occur in an earlier piece or place.
    A piece has ``counts`` windows; equal windows are only sought among these."""
    text = np.frombuffer(b"".join(pieces) + bytes(LENGTH), np.uint8)
    order = depth_order(text)
    ends = together(text, order)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(sizes) - sizes
    windows = np.zeros(len(text), bool)
    marks = np.zeros(len(text) + 1, np.int64)
    np.add.at(marks, begin, 1)
    np.add.at(marks, begin + np.array(counts), -1)
    windows = np.cumsum(marks[:-1]) > 0
    label = np.cumsum(ends)
    own = windows[order]
    order, label = order[own], label[own]
    heads = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    earliest = np.minimum.reduceat(order, heads)
    later = np.zeros(len(text) + 1, bool)
    later[order[order != np.repeat(earliest, np.diff(np.append(heads, len(order))))]] = True
    edge = np.zeros(len(text) + 1, bool)
    edge[begin] = True
    at = np.flatnonzero(later)
    if not len(at):
        return []
    opens = at[np.concatenate(([True], np.diff(at) > 1)) | edge[at]]
    closes = at[np.concatenate((np.diff(at) > 1, [True])) | edge[at + 1]] + 1
    piece = np.searchsorted(begin, opens, side="right") - 1
    return list(zip(piece.tolist(), (opens - begin[piece]).tolist(), (closes - opens).tolist()))


def _search(batches, block: int):
    """Repeats (d, start, n) in segments by (hot, m, d, at); a block holds whole grams."""
    held, size, gram, first = [], 0, None, None

    def solved():
        rows = repeats_in([h[2] for h in held], [h[1] & 255 for h in held]) if len(held) > 1 else []
        return [(held[p][0], (held[p][1] >> 8) + s, n) for p, s, n in rows]

    def batch_of(rows):
        d, s, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64())],
                                          names=["d", "start", "n"])

    for batch in batches:
        found = []
        for m, d, at, hot, own in zip(*(batch.column(c).to_pylist() for c in ("m", "d", "at", "hot", "bytes"))):
            if (hot, m) != gram:
                if size >= block:
                    found += solved()
                    held, size = [], 0
                gram, first = (hot, m), own
            elif hot and own == first:
                found.append((d, at >> 8, 1))
                continue
            held.append((d, at, own))
            size += len(own)
        yield batch_of(found)
    yield batch_of(solved())


def document_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, d): d identifies a document and orders them."""
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    late = F.lit(1 << 61) + F.pmod(hashed, F.lit(1 << 61))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = rows.select("doc_id", hashed.alias("k")).groupBy("doc_id").agg(
        F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi AND doc_id IS NOT NULL").select(F.col("doc_id").alias("bad"))
    if several.isEmpty():
        return rows.withColumn("d", F.coalesce("doc_id", late))
    return rows.join(several, F.col("doc_id") == F.col("bad"), "left").withColumn(
        "d", F.when(F.col("doc_id").isNull() | F.col("bad").isNotNull(), late).otherwise(F.col("doc_id"))).drop("bad")


def find_repeats(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(d, runs) of the documents of ``document_order`` with repeats: runs of starts (start, n)."""
    scratch = Scratch(docs.sparkSession, "suffixdedup")
    long_enough = docs.where(F.octet_length("text") >= LENGTH).select("d", "text")
    cut = long_enough.mapInArrow(_cut, "m long, h long, d long, at long")
    key = ["m", "h", "d", "at"]
    rows = scratch.put(cut.repartition("m").sortWithinPartitions(*key).mapInArrow(
        _collapse, "m long, d long, at long, open boolean"), "segments")
    open_rows = rows.where("open")
    crowded = scratch.put(open_rows.groupBy("m").count().where(F.col("count") > hot).select("m"), "crowded")
    if crowded.isEmpty():
        open_rows = open_rows.withColumn("hot", F.lit(False))
    else:
        open_rows = open_rows.join(crowded.withColumn("hot", F.lit(True)), "m", "left").withColumn(
            "hot", F.coalesce("hot", F.lit(False)))
    # no more segments than the text has places
    wanted = open_rows.groupBy("d").agg(F.collect_list(F.struct("m", "at", "hot")).alias("wanted"))
    fetched = long_enough.join(wanted, "d").mapInArrow(
        _fetch, "m long, d long, at long, hot boolean, bytes binary")
    # repeated rows of a document give the same segments again
    searched = fetched.repartition("m", "hot").sortWithinPartitions("hot", "m", "d", "at").mapInArrow(
        _distinct, "m long, d long, at long, hot boolean, bytes binary").mapInArrow(
        partial(_search, block=block), "d long, start long, n long")
    found = scratch.put(searched, "found")
    flags = found.unionByName(rows.where("NOT open").select(
        "d", F.shiftright("at", 8).alias("start"), F.col("at").bitwiseAND(255).alias("n")))
    return flags.groupBy("d").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def _distinct(batches):
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("hot", "m", "d", "at")], axis=1)
        before = np.concatenate(([last if last is not None else rows[0] + 1], rows[:-1]))
        last = rows[-1]
        yield batch.filter(pa.array((rows != before).any(axis=1)))


def covered(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Edges (start, end) of the maximal runs of bytes that windows from these starts cover."""
    order = np.argsort(first)
    lo, hi = first[order], np.maximum.accumulate((first + many + LENGTH - 1)[order])
    opens = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return np.stack((lo[opens], hi[np.append(opens[1:], len(lo)) - 1]), axis=1)


def _remover():
    def remove(texts, all_runs):
        data, at = _texts_of(texts)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(all_runs), 0).to_numpy(zero_copy_only=False)).tolist()
        first, many = (c.to_numpy(zero_copy_only=False) for c in all_runs.flatten().flatten())
        sizes, removed, spans, rest = np.diff(at), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        before = 0
        for row, (begin, end, upto) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), ends)):
            if upto == before:
                rest.append(data[begin:end])
                continue
            edges = covered(first[before:upto], many[before:upto])
            removed[row], spans[row], before = (edges[:, 1] - edges[:, 0]).sum(), len(edges), upto
            cuts = [begin, *(edges + begin).ravel().tolist(), end]
            rest.append(b"".join([data[a:b] for a, b in zip(cuts[::2], cuts[1::2])]))
        return sizes, removed, spans, rest

    return remove


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the bytes that stay, joined."""
    ordered = document_order(docs)
    rows = ordered.join(find_repeats(ordered), "d", "left").select("doc_id", "text", "runs")
    return with_columns_by_arrow(rows, ["text", "runs"], "n_bytes long, n_removed long, n_spans long, kept binary",
                                 _remover, keep=["doc_id"])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}
