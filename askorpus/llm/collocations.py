"""Phrases that recur more than their parts explain, counted in direct-address tiles.

Words are ranked by frequency within their language and carry their rank as an id. A pair of ids
is a cell of a square tile of the id plane. Frequent words meet in few tiles near the
origin, and a tile with many occurrences is counted by one dense bincount; the
occurrences of all sparse tiles are counted as sorted coordinates. Frequent pairs are
ranked again and become the ids of the next level, whose pairs (phrase, next word) are counted in
the same tiles: so phrases grow by a word a level, and only frequent ones grow.

Every task counts its own occurrences in groups of bounded size; Spark adds the counts per cell, so
a pair that fills a third of the corpus is one row per group before the shuffle. The
dictionary that tasks hold has a fixed bound. Phrases with frequent words that have no place in it
are counted beside it as strings, by the same shuffle; a bitmap of fixed size over those words keeps
most of the rare ones out. Nothing is lost, it only costs more. If frequent phrases
outgrow what a task may hold, the next level takes one pass per block of them.

Text rule: A-Z are lowered; ``.,;:!?`` and line breaks end a piece, blanks and tabs a word.

Defined cases: a null or empty text has no words; a null language is ``und`` and one with it;
repeated rows count as often as they occur; empty tables give no phrase. Words and texts of any
length are counted whole. Columns other than text and lang are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, slices, table

LONGEST = 3
LEAST = 10
TOP = 2000
# A longer phrase replaces a part of it with so many hundredths of the part's occurrences.
COVERED = 50
# Words with an id, and the bytes of the longest of them.
DICTIONARY = 1 << 19
WORD_BYTES = 64
# Slots of the bitmap over frequent words without an id, and slots of one of its parts.
SLOTS, PART = 1 << 28, 1 << 16
# Phrases of one level that a task holds at a time.
PHRASES = 1 << 21
# Side of a tile, and the occurrences from which one is counted densely.
SIDE = 256
DENSE = SIDE * SIDE // 8
# Occurrences that a task counts at a time; distinct words it holds before it sends them on.
GROUP = 1 << 19
HELD = 300_000
# Bytes of text whose words a task holds at a time, where a text is not longer by itself.
TEXT = 1 << 20

# Fixed values of the text rule: what ends a piece becomes a line feed, a tab a blank.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
RULE = bytes(0x0A if i in ENDS else 0x20 if i == 0x09 else i + 0x20 if 0x41 <= i <= 0x5A else i for i in range(256))
TAIL, END, GAP, RARE = -1, -2, -3, -4


def words_by_language(part: pa.RecordBatch):
    """(language, words) of a batch of (lang, text); END pieces are the word b"\\n", gaps b""."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
        if text:
            texts.setdefault(lang, []).append(text.encode("utf-8"))
    for lang, found in texts.items():
        yield lang, b"\n".join(found).translate(RULE).replace(b"\n", b" \n ").split(b" ")


def tile_counts(left: np.ndarray, right: np.ndarray, side: int = SIDE, dense: int = DENSE):
    """Distinct pairs of ids and how often each occurs."""
    tile = (left // side) << 32 | right // side
    order = np.argsort(tile, kind="stable")
    tile, left, right = tile[order], left[order], right[order]
    starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(tile))
    out = []
    sparse = np.ones(len(tile), bool)
    for a, b in zip(starts[ends - starts >= dense].tolist(), ends[ends - starts >= dense].tolist()):
        sparse[a:b] = False
        row, column = left[a] // side * side, right[a] // side * side
        cells = np.bincount((left[a:b] - row) * side + right[a:b] - column, minlength=side * side)
        at = np.flatnonzero(cells)
        out.append((row + at // side, column + at % side, cells[at]))
    keys, counts = np.unique((left << 32 | right)[sparse], return_counts=True)
    out.append((keys >> 32, keys & 0xFFFFFFFF, counts))
    return tuple(np.concatenate(c) for c in zip(*out))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, f), summed."""
    def run(batches):
        met: dict[str, Counter] = {}

        def sent():
            rows = [(lang, w, f) for lang, words in met.items() for w, f in words.items() if w not in (b"", b"\n")]
            met.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
                 pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "f"])

        for batch in batches:
            for part in slices(batch, 1, size=TEXT):
                for lang, words in words_by_language(part):
                    met.setdefault(lang, Counter()).update(words)
                if sum(map(len, met.values())) > HELD:
                    yield from sent()
        yield from sent()

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Words:
    """Ids of words: those of one language follow each other, the most frequent first. ``filter`` is
    the bitmap over frequent words without an id, None if there are none."""

    def __init__(self, rows: pa.Table, filter: bytes | None):
        self.filter = filter
        # a word holds no blank, so a language's words travel as one string
        self.joined: dict[str, tuple[int, bytes]] = {}
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        words = rows.column("word").combine_chunks().cast(pa.binary())
        codes = langs.indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                self.joined[langs.dictionary[int(codes[a])].as_py()] = (a, b" ".join(words.slice(a, b - a).to_pylist()))
        self.ids: dict[str, dict[bytes, int]] = {}

    def prepare(self) -> "Words":
        for lang, (first, joined) in self.joined.items():
            words = joined.split(b" ")
            self.ids[lang] = dict(zip(words, range(first, first + len(words))))
            self.ids[lang].update({b"": GAP, b"\n": END})
        self.joined = {}
        return self

    def of(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Ids of words without gaps, and those words where the filter may be asked for them."""
        known = self.ids.get(lang) or {b"": GAP, b"\n": END}
        ids = np.fromiter(map(known.get, words, repeat(RARE)), np.int64, len(words))
        there = ids != GAP
        ids = ids[there]
        if self.filter is None:
            return ids, []
        kept = [words[k] for k in np.flatnonzero(there).tolist()]
        for k in np.flatnonzero(ids == RARE).tolist():
            slot = zlib.crc32(kept[k]) & SLOTS - 1
            if self.filter[slot >> 3] >> (slot & 7) & 1:
                ids[k] = TAIL
        return ids, kept


class Phrases:
    """Frequent phrases of one length as ids, the most frequent first: ``rows`` are their word ids."""

    def __init__(self, rows: np.ndarray, frequency: np.ndarray):
        self.rows = rows = rows[np.lexsort((*rows.T[::-1], -frequency))].astype(np.int64)
        self.steps, node = [], rows[:, 0]
        for k in range(1, rows.shape[1]):
            keys, node = np.unique(node << 32 | rows[:, k], return_inverse=True)
            last = k == rows.shape[1] - 1
            self.steps.append((keys, np.argsort(node, kind="stable") if last else np.arange(len(keys))))

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """Id of the phrase that begins at each word, RARE where there is none."""
        size = max(0, len(ids) - len(self.steps))
        if not len(self.rows):
            return np.full(size, RARE, np.int64)
        found = ids[:size]
        for k, (keys, names) in enumerate(self.steps, 1):
            last = ids[k:k + size]
            wanted = found << 32 | last
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            good = (found >= 0) & (last >= 0) & (keys[at] == wanted)
            found = np.where(good, names[at], RARE)
        return found


_READY: dict[str, Words] = {}


def _ready(words) -> Words:
    """The dictionary as a task uses it, built once for each Python worker."""
    key, own = words.value
    if key not in _READY:
        _READY.clear()
        _READY[key] = own.prepare()
    return _READY[key]


def count_longer(texts: DataFrame, words, block, size: int, first: bool) -> DataFrame:
    """Occurrences of phrases of ``size`` words whose first words are a phrase of ``block`` (None: a
    word): their word ids, or, on the first pass, the language and string of those with
    a word that has no id. Counted per group, not summed."""
    names = [f"w{k}" for k in range(size)]
    schema = "lang string, phrase string, " + "".join(f"{n} int, " for n in names) + "f long"

    def run(batches):
        known, phrases = _ready(words), block.value if block else None
        left, right, held = [], [], 0
        strings: dict[str, Counter] = {}

        def tiles():
            a, b, counts = tile_counts(np.concatenate(left), np.concatenate(right))
            ids = a[:, None] if phrases is None else phrases.rows[a]
            none = pa.nulls(len(b), pa.string())
            yield pa.RecordBatch.from_arrays(
                [none, none, *(pa.array(c, pa.int32()) for c in ids.T), pa.array(b, pa.int32()),
                 pa.array(counts, pa.int64())], names=["lang", "phrase", *names, "f"])

        def tails():
            rows = [(lang, p, f) for lang, found in strings.items() for p, f in found.items()]
            none = pa.nulls(len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
                 *[none] * size, pa.array([r[2] for r in rows], pa.int64())], names=["lang", "phrase", *names, "f"])

        for batch in batches:
            for part in slices(batch, 1, size=TEXT):
                for lang, found in words_by_language(part):
                    ids, kept = known.of(lang, found)
                    a = (ids if phrases is None else phrases.symbols(ids))[:max(0, len(ids) - size + 1)]
                    b = ids[size - 1:]
                    both = (a >= 0) & (b >= 0)
                    left.append(a[both])
                    right.append(b[both])
                    held += len(left[-1])
                    if kept and first:
                        windows = np.stack([ids[k:len(ids) - size + 1 + k] for k in range(size)]) if len(ids) >= size else np.zeros((1, 0))
                        at = np.flatnonzero((windows >= TAIL).all(0) & (windows == TAIL).any(0))
                        strings.setdefault(lang, Counter()).update(b" ".join(kept[k:k + size]) for k in at.tolist())
                if held > GROUP:
                    yield from tiles()
                    left, right, held = [], [], 0
                if sum(map(len, strings.values())) > HELD:
                    yield from tails()
                    strings.clear()
        if held:
            yield from tiles()
        if strings:
            yield from tails()

    return texts.mapInArrow(run, schema)


def _bitmap(words: DataFrame) -> bytes:
    """Bits of fixed number, set for the slots of ``words``; its parts are packed in tasks."""
    slots = words.select((F.crc32(F.col("word").cast("binary")).bitwiseAND(SLOTS - 1)).alias("slot")).distinct()

    def pack(batches):
        for batch in batches:
            for place, found in zip(*map(pa.Array.to_pylist, batch.columns)):
                bits = np.zeros(PART, np.uint8)
                bits[found] = 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                    names=["place", "bits"])

    packed = (slots.groupBy(F.expr(f"slot div {PART}").alias("place")).agg(
        F.collect_list((F.col("slot") % PART).cast("int")).alias("found")).mapInArrow(pack, "place long, bits binary"))
    out = bytearray(SLOTS // 8)
    for r in packed.toLocalIterator():
        out[r["place"] * PART // 8:(r["place"] + 1) * PART // 8] = r["bits"]
    return bytes(out)


def frequent_phrases(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to ``longest`` words with ``least`` occurrences, and
    (lang, n), the words of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = scratch.put(count_words(texts), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counted.where(F.col("f") >= least)
    ranked = frequent.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("f"), "lang", "word").limit(DICTIONARY)
    chosen = scratch.put(ranked, "chosen")
    tail = frequent.join(chosen.select("lang", "word"), ["lang", "word"], "left_anti")
    ranks = chosen.orderBy("lang", F.desc("f"), "word").select("lang", "word").toArrow()
    words = Words(ranks, None if tail.isEmpty() else _bitmap(tail))
    names = scratch.put(spark.createDataFrame(ranks.append_column("id", pa.array(range(ranks.num_rows), pa.int32())),
                                              "lang string, word string, id int"), "ids")
    shared = spark.sparkContext.broadcast((scratch.base, words))
    found = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    blocks = [None]
    for size in range(2, longest + 1):
        ids = [f"w{k}" for k in range(size)]
        # one pass per block of frequent phrases; a block is bounded, their number grows with the input
        passes = [count_longer(texts, shared, b, size, k == 0) for k, b in enumerate(blocks)]
        rows = passes[0]
        for more in passes[1:]:
            rows = rows.unionAll(more)
        level = scratch.put(rows.groupBy("lang", "phrase", *ids).agg(F.sum("f").alias("f"))
                            .where(F.col("f") >= least), f"level{size}")
        spelt = level.where("phrase IS NULL").drop("lang")
        for k in ids:
            spelt = spelt.join(names.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"),
                                            *([F.col("lang")] if k == "w0" else [])), k)
        spelt = spelt.select("lang", F.concat_ws(" ", *[f"{k}_word" for k in ids]).alias("phrase"), F.lit(size).alias("size"), "f")
        found = found.unionAll(spelt).unionAll(
            level.where("phrase IS NOT NULL").select("lang", "phrase", F.lit(size).alias("size"), "f"))
        if size < longest:
            numbered = level.where("phrase IS NULL")
            many = -(-numbered.count() // PHRASES)
            blocks = []
            for k in range(max(1, many)):
                own = numbered.where(F.pmod(F.xxhash64(*ids), F.lit(max(1, many))) == k).select(*ids, "f").toArrow()
                rows = np.stack([own.column(c).to_numpy() for c in ids], 1) if own.num_rows else np.zeros((0, size), np.int64)
                blocks.append(spark.sparkContext.broadcast(Phrases(rows, own.column("f").to_numpy())))
    return scratch.put(found, "phrases"), totals


def mine_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP,
                 covered: int = COVERED) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    The score of a phrase is that of its weakest cut into two parts, a*a*1000000 div (l*r);
    a phrase is dropped if a longer candidate around it has ``covered`` hundredths of its occurrences."""
    scratch = Scratch(docs.sparkSession, "collocations")
    phrases, totals = frequent_phrases(docs, scratch, longest, least)
    candidates = phrases.where("size > 1")
    word = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), word.alias("words"),
                             F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("words", 1, F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("rest"))
    known = phrases.select("lang", "phrase", "f")
    scored = (cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
              .join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
              .withColumn("score", F.expr(
                  "CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0))"
                  " div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest")))
    # every shorter phrase inside a candidate, with the occurrences of the most frequent one around it
    inner = (candidates.where("size > 2").select("lang", "f", word.alias("words"), "size",
                                                 F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part"))
             .select("lang", "f", "words", "part", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)).alias("at"))
             .select("lang", "f", F.array_join(F.slice("words", F.col("at"), F.col("part")), " ").alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("around")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.coalesce(F.col("around") * 100 < F.col("a") * covered, F.lit(True)))
            .select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the best of each share of a language first, so that no task ranks a whole language
    share = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) s
           FROM documents),
q AS (SELECT lang, row_number() OVER () piece, regexp_extract_all(s, '[^\x20\x09]+') w FROM p),
u AS (SELECT lang, piece, unnest(w) w, generate_subscripts(w, 1) i FROM q),
v AS (SELECT lang, w, lead(w, 1) OVER o x, lead(w, 2) OVER o y FROM u WINDOW o AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 size, w phrase FROM v UNION ALL SELECT lang, 2, w || ' ' || x FROM v WHERE x IS NOT NULL
      UNION ALL SELECT lang, 3, w || ' ' || x || ' ' || y FROM v WHERE y IS NOT NULL),
f AS (SELECT lang, size, phrase, count(*) f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f a, string_split(phrase, ' ') w FROM f WHERE size > 1 AND f >= 10),
cut AS (SELECT c.*, k, array_to_string(w[1:k], ' ') x, array_to_string(w[k + 1:size], ' ') y
        FROM c, unnest(range(1, size)) t(k)),
scored AS (SELECT cut.lang, cut.size, cut.phrase, a, w, k, l.f l, r.f r,
             CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) score
           FROM cut JOIN f l ON {'a': l.lang, 'b': l.phrase} = {'a': cut.lang, 'b': x}
                JOIN f r ON {'a': r.lang, 'b': r.phrase} = {'a': cut.lang, 'b': y}),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(f) f FROM (
             SELECT lang, a f, array_to_string(w[1:2], ' ') phrase FROM c WHERE size = 3
             UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN around USING (lang, phrase)
         WHERE around.f IS NULL OR 100 * around.f < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": SQL}
