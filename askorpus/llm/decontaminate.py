"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte by byte (A-Z lowered, every other ASCII character that is no
letter or digit becomes a blank), so a position in the normalised bytes is the same
position in the original and hits map back without a table. The automaton holds every
window of ``window`` consecutive item words, and an item with fewer words as one window.
It runs over a document once.

The benchmark is broadcast as distinct windows. Its size is measured first; beyond
``automaton_bytes`` it is cut into several automata of that size, each read over the
documents in turn, so no task holds more than one.

Defined cases: a null or empty text has no words and no hits; an item without words has
no window; an item without an id counts in n_hit and spans, and is in no list of items; repeated
items and windows keep every item id; repeated rows give repeated
results; an empty benchmark leaves all documents clean. Other columns pass through;
columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, apart, table, together, with_columns_by_arrow

WINDOW = 10
AUTOMATON_BYTES = 16 << 20

# Fixed values of the word rule: separators are ASCII other than letters and digits.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
NORMALISE = bytes(0x20 if i in SEPARATORS else i + 0x20 if 0x41 <= i <= 0x5A else i
                  for i in range(256))

HITS = "array<struct<first: long, after: long, items: array<long>>>"
RESULT = "n_words long, n_hit long, items array<long>, spans array<struct<start: int, end: int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(NORMALISE).split() if text else []


def windows_of(text: str | None, window: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    size = min(window, len(words))
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if words else []


def automaton(windows: dict[bytes, list[int]]) -> ahocorasick.Automaton:
    """Windows with a blank on either side, so that only whole words match."""
    built = ahocorasick.Automaton()
    for words, items in windows.items():
        built.add_word(f" {words.decode('latin-1')} ", (len(words) + 2, tuple(items)))
    if windows:
        built.make_automaton()
    return built


def hits_of(words: list[bytes], built: ahocorasick.Automaton) -> list[tuple[int, int, tuple]]:
    """(first word, word after the last, item ids) of every window that occurs."""
    if not words or not len(built):
        return []
    plain = f" {b' '.join(words).decode('latin-1')} "
    found = [(end - size + 1, end, items) for end, (size, items) in built.iter(plain)]
    if not found:
        return []
    blanks = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 0x20)
    first = np.searchsorted(blanks, [f[0] for f in found]).tolist()
    last = np.searchsorted(blanks, [f[1] for f in found]).tolist()
    return [(a, b, f[2]) for a, b, f in zip(first, last, found)]


def runs_of(n_words: int, hits) -> np.ndarray:
    """Maximal runs of hit words, as (first, end) pairs."""
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, [h[0] for h in hits], 1)
    np.add.at(marks, [h[1] for h in hits], -1)
    hit = (np.cumsum(marks[:-1]) > 0).astype(np.int8)
    return np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])))).reshape(-1, 2)


def original_spans(data: bytes, runs: np.ndarray) -> list[dict]:
    """Code points of runs of words: byte positions are those of the original text."""
    inside = (np.frombuffer(data.translate(NORMALISE), np.uint8) > 0x20).astype(np.int8)
    steps = np.diff(np.concatenate(([0], inside, [0])))
    begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    raw = np.frombuffer(data, np.uint8)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"start": int(points[begins[a]]), "end": int(points[ends[b - 1]])} for a, b in runs]


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item_ids) of (item_id, text); an item without an id has windows like any other, but adds
    no id."""
    def cut(batches):
        for batch in batches:
            rows = [(w, i) for i, t in zip(*map(pa.Array.to_pylist, batch.columns))
                    for w in set(windows_of(t, window))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                names=["window", "item_id"])

    return (items.select(F.col("item_id").cast("long"), "text")
            .mapInArrow(cut, "window binary, item_id long")
            .groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                       automaton_bytes: int = AUTOMATON_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_hit, items (ids with an occurring window) and spans (runs of hit words,
    code points, end exclusive) to ``docs``, or to its columns ``keep``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    windows = scratch.put(benchmark_windows(items, window), "windows")
    size = windows.agg(F.sum(F.length("window") + 8 * F.size("item_ids"))).first()[0] or 0
    blocks = max(1, -(-size // automaton_bytes))
    rows = docs.withColumn("hits", F.lit(None).cast(HITS))
    for block in range(blocks):
        # one block holds about automaton_bytes, whatever the size of the benchmark
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        part = spark.sparkContext.broadcast({bytes(r[0]): list(r[1]) for r in own.toLocalIterator()})
        last = block == blocks - 1
        rows = with_columns_by_arrow(rows, ["text", "hits"], RESULT if last else f"hits {HITS}",
                                     partial(_tagger, part, last), keep if last else None)
        if not last:
            rows = scratch.put(rows, f"block{block}")
    return rows.drop("hits")


def _tagger(part, last):
    built = automaton(part.value)

    def tag(texts, before):
        out = []
        for text, had in zip(texts.to_pylist(), before.to_pylist()):
            words = words_of(text)
            hits = [(h["first"], h["after"], h["items"]) for h in had or ()] + hits_of(words, built)
            if not last:
                out.append([[{"first": a, "after": b, "items": list(c)} for a, b, c in hits]])
                continue
            runs = runs_of(len(words), hits)
            out.append((len(words), int((runs[:, 1] - runs[:, 0]).sum()), sorted({i for h in hits for i in h[2]}),
                        original_spans(text.encode("utf-8"), runs) if hits else []))
        return list(zip(*out)) if out else [[]] * (4 if last else 1)

    return tag


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs."""
    found = find_contamination(apart(docs, ["text"]), items, window)
    return together(found.where("n_hit = 0"), docs, ["text"])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("n_words"), F.col("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') s
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') s
       FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
hit AS (SELECT DISTINCT dw.r, dw.i, dw.n FROM dw SEMI JOIN bw ON bw.n = dw.n AND bw.s = dw.s),
cover AS (SELECT r, count(DISTINCT p) n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY r),
found AS (SELECT r, count(*) n_items, string_agg(k, ',' ORDER BY k) ids
          FROM (SELECT DISTINCT dw.r, CAST(bw.item_id AS VARCHAR) k
                FROM dw JOIN bw ON bw.n = dw.n AND bw.s = dw.s WHERE bw.item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN found USING (r)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": SQL}
