r"""Toxicity by nearest labelled examples.

Terms are lower-case words and word beginnings of four and five characters. The vocabulary
is every term of the labelled examples; inverse document frequencies are counted over all
documents. A term's weight is its inverse document frequency times its contrast: the log
ratio of its shares in toxic and in other training rows, in standard errors. A weak contrast
makes a term light, none leaves it out. A text is a weighted vector of
unit length over it. Labelled examples are kept in an inverted index whose lists are cut into
blocks of ``BLOCK`` examples with the largest weight of each block. Lists of common terms are kept
as dense rows, so several texts are searched by one matrix product. A query adds up the block
maxima of its terms, reads the blocks of highest bound, and then only those whose bound is
not below its k-th best cosine: the nearest examples are exact.

The vote is the mean label of the k nearest, weighted by cosine, and pulled to the share of
toxic rows with the weight ``PULL``, so faint likeness decides little. A logistic curve,
fitted on the examples themselves (each left out of its own search), turns it into a
probability. Texts without any term of the examples get the share of toxic training rows
among such texts.

Bounds of the classifier: it is fitted on at most about ``TRAINING`` labelled rows chosen by the
hash of their id and keeps at most ``EXAMPLES`` of them as examples, so training ids, index and
vocabulary are small enough to broadcast. Labels come from rows
with crc32(doc_id) mod 4 <> 2 only; labels, language, source and id are no input of a score.

Defined cases: null and empty texts have no terms; null ids or labels are not learned from;
an id labelled twice counts by its largest label; without any labelled row every score is 0;
repeated rows get the same score. Texts are read whole. Other columns pass through; those
named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, apart, small_batches, table, together, with_columns_by_arrow

NEIGHBOURS = 15
TRAINING = 20_000
EXAMPLES = 4000
LEAST_CONTRAST = 0.05
BLOCK = 64
FIRST_BLOCKS = 4
# A term is common if one in so many examples has it; texts that are searched together.
COMMON = 24
TEXTS = 64
# Words whose terms a task remembers.
WORDS = 400_000
PULL = 0.5
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
SEED = 17

WORD = re.compile(r"\w+")
# What is no word character of ASCII, as a space.
BLANKS = "".join(c if WORD.match(c) else " " for c in map(chr, range(128)))
# A neighbour of a text that was met before.
NEAR = np.dtype([("cosine", np.float64), ("row", np.int32)])
RESULT = "score double, evidence array<struct<doc_id: long, label: int, cosine: double>>"


def words_of(text: str | None) -> list[str]:
    """The lower-case words; ASCII is split, which finds the same as the pattern in less time."""
    text = (text or "").lower()
    return text.translate(BLANKS).split() if text.isascii() else WORD.findall(text)


def terms_of(text: str | None) -> Counter:
    """How often each word and word beginning occurs."""
    words = Counter(words_of(text))
    out = Counter()
    for word, n in words.items():
        for term in _terms(word):
            out[term] += n
    return out


def _terms(word: str) -> tuple[str, ...]:
    if len(word) < 4:
        return (word,)
    return (word, word[:4] + "-", word[:5] + "-") if len(word) > 4 else (word, word + "-")


def fold(doc_id: Column | str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING) -> DataFrame:
    """(doc_id, text, toxic) of about ``most`` rows that labels may be learned from."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != HELD_OUT)).groupBy(
        "doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = max(1, -(-own.count() // most))
    chosen = own.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(share)) == 0)
    # about most ids and labels: small enough to send, so texts stay where they are
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class _Numbers(dict):
    """Numbers words in the order they are asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Known:
    """Counts the terms of texts that a vocabulary has. What it found for a word is kept, as the
    numbers of up to three terms, until ``WORDS`` words are."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.words = vocabulary, _Numbers()
        self.own = np.full((1024, 3), -1, np.int32)

    def _learn(self, fresh: list[str]) -> None:
        get, end = self.vocabulary.get, len(self.words)
        rows = [(get(w, -1), get(w[:4] + "-", -1), get(w[:5] + "-", -1) if len(w) > 4 else -1) if len(w) > 3 else (get(w, -1), -1, -1)
                for w in fresh]
        if end > len(self.own):
            self.own = np.concatenate([self.own, np.full((max(end, len(self.own)), 3), -1, np.int32)])
        self.own[end - len(fresh):end] = rows

    def keys(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Text number times vocabulary size plus term, for all terms of all texts, and how often."""
        found = [words_of(t) for t in texts]
        if len(self.words) > WORDS:
            self.words.clear()
        before, many = len(self.words), [len(f) for f in found]
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, sum(many))
        if fresh := len(self.words) - before:
            self._learn(list(islice(reversed(self.words), fresh))[::-1])
        own = self.own[numbers]
        at = np.repeat(np.arange(len(texts)) * len(self.vocabulary), many)
        return np.unique((at[:, None] + own)[own >= 0], return_counts=True)

    def counts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of each text."""
        if not self.vocabulary:
            return [(np.zeros(0, np.int64),) * 2 for _ in texts]
        keys, counts = self.keys(texts)
        edges = np.searchsorted(keys, np.arange(len(texts) + 1) * len(self.vocabulary))
        return [(keys[a:b] % len(self.vocabulary), counts[a:b]) for a, b in zip(edges, edges[1:])]

    def __call__(self, text: str | None) -> dict[int, int]:
        terms, counts = self.counts([text])[0]
        return dict(zip(terms.tolist(), counts.tolist()))


def _frequencies(batches, vocabulary):
    """Documents of a task that have each term, and how many of them are toxic; term -1
    stands for those without any."""
    known, size = Known(vocabulary.value), len(vocabulary.value)
    counts = np.zeros((size + 1, 2), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            own = known.counts([t.as_py() for t in part.column("text")])
            bad = [bool(y and y > 0) for y in part.column("toxic").to_pylist()]
            for column, chosen in ((0, own), (1, [o for o, y in zip(own, bad) if y])):
                if not chosen:
                    continue
                terms = np.concatenate([t for t, _ in chosen])
                counts[:size, column] += np.bincount(terms, minlength=size)
                counts[size, column] += sum(not len(t) for t, _ in chosen)
    some = np.flatnonzero(counts[:, 0])
    term = np.where(some == size, -1, some)
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(counts[some, 0]), pa.array(counts[some, 1])],
                                     names=["term", "n", "toxic"])


def count_terms(rows: DataFrame, vocabulary, size: int) -> np.ndarray:
    """(rows, toxic rows) with each term of a broadcast vocabulary, of (text, toxic); the last
    line is of rows without any."""
    counted = rows.select("text", "toxic").mapInArrow(partial(_frequencies, vocabulary=vocabulary), "term long, n long, toxic long")
    found = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((size + 1, 2), np.int64)
    out[found.column("term").to_numpy()] = np.stack([found.column("n").to_numpy(), found.column("toxic").to_numpy()], axis=1)
    return out


def contrast(counts: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """How far each term's share of toxic rows is from that of the others, in standard errors."""
    share = toxic / rows
    inside, outside = counts[:, 1] + share, counts[:, 0] - counts[:, 1] + 1 - share
    ratio = np.log(inside / (toxic + 1)) - np.log(outside / (rows - toxic + 1))
    return np.maximum(LEAST_CONTRAST, np.abs(ratio) / np.sqrt(1 / inside + 1 / outside))


def _arrays(counts) -> tuple[np.ndarray, np.ndarray]:
    """Terms and how often each occurs."""
    if isinstance(counts, dict):
        return np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    return counts


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[0], begins[0] + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class Model:
    """Vocabulary, term weights, block-max index and calibration."""

    def __init__(self, vocabulary, idf, examples, neighbours=NEIGHBOURS):
        """``examples``: (id, label, {term: count} or (terms, counts)), with at least one term each."""
        self.vocabulary, self.idf, self.k = vocabulary, np.asarray(idf, float), neighbours
        self.slope, self.offset, self.base, self.bare = 1.0, 0.0, 0.0, 0.0
        self.known, self.seen = None, {}
        examples = sorted(examples, key=lambda e: e[0])
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.int8)
        self.blocks = -(-len(examples) // BLOCK)
        lists = [_arrays(e[2]) for e in examples]
        sizes = np.zeros(len(self.idf), np.int64)
        for own in lists:
            sizes[self._weighted(*own)[0]] += 1
        # the list of term t is rows[at[t]:at[t + 1]]; lists are filled in place, as the driver would hold
        # weights, their order and the ordered weights at once
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.weights, self.rows = np.empty(self.at[-1]), np.empty(self.at[-1], np.int32)
        free = self.at[:-1].copy()
        for row, own in enumerate(lists):
            terms, weights = self._weighted(*own)
            self.weights[free[terms]], self.rows[free[terms]] = weights, row
            free[terms] += 1
        self.rough = self.dense_peaks = self.place = self.own_at = self.own = self.column = None
        self.met = self.read = 0

    def _weighted(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = (1 + np.log(counts)) * self.idf[terms]
        length = np.sqrt((raw * raw).sum())
        return (terms, raw / length) if length > 0 else (terms[:0], raw[:0])

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        terms, weights = self._weighted(*_arrays(counts))
        return dict(zip(terms.tolist(), weights.tolist()))

    def prepare(self) -> "Model":
        """Makes what a search needs beside the lists: terms that many examples have, as columns of a dense
        matrix in single precision, with the largest weight of each block, and where an example's own
        weights of them are. Not sent with the model."""
        if self.rough is None:
            sizes, size = np.diff(self.at), self.blocks * BLOCK
            common = np.flatnonzero(sizes * COMMON > max(1, len(self.ids)))
            self.place = np.full(len(sizes), -1, np.int32)
            self.place[common] = np.arange(len(common))
            entry = _ranges(self.at[common], sizes[common]).astype(np.int32)
            column = np.repeat(np.arange(len(common), dtype=np.int32), sizes[common])
            rows = self.rows[entry]
            self.rough = np.zeros((size, len(common)), np.float32)
            self.rough[rows, column] = self.weights[entry]
            self.dense_peaks = np.zeros((self.blocks, len(common)))
            np.maximum.at(self.dense_peaks, (rows // BLOCK, column), self.weights[entry])
            # the weights of example r are own[own_at[r]:own_at[r + 1]]
            order = np.argsort(rows, kind="stable")
            self.own_at = np.searchsorted(rows[order], np.arange(size + 1)).tolist()
            self.own, self.column = self.weights[entry[order]], column[order]
        return self

    def _dense(self, rows: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Weights of common terms of some examples, in full, written to the first lines of ``room``."""
        out, at = room[:len(rows)], self.own_at
        out.fill(0)
        for line, r in zip(out, rows.tolist()):
            line[self.column[at[r]:at[r + 1]]] = self.own[at[r]:at[r + 1]]
        return out

    def nearest(self, counts, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, example row) of the k nearest with a positive cosine, ties to the smaller id."""
        return self.nearest_all([counts], [skip])[0]

    def nearest_all(self, queries, skips) -> list[list[tuple[float, int]]]:
        """``nearest`` of several texts. Lists of rare terms are short and added up first; a block's
        bound is the best of these sums in it and its largest weights of common terms."""
        self.prepare()
        size = self.blocks * BLOCK
        if not size or not len(queries):
            return [[] for _ in queries]
        common = np.zeros((len(queries), self.rough.shape[1]))
        sums = np.empty((len(queries), size))
        for q, counts in enumerate(queries):
            terms, weights = self._weighted(*_arrays(counts))
            there = self.place[terms]
            common[q, there[there >= 0]] = weights[there >= 0]
            terms, weights = terms[there < 0], weights[there < 0]
            sizes = self.at[terms + 1] - self.at[terms]
            where = _ranges(self.at[terms], sizes)
            sums[q] = np.bincount(self.rows[where], np.repeat(weights, sizes) * self.weights[where], size)
        bounds = sums.reshape(len(queries), self.blocks, BLOCK).max(2) + common @ self.dense_peaks.T
        # the most promising blocks of all texts give each a k-th cosine; then all that may still beat it
        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS]] = True
        if first.mean() > 0.5:  # one product over all blocks costs less than two over parts of them
            self.met, self.read = self.met + bounds.size, self.read + bounds.size
            return self._best_of_all(sums, common, skips)
        cosines = np.zeros((len(queries), size))
        self._add(cosines, sums, common, first)
        for q, row in enumerate(skips):
            if row >= 0:
                cosines[q, row] = 0
        least = np.partition(cosines, size - self.k, axis=1)[:, size - self.k] if size >= self.k else np.zeros(len(queries))
        wanted = (bounds >= np.maximum(least, 0)[:, None] - 1e-9) & (bounds > 0)
        self._add(cosines, sums, common, wanted.any(0) & ~first)
        self.met, self.read = self.met + wanted.size, self.read + int((wanted | first).sum())
        for q, row in enumerate(skips):
            if row >= 0:
                cosines[q, row] = 0
        out = []
        for own in cosines:
            found = np.flatnonzero(own > 0)
            out.append(self._first(own[found], found))
        return out

    def _first(self, cosines: np.ndarray, rows: np.ndarray) -> list[tuple[float, int]]:
        if len(rows) > self.k:
            cut = np.partition(cosines, len(rows) - self.k)[len(rows) - self.k]
            cosines, rows = cosines[cosines >= cut], rows[cosines >= cut]
        best = np.lexsort((rows, -cosines))[:self.k]
        return list(zip(cosines[best].tolist(), rows[best].tolist()))

    def _best_of_all(self, sums: np.ndarray, common: np.ndarray, skips) -> list[list[tuple[float, int]]]:
        """The nearest of all rows: a product in single precision names those that may be among them, by
        the error it can have; their cosines are then computed in full."""
        rough = sums.astype(np.float32) + common.astype(np.float32) @ self.rough.T
        slack = 1e-6 + 1.2e-7 * (common.shape[1] + 16)
        out, room = [], np.empty((4 * self.k, common.shape[1]))
        for q, skip in enumerate(skips):
            own = rough[q]
            if skip >= 0:
                own[skip] = -1
            cut = np.partition(own, len(own) - self.k)[len(own) - self.k] if len(own) >= self.k else 0.0
            near = np.flatnonzero(own >= max(float(cut), 0.0) - 2 * slack)
            near = near[near != skip]
            if len(near) > len(room):
                room = np.empty((2 * len(near), common.shape[1]))
            exact = np.round(sums[q, near] + self._dense(near, room) @ common[q], 12)
            out.append(self._first(exact[exact > 0], near[exact > 0]))
        return out

    def _add(self, cosines: np.ndarray, sums: np.ndarray, common: np.ndarray, blocks: np.ndarray) -> None:
        """Full cosines of the rows of some blocks."""
        if blocks.any():
            rows = (np.flatnonzero(blocks)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            cosines[:, rows] = np.round(sums[:, rows] + common @ self._dense(rows, np.empty((len(rows), common.shape[1]))).T, 12)

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(c for c, _ in near)
        return (sum(c * self.labels[r] for c, r in near) + PULL * self.base) / (total + PULL)

    def calibrate(self, votes, labels) -> None:
        """Fits the curve on the votes of examples, each left out of its own search."""
        x, y = np.array(votes), np.array(labels, float)
        if len(x) and 0 < y.sum():
            # two rows of either label keep the curve finite when the labels separate
            x = np.concatenate((x, [0.0, 0.0, 1.0, 1.0]))
            y = np.concatenate((y, [0.0, 0.0, 1.0, 1.0]))
            a, b = 1.0, 0.0
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                w = p * (1 - p) + 1e-9
                g = np.array([((y - p) * x).sum() - 1e-3 * a, (y - p).sum() - 1e-3 * b])
                h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
                step = np.linalg.solve(h, g)
                a, b = a + np.clip(step[0], -5, 5), b + np.clip(step[1], -5, 5)
            self.slope, self.offset = float(a), float(b)

    def scores(self, texts: list[str | None]):
        """(probability, [(id, label, cosine)]) of each text."""
        if self.known is None:
            self.known = Known(self.vocabulary)
        keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        if len(self.seen) > 20_000:
            self.seen.clear()
        fresh = {k: t for k, t in zip(keys, texts) if k not in self.seen}
        if len(self.ids):
            found = self.nearest_all(self.known.counts(list(fresh.values())), [-1] * len(fresh))
            self.seen.update((k, np.array(near, NEAR).tobytes()) for k, near in zip(fresh, found))
        out = []
        for near in (np.frombuffer(self.seen.get(k, b""), NEAR).tolist() for k in keys):
            if not near:
                out.append((float(self.bare), []))
                continue
            value = 1 / (1 + np.exp(-np.clip(self.slope * self.vote(near) + self.offset, -30, 30)))
            out.append((float(value), [(int(self.ids[r]), int(self.labels[r]), c) for c, r in near]))
        return out


def numbered(parts: pa.Table) -> tuple[dict[str, int], list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The different terms of all examples with their numbers, as first met, and (id, toxic, terms, counts) of each."""
    words, out = {}, []
    for row in (r for batch in parts.to_batches() for r in batch.to_pylist()):
        ends = np.cumsum([0, *row["sizes"]])
        places = np.fromiter((words.setdefault(t, len(words)) for t in row["terms"]), np.int32, len(row["terms"]))
        codes, counts = (np.frombuffer(row[c], f"u{len(row[c]) // ends[-1]}") for c in ("codes", "counts"))
        codes, counts = places[codes], counts.astype(np.int32)
        out += [(d, y, codes[lo:hi], counts[lo:hi]) for d, y, lo, hi in zip(row["ids"], row["toxic"], ends, ends[1:])]
    return words, out


def fit(docs: DataFrame, labels: DataFrame, training: int = TRAINING, examples: int = EXAMPLES) -> Model:
    """The model, fitted on bounded training rows; document frequencies cover all documents."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    train = scratch.put(training_rows(docs, labels, training), "train")
    rows, toxic = train.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    if not toxic:
        return Model({}, np.zeros(0), [])
    # ids of examples are at most that many: small enough to send
    ids = train.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(examples)
    sample = train.join(F.broadcast(ids), "doc_id").mapInArrow(_term_lists, TERM_LISTS).toArrow()
    # the driver keeps numbers of terms, not the terms of every example
    words, counted = numbered(sample)
    del sample
    pa.default_memory_pool().release_unused()
    sent = docs.sparkSession.sparkContext.broadcast(words)
    learned = count_terms(train, sent, len(words))
    everywhere = count_terms(docs.select("text", F.lit(0).alias("toxic")), sent, len(words))
    sent.destroy()
    total = docs.count()
    idf = np.log((1 + total) / (1 + everywhere[:-1, 0])) + 1
    rows_of = {d: (d, int(y > 0), (codes, counts)) for d, y, codes, counts in counted}
    model = Model(words, idf * contrast(learned[:-1], rows, toxic), list(rows_of.values()))
    # shares of toxic training rows: of all, and of those without any term
    model.base, model.bare = toxic / rows, learned[-1, 1] / max(1, learned[-1, 0])
    del counted, rows_of
    sent = docs.sparkSession.sparkContext.broadcast(model)
    voted = dict(sorted((r[0], r[1]) for r in train.join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInArrow(
        partial(_left_out, sent), "doc_id long, vote double").collect()))
    sent.destroy()
    model.calibrate([voted[d] for d in model.ids.tolist()], model.labels.tolist())
    scratch.drop("train")
    return model


def _left_out(model, batches):
    """The vote on each example without itself; one for each example at most."""
    own, known = model.value, Known(model.value.vocabulary)
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            ids = part.column("doc_id").cast(pa.int64()).to_numpy()
            rows = np.minimum(np.searchsorted(own.ids, ids), max(0, len(own.ids) - 1))
            votes = [own.vote(n) for n in own.nearest_all(known.counts([t.as_py() for t in part.column("text")]), rows.tolist())]
            found = pa.array(own.ids[rows] == ids) if len(own.ids) else pa.array([False] * len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(votes, pa.float64())], names=["doc_id", "vote"]).filter(found)


TERM_LISTS = "ids array<long>, toxic array<int>, sizes array<int>, terms array<string>, codes binary, counts binary"


def _term_lists(batches):
    """The examples of ``TEXTS`` rows in one: their different terms once, then numbers of these and how often
    each occurs, in as few bytes as they need. Texts without terms are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            ids, toxic = (part.column(c).to_pylist() for c in ("doc_id", "toxic"))
            own = [(d, y, o) for d, y, o in zip(ids, toxic, (terms_of(t.as_py()) for t in part.column("text"))) if o]
            if not own:
                continue
            ids, toxic, found = zip(*own)
            terms = _Numbers()
            codes = np.array([terms[t] for o in found for t in o])
            counts = np.array([n for o in found for n in o.values()])
            codes, counts = (v.astype(np.min_scalar_type(v.max())).tobytes() for v in (codes, counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([toxic], pa.list_(pa.int32())),
                 pa.array([[len(o) for o in found]], pa.list_(pa.int32())), pa.array([list(terms)], pa.list_(pa.string())),
                 pa.array([codes], pa.binary()), pa.array([counts], pa.binary())],
                names=["ids", "toxic", "sizes", "terms", "codes", "counts"])


def _scorer(model):
    def score(texts):
        rows = []
        for at in range(0, len(texts), TEXTS):
            rows += model.value.scores([t.as_py() for t in texts[at:at + TEXTS]])
        return [[r[0] for r in rows], [[{"doc_id": d, "label": y, "cosine": c} for d, y, c in r[1]] for r in rows]]

    return score


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds score and evidence (the nearest examples with label and cosine) to ``docs``, or to
    its columns ``keep``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns_by_arrow(docs, ["text"], RESULT, partial(_scorer, sent), keep)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score below the threshold."""
    scored = score_documents(apart(docs, ["text"]), fit(docs, labels))
    return together(scored.where(F.col("score") < threshold), docs, ["text"])


def op4_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity_neighbours": op4_toxicity_neighbours}
ORACLES: dict[str, str] = {}
