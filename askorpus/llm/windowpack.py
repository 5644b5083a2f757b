"""Packing documents into fixed windows by deficit round-robin over source queues.

Every source is a queue of tokens in input order. In each round, one window long, a queue
earns its share of the window; it hands over a packet of tokens as soon as it has earned
any part of it, and what it took beyond its earnings is carried as a deficit into the next
rounds. The packets of a round, queue after queue, make one endless stream that is cut into
windows, so every window holds the target proportions to within two packets per source and
no window but the last has room left. When a queue is used up, the others share its part.

Earnings are whole numbers of 1/65536 token a round, the same in every round between two
used-up queues. So the deficit of a queue before any round is arithmetic, and every task
places its documents on its own, from the tokens of the queue before them: deficits cross
windows and partitions without a task that walks through all rounds.

Steps: encode once and write ids (two bytes each where the vocabulary allows); sum tokens per
queue and task; plan rounds on the driver from one total per queue; place and cut. Ids are
never shuffled unless the totals per (task, source) outgrow a broadcast.

The target shares are the sources' own shares of all tokens, or ``weights``. Sources beyond the
``QUEUES`` largest share ``POOLS`` further queues by hash, so the plan has a fixed size and
no source is left out.

Ids are those of the tokenizers library for a byte-level BPE file: special strings inside a
text are their own ids, nothing is added but id 0 after each document.

Defined cases: a null or empty text is the id 0 alone; a null source is a queue of its own;
repeated rows are packed as often as they occur, a null doc_id is kept; an empty table gives
no pieces. Columns other than doc_id, text and source are not read. Texts are never cut
before they are encoded; a long one is encoded by one task. The last windows are as long as
the powers of two that make up the remaining tokens, so nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, slices, table, with_running_totals
from askorpus.llm.tokencount import byte_letters

LENGTH = 1024
# Tokens a queue hands over at a time: the largest error of a source in a window is two of these.
PACKET = 16
QUEUES = 448
POOLS = 64
# Parts of a token in which earnings are counted.
UNIT = 1 << 16
# Rounds times queues that are worked out at a time.
CELLS = 1 << 18

# Fixed value: white space as Unicode defines it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: pre-tokens of byte-level BPE, for texts cut before the last of several blanks.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


class Encoder:
    """Ids of a byte-level BPE vocabulary in the file format of the tokenizers library."""

    def __init__(self, file: bytes):
        read = json.loads(file)
        vocab, rules = read["model"]["vocab"], read["model"]["merges"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        made = [a + b for a, b in (r if isinstance(r, list) else r.split(" ") for r in rules)]
        names = [*byte_of, *made]
        self.id_of = np.array([vocab[n] for n in names], np.uint32)
        self.special = {t["content"]: np.array([t["id"]], np.uint32) for t in read.get("added_tokens", [])}
        self.width = 2 if max(self.id_of.max(), *self.special.values(), 0) < 1 << 16 else 4
        # one special string that is never allowed: without any, the core tries to match nothing at every
        # character
        self.core = tiktoken.Encoding(
            "file", pat_str=PRE_TOKENS, special_tokens={"<|none|>": len(names)},
            mergeable_ranks={bytes(byte_of[c] for c in n): k for k, n in enumerate(names)})
        # a run of blanks before a word leaves its last blank to the word
        self.blanks = re.compile(f"[{WHITE}]{{2,}}(?=[^{WHITE}])")
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _plain(self, text: str) -> list[np.ndarray]:
        if text.isascii() and "  " not in text and not any(c in text for c in "\t\n\v\f\r"):
            cuts = [0, len(text)]  # no two blanks side by side
        else:
            cuts = [0, *(m.end() - 1 for m in self.blanks.finditer(text)), len(text)]
        return [self.id_of[self.core.encode_to_numpy(text[a:b], disallowed_special=())]
                for a, b in zip(cuts, cuts[1:]) if a < b]

    def ids(self, text: str) -> np.ndarray:
        parts = []
        if any(s in text for s in self.special):
            for k, part in enumerate(self.apart.split(text)):
                parts += [self.special[part]] if k % 2 else self._plain(part)
        else:
            parts = self._plain(text)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(file) -> Encoder:
    key = zlib.crc32(file.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(file.value)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, width: int, file) -> DataFrame:
    """(doc_id, name, task, before, n, ids) of (doc_id, name, text): ``before`` are the tokens of
    the same ``name`` that the task met earlier, ``ids`` end with id 0."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name string, task int, before long, n long, ids binary"

    def run(batches):
        encoder, task = _encoder(file), TaskContext.get().partitionId()
        met: dict[str, int] = defaultdict(int)
        for batch in batches:
            for part in slices(batch, 2):
                before, sizes, packed = [], [], []
                for name, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    ids = np.append(encoder.ids(text or ""), np.uint32(0)).astype(f"<u{width}")
                    before.append(met[name])
                    sizes.append(len(ids))
                    packed.append(ids.tobytes())
                    met[name] += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([task] * len(sizes), pa.int32()),
                     pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "name", "task", "before", "n", "ids"])

    return docs.select("doc_id", "name", "text").mapInArrow(run, schema)


@dataclass
class Rounds:
    """When each queue hands over its packets. Phases lie between rounds in which a queue ends."""

    totals: np.ndarray   # tokens of each queue
    first: np.ndarray    # first round of each phase
    earned: np.ndarray   # [phase, queue]: earnings before the phase, in units
    rate: np.ndarray     # [phase, queue]: earnings a round
    length: int
    packet: int

    def __post_init__(self):
        whole, rest = divmod(int(self.totals.sum()), self.length)
        powers = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        self.whole = whole
        self.tail = whole * self.length + np.cumsum([0, *powers])  # where the short windows begin

    def served(self, phase: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[round, queue]: tokens handed over before round ``at``, which the phase reaches."""
        due = self.earned[phase] + (at - self.first[phase])[:, None] * self.rate[phase]
        return self._handed(due, self.totals)

    def _handed(self, due: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return np.minimum(totals, -(-due // (self.packet * UNIT)) * self.packet)

    def sequence(self, at: np.ndarray) -> np.ndarray:
        short = self.whole + np.searchsorted(self.tail, at, "right") - 1
        return np.where(at < self.whole * self.length, at // self.length, short)

    def begin(self, sequence: np.ndarray) -> np.ndarray:
        short = self.tail[np.clip(sequence - self.whole, 0, len(self.tail) - 1)]
        return np.where(sequence <= self.whole, sequence * self.length, short)

    def ahead(self, queue: int, at: np.ndarray) -> np.ndarray:
        """Tokens of the other queues that come before what ``queue`` hands over in each round."""
        others = np.flatnonzero((self.totals > 0) & (np.arange(len(self.totals)) != queue))
        earlier, out = others < queue, np.zeros(len(at), np.int64)
        if not len(others):
            return out
        for low in range(0, len(at), many := max(1, CELLS // len(others))):
            part = at[low:low + many]
            phase = np.searchsorted(self.first, part, "right") - 1
            rate = self.rate[:, others][phase]
            due = self.earned[:, others][phase] + (part - self.first[phase])[:, None] * rate
            # queues before this one have had their turn of the round
            due += np.where(earlier, rate, 0)
            out[low:low + many] = self._handed(due, self.totals[others]).sum(1)
        return out

    def pieces(self, queue: int, start: int, n: int):
        """Of n tokens that follow the first ``start`` of a queue: start, length, window and place in
        it of each piece."""
        return self.pieces_of(queue, np.array([start], np.int64), np.array([n], np.int64))[1:]

    def pieces_of(self, queue: int, start: np.ndarray, n: np.ndarray):
        """``pieces`` of several documents of a queue, with the number of the document before them."""
        begin = start // self.packet
        sizes = (start + n - 1) // self.packet + 1 - begin
        of = np.repeat(np.arange(len(n)), sizes)
        packets = np.arange(len(of)) + (begin - (np.cumsum(sizes) - sizes))[of]
        due, column = packets * (self.packet * UNIT), self.earned[:, queue]
        phase = np.searchsorted(column, due, "right") - 1
        rounds = self.first[phase] + (due - column[phase]) // self.rate[phase, queue]
        met, which = np.unique(rounds, return_inverse=True)
        low = np.maximum(packets * self.packet, start[of])
        high = np.minimum((packets + 1) * self.packet, (start + n)[of])
        place = self.ahead(queue, met)[which] + low
        # packets of a document that follow each other in the stream are one run
        heads = np.flatnonzero(np.append(True, (place[1:] != (place + high - low)[:-1]) | (of[1:] != of[:-1])))
        of, place, size = of[heads], place[heads], np.add.reduceat(high - low, heads)
        low = low[heads] - start[of]
        begun, ended = self.sequence(place), self.sequence(place + size - 1)
        many = ended - begun + 1
        run = np.repeat(np.arange(len(many)), many)
        sequence = begun[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        edge = self.begin(sequence)
        a = np.maximum(place[run], edge)
        b = np.minimum((place + size)[run], self.begin(sequence + 1))
        return of[run], low[run] + a - place[run], b - a, sequence, a - edge


def plan_rounds(totals: list[int], weights: list[float] | None = None, length: int = LENGTH,
                packet: int = PACKET) -> Rounds:
    """Rounds for queues of so many tokens; a queue without a positive weight comes last."""
    size = [int(t) for t in totals]
    share = list(map(float, weights)) if weights else [float(t) for t in size]
    earned, at = [0] * len(size), 0
    first, before, rates = [], [], []
    left = [q for q in range(len(size)) if size[q]]
    while left:
        # queues without a weight share alike once the weighted ones have ended
        of = {q: share[q] for q in left if share[q] > 0} or dict.fromkeys(left, 1.0)
        whole = sum(of.values())
        rate = [max(1, int(length * UNIT * (of[q] / whole))) if q in of else 0 for q in range(len(size))]
        first.append(at)
        before.append(earned.copy())
        rates.append(rate)
        rounds = min(-(-(size[q] * UNIT - earned[q]) // rate[q]) for q in of)
        earned = [min(e + rounds * r, t * UNIT) for e, r, t in zip(earned, rate, size)]
        at += rounds
        left = [q for q in left if earned[q] < size[q] * UNIT]
    shape = (len(first), len(size))
    return Rounds(np.array(size, np.int64), np.array(first, np.int64), np.array(before, np.int64).reshape(shape),
                  np.array(rates, np.int64).reshape(shape), length, packet)


def pack_documents(docs: DataFrame, path: str, weights: dict[str | None, float] | None = None,
                   length: int = LENGTH, packet: int = PACKET) -> DataFrame:
    """One row per piece of (doc_id, text, source): doc_id, source, start (ids of the document before
    it), size, ids (little-endian, unsigned 32 bits), doc_tokens, sequence_id and at (place in the
    sequence). ``path`` is a vocabulary file; ``weights`` are target proportions by source,
    by default each source's share of all tokens."""
    spark = docs.sparkSession
    with open(path, "rb") as file:
        content = file.read()
    width = Encoder(content).width
    shared = spark.sparkContext.broadcast(content)
    scratch = Scratch(spark, "windowpack")
    # a name tells a null source from every text
    named = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    tokens = scratch.put(encode(docs.select("doc_id", named.alias("name"), "text"), path, width, shared), "tokens")

    own = scratch.put(tokens.groupBy("name", "task").agg(F.sum("n").alias("own")), "own")
    largest = [r["name"] for r in own.groupBy("name").agg(F.sum("own").alias("all"))
               .orderBy(F.desc("all"), "name").limit(QUEUES).collect()]
    wanted = {("-" if s is None else f"+{s}"): float(w) for s, w in (weights or {}).items()}
    pooled = F.pmod(F.xxhash64("name"), F.lit(POOLS)).cast("int") + len(largest)
    numbers = spark.createDataFrame([(n, k) for k, n in enumerate(largest)], "name string, number int")
    queued = own.join(numbers, "name", "left").select(
        "name", "task", "own", F.coalesce("number", pooled).alias("queue"))
    sums = {r["queue"]: r for r in queued.groupBy("queue").agg(F.sum("own").alias("own")).collect()}
    totals = [sums[q]["own"] if q in sums else 0 for q in range(len(largest) + POOLS)]
    targets = [wanted.get(n, 0.0) for n in largest] + [0.0] * POOLS if weights else None
    rounds = plan_rounds(totals, targets, length, packet)
    bases = scratch.put(with_running_totals(queued, ["queue"], F.col("task"), [F.col("name")], {"own": F.col("own")})
                        .select("name", "task", "queue", F.col("own").alias("base")), "bases")
    rows = tokens.join(bases, ["name", "task"]).select(
        "doc_id", "name", "queue", (F.col("base") + F.col("before")).alias("start"), "n", "ids")
    return _cut(rows, rounds, width)


def _cut(rows: DataFrame, rounds: Rounds, width: int) -> DataFrame:
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, start long, size long, "
              "ids binary, doc_tokens long, sequence_id long, at long")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 5):
                # documents of a queue are cut together
                part = part.take(pa.array(np.argsort(part.column(2).to_numpy(), kind="stable")))
                queue, start, n = (part.column(c).to_numpy() for c in (2, 3, 4))
                edges = [0, *(np.flatnonzero(np.diff(queue)) + 1).tolist(), len(queue)]
                found = [rounds.pieces_of(int(queue[a]), start[a:b], n[a:b]) for a, b in zip(edges, edges[1:])]
                of = np.concatenate([f[0] + a for f, a in zip(found, edges)])
                low, size, sequence, at = (np.concatenate([f[k] for f in found]) for k in range(1, 5))
                # pieces follow each other in their document, so all ids in order are the pieces in order
                data = np.frombuffer(b"".join(part.column(5).to_pylist()), f"<u{width}").astype("<u4")
                ends = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int64)
                ids = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                row = pa.array(of, pa.int64())
                names = part.column(1).to_pylist()
                source = pa.array([None if s == "-" else s[1:] for s in names], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), source.take(row), pa.array(low), pa.array(size), ids.cast(pa.binary()),
                     pa.array(n).take(row), pa.array(sequence), pa.array(at)],
                    names=["doc_id", "source", "start", "size", "ids", "doc_tokens", "sequence_id", "at"])

    return rows.mapInArrow(run, schema)


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", F.col("size").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", F.col("at").alias("offset"))


QUERIES = {"op12_mixture_packing": op12_mixture_packing}
ORACLES: dict[str, str] = {}
