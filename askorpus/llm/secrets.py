r"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of word characters and single other characters. The field tags each as
secret begin (B), inside (I) or outside (O) from its shape, the shapes of its neighbours,
cue words before it, the blanks around it and features of the whole file. It is trained
here by maximum likelihood on a bounded sample of documents (``TRAIN_DOCUMENTS``), labelled
by the patterns; cue words are hidden in part of the training windows, so that shape and
context each have to carry a decision. Tags are decoded by Viterbi.

A token whose O score leads by more than the transitions could make up for is outside on
every best path. Such tokens cut a text into short pieces that are decoded together,
which is exact and leaves little to decode.

Spans of the patterns always stay; spans of the field are added where they overlap none and
have ``LEAST`` characters. Positions are code points, ends exclusive.

Defined cases: a null text is empty and has no spans; a repeated row gets the same spans
again; a sample without any pattern leaves the field silent. Texts are read whole. Other
columns pass through; one named ``secrets`` is replaced.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.shared import table, with_columns_by_arrow

KINDS = ("assign", "access", "hex", "crf")
TRAIN_DOCUMENTS = 3000
WINDOW = 24          # tokens on either side of a training window's centre
LONG_WINDOWS, OTHER_WINDOWS = 1200, 600
LEAST = 8
SEED = 5
SECRETS = "secrets array<struct<kind: string, start: int, end: int>>"

# What the patterns of the base scan are.
CUE = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = re.compile(CUE + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
CUES = re.compile(CUE + "|[aA][uU][tT][hH]|[bB][eE][aA][rR][eE][rR]|[cC][rR][eE][dD][eE][nN]|[pP][wW][dD]|[kK][eE][yY]")

# Character classes: 0 blank, 1 digit, 2 a-f, 3 g-z, 4 capital, 5 underscore, 6 beyond ASCII,
# then single characters, 7 = 8 : 9 quote 10 . 11 - 12 / 13 + 14 any other.
CLASSES = np.full(129, 14, np.uint8)
for _chars, _class in ((range(0x09, 0x0E), 0), ((0x20,), 0), (range(0x30, 0x3A), 1), (range(0x61, 0x67), 2),
                       (range(0x67, 0x7B), 3), (range(0x41, 0x5B), 4), ((0x5F,), 5), ((128,), 6),
                       (b"=", 7), (b":", 8), (b"\"'", 9), (b".", 10), (b"-", 11), (b"/", 12), (b"+", 13)):
    CLASSES[list(_chars)] = _class
LENGTHS = np.array([4, 8, 12, 16, 24, 40])
# Number of values of each feature, in the order in which features() gives them.
SIZES = (133, 133, 133, 133, 6, 9, 4, 4, 4, 3, 8, 5)
HIDDEN = 5           # the feature that says how far the last cue word is


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def features(texts: list[str]):
    """(starts, ends, document of each token, feature values): tokens of all texts in a row."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = CLASSES[np.minimum(points, 128)]
    word = (kind >= 1) & (kind <= 6)
    inner = word[1:] & word[:-1]
    shown = kind > 0
    starts = np.flatnonzero(shown & ~np.concatenate(([False], inner)))
    ends = np.flatnonzero(shown & ~np.concatenate((inner, [False]))) + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    owner = np.searchsorted(begins, starts, side="right") - 1
    n = len(starts)
    if not n:
        return starts, ends, owner, np.zeros((0, len(SIZES)), np.int64), begins

    def count(mask):
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return total[ends] - total[starts]

    length = (ends - starts).astype(np.int32)
    digits, hexes, lower, upper = (count(kind == k) for k in (1, 2, 3, 4))
    wide = count(kind == 6)
    letters = hexes + lower
    mix = np.full(n, 0)
    first = kind[starts]
    single = first >= 7
    # what a word is made of
    choices = [(wide > 0, 1), (digits == length, 2), (letters == length, 3), (upper == length, 4),
               ((upper == 1) & (first == 4) & (letters + upper == length), 5), (letters + upper == length, 6),
               ((digits + hexes == length), 7), ((digits + letters == length), 8), ((digits + upper == length), 9),
               (digits > 0, 10)]
    mix = np.select([c for c, _ in choices], [v for _, v in choices], 11)
    bucket = np.searchsorted(LENGTHS, length, side="right")
    shape = np.where(single, 1 + first - 7, 10 + mix * 7 + bucket) + 1
    turns = np.concatenate(([False], (kind[1:] > 1) != (kind[:-1] > 1)))
    changes = np.minimum(np.searchsorted([2, 4, 6, 9], count(turns), side="right"), 5)

    def beside(values, by):
        out = np.zeros(n, np.int64)
        if by > 0:
            out[by:] = np.where(owner[by:] == owner[:-by], values[:-by], 0)
        else:
            out[:by] = np.where(owner[:by] == owner[-by:], values[-by:], 0)
        return out

    cues = np.array([m.start() for m in CUES.finditer(joined)], np.int64)
    at = np.full(n, -100, np.int64)
    if len(cues):
        at[np.searchsorted(starts, cues, side="right") - 1] = 0
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(at == 0, place, -1))
    far = place - last
    near = (last >= 0) & (far <= 7) & (owner[np.maximum(last, 0)] == owner)
    cue = np.where(near, far + 1, 0)
    blank = np.concatenate(([True], kind == 0, [True]))
    around = blank[starts] * 2 + blank[ends + 1]
    per = np.bincount(owner, minlength=len(texts))
    size = np.searchsorted([100, 400, 1500], per, side="right")
    share = np.bincount(owner, weights=digits > 0, minlength=len(texts)) / np.maximum(per, 1)
    numbers = np.searchsorted([0.005, 0.02, 0.1], share, side="right")
    cued = np.minimum(np.bincount(owner, weights=at == 0, minlength=len(texts)), 2).astype(np.int64)
    some = (digits > 0) * 1 + (letters + upper > 0) * 2 + (wide > 0)
    values = np.stack([shape, beside(shape, 1), beside(shape, -1), beside(shape, 2), changes, cue, around,
                       size[owner], numbers[owner], cued[owner], np.where(single, 7, bucket), some], axis=1)
    return starts, ends, owner, values, begins


OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))[:-1]


class Field:
    """Weights of the field: by feature value and tag, and between tags. O, B, I are 0, 1, 2."""

    def __init__(self):
        self.weights = np.zeros((sum(SIZES), 3))
        self.moves = np.zeros((3, 3))

    def scores(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), 3))
        for f in range(values.shape[1]):
            out += self.weights[values[:, f] + OFFSETS[f]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.2, decay: float = 1e-5) -> Field:
    """Maximum likelihood by Adam steps over all windows (feature values, tags)."""
    field = Field()
    if not any((tags > 0).any() for _, tags in windows):
        field.weights[:, 0] = 1.0
        return field
    longest = max(len(t) for _, t in windows)
    n = len(windows)
    x = np.zeros((n, longest, len(SIZES)), np.int64)
    y = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for k, (values, tags) in enumerate(windows):
        x[k, :len(tags)], y[k, :len(tags)], real[k, :len(tags)] = values, tags, True
    x += OFFSETS
    flat = x[real]

    def counted(chance):
        return np.stack([sum(np.bincount(flat[:, f], weights=chance[:, tag], minlength=len(field.weights))
                             for f in range(len(SIZES))) for tag in range(3)], axis=1)

    gold = counted(np.eye(3)[y[real]])
    gold_moves = np.zeros((3, 3))
    both = real[:, 1:] & real[:, :-1]
    np.add.at(gold_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
    state = [[np.zeros(w.shape), np.zeros(w.shape)] for w in (field.weights, field.moves)]
    for turn in range(1, rounds + 1):
        e = field.weights[x].sum(axis=2)
        forward, backward = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = e[:, t] + _log_sum(forward[:, t - 1, :, None] + field.moves, 1)
            forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _log_sum(field.moves[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = _log_sum(forward[:, -1], 1)
        chance = np.exp(forward + backward - total[:, None, None])[real]
        pair = (forward[:, :-1, :, None] + field.moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :]
                - total[:, None, None, None])
        steps = (gold - counted(chance), gold_moves - np.exp(pair[both]).sum(axis=0))
        for w, step, (mean, square) in zip((field.weights, field.moves), steps, state):
            step = step / n - decay * w
            mean += 0.1 * (step - mean)
            square += 0.01 * (step ** 2 - square)
            w += rate * (mean / (1 - 0.9 ** turn)) / (np.sqrt(square / (1 - 0.99 ** turn)) + 1e-8)
    return field


def viterbi(scores: np.ndarray, moves: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Best tags of pieces (start, end rows of ``scores``), each between two outside tokens."""
    tags = np.zeros(len(scores), np.int64)
    if not len(pieces):
        return tags
    order = np.argsort(pieces[:, 0] - pieces[:, 1], kind="stable")
    begin, length = pieces[order, 0], (pieces[:, 1] - pieces[:, 0])[order]
    back = np.zeros((len(scores), 3), np.int8)
    best = scores[begin] + moves[0]
    for t in range(1, length[0]):
        live = int(np.searchsorted(-length, -t, side="left"))
        ways = best[:live, :, None] + moves
        back[begin[:live] + t] = ways.argmax(axis=1)
        best[:live] = ways.max(axis=1) + scores[begin[:live] + t]
    tag = (best + moves[:, 0]).argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, side="left"))
        at = begin[:live] + t
        tags[at] = tag[:live]
        if t:
            tag[:live] = back[at, tag[:live]]
    return tags


def decode(field: Field, scores: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Best tags of every text. Texts begin and end next to an outside token."""
    slack = 2 * (field.moves.max() - field.moves.min())
    loose = scores[:, 0] - scores[:, 1:].max(axis=1) <= slack
    edge = np.concatenate(([True], owner[1:] != owner[:-1]))
    opens = loose & (edge | ~np.concatenate(([False], loose[:-1])))
    closes = loose & (np.concatenate((edge[1:], [True])) | ~np.concatenate((loose[1:], [False])))
    return viterbi(scores, field.moves, np.stack([np.flatnonzero(opens), np.flatnonzero(closes) + 1], axis=1))


def tagged_runs(tags: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(first token, token after the last) of each B I I ... run; an I after O begins one too."""
    secret = tags > 0
    after = np.concatenate(([False], secret[:-1] & (owner[1:] == owner[:-1])))
    opens = np.flatnonzero(secret & ((tags == 1) | ~after))
    follows = np.concatenate((secret[1:] & (tags[1:] == 2) & (owner[1:] == owner[:-1]), [False]))
    closes = np.flatnonzero(secret & ~follows) + 1
    return list(zip(opens.tolist(), closes.tolist()))


def secrets_of(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    found = [base_spans(t) for t in texts]
    starts, ends, owner, values, begins = features(texts)
    tags = decode(field, field.scores(values), owner) if len(starts) else np.zeros(0, np.int64)
    for a, b in tagged_runs(tags, owner) if len(starts) else ():
        d = int(owner[a])
        lo, hi = int(starts[a] - begins[d]), int(ends[b - 1] - begins[d])
        if hi - lo >= LEAST and not any(s < hi and lo < e for k, s, e in found[d] if k != "crf"):
            found[d].append(("crf", lo, hi))
    return [ordered(f) for f in found]


def training_windows(texts: list[str], seed: int = SEED, group: int = 128):
    """Windows around pattern spans, half of them with cue words hidden; around long tokens that
    are none; and anywhere. Texts are read in small groups."""
    out, draw = [], np.random.default_rng(seed)
    for at in range(0, len(texts), group):
        part = texts[at:at + group]
        out += _windows_of(part, draw, len(part) / len(texts))
    return out


def _windows_of(texts: list[str], draw: np.random.Generator, share: float):
    starts, ends, owner, values, begins = features(texts)
    tags = np.zeros(len(starts), np.int64)
    centres = []
    for d, text in enumerate(texts):
        spans = [(m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
        spans += [(s, e) for k, s, e in base_spans(text) if k != "assign"]
        for s, e in sorted(spans):
            a, b = np.searchsorted(starts, [begins[d] + s, begins[d] + e])
            if a < b and not tags[a:b].any():
                tags[a:b], tags[a] = 2, 1
                centres.append(int(a))
    if len(starts):
        others = np.flatnonzero((tags == 0) & (ends - starts >= LEAST) & (values[:, 0] > 10))
        centres += draw.permutation(others)[:round(LONG_WINDOWS * share)].tolist()
        centres += draw.integers(0, len(starts), round(OTHER_WINDOWS * share)).tolist()
    out = []
    for k, c in enumerate(centres):
        own = np.arange(max(0, c - WINDOW), min(len(starts), c + WINDOW + 1))
        own = own[owner[own] == owner[c]]
        part = values[own].copy()
        if k % 2:
            part[:, HIDDEN] = np.minimum(part[:, HIDDEN], 0)
        out.append((part, tags[own]))
    return out


def fit(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Field:
    """The field, trained on about ``documents`` texts chosen by the hash of their id."""
    share = max(1, docs.count() // documents)
    rows = docs.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(share)) == 0)
    texts = sorted(r[0] for r in rows.select("text").where("text <> ''").limit(2 * documents).collect())
    return train(training_windows(texts)) if texts else train([])


def _scanner(field):
    def scan(texts):
        own = [t or "" for t in texts.to_pylist()]
        return [[[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in secrets_of(own, field.value)]]

    return scan


def find_secrets(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """Adds ``secrets``, the spans by start and kind, to ``docs`` or to its columns ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    return with_columns_by_arrow(docs, ["text"], SECRETS, partial(_scanner, sent), keep)


def op1_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit(docs), ["doc_id"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


QUERIES = {"op1_crf_secrets": op1_crf_secrets}
ORACLES: dict[str, str] = {}
