"""Token counts of byte-level BPE by rank-synchronous array merging.

Distinct pre-tokens of a group of texts are held as one ragged numpy array of symbol ids.
In each round every sequence finds its own lowest-ranked pair and all its occurrences are
merged at once (left to right where they overlap), for all sequences together. What
survives is counted. A merged symbol only takes part in pairs of a higher rank, so this
gives the same symbols as merging one pair at a time.

Special strings inside a text count one token each, as the tokenizers library reads them
by default. The vocabulary file is read by every task from ``path``.

Defined cases: a null or empty text has 0 tokens; repeated rows give repeated results;
columns of the input named like a result column are replaced. Texts are never cut.
"""

from __future__ import annotations

import json
from functools import lru_cache, partial

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.shared import table, with_columns_by_arrow

LIMIT = 512
# Distinct pre-tokens whose counts a task remembers before it starts afresh.
REMEMBERED = 300_000
# Fixed value: how byte-level BPE cuts a text into pre-tokens.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary's merge rules as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        vocab, rules = read["model"]["vocab"], read["model"]["merges"]
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [r if isinstance(r, list) else r.split(" ") for r in rules]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.special = [t["content"] for t in read.get("added_tokens", []) if t.get("special")]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of rules where no rule has it."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))


def surviving(rules: Merges, pieces: list[bytes]) -> np.ndarray:
    """Number of symbols left of each piece after all merges."""
    none = len(rules.keys)
    sizes = np.array([len(p) for p in pieces], np.int64)
    counts = sizes.copy()
    symbols = rules.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    while len(symbols) > 1:
        rank = rules.ranks_of(symbols[:-1], symbols[1:])
        rank[owner[:-1] != owner[1:]] = none
        rank = np.append(rank, none)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(owner)))
        going = np.repeat(lowest < none, lengths)
        if not going.any():
            break
        chosen = (rank == np.repeat(lowest, lengths)) & (rank < none)
        at = np.flatnonzero(chosen)
        # a pair of equal symbols may overlap its neighbour: take every other one of a run
        run = np.cumsum(np.concatenate(([True], np.diff(at) > 1))) - 1
        first = at[np.concatenate(([True], np.diff(at) > 1))]
        at = at[(at - first[run]) % 2 == 0]
        symbols[at] = rules.made[rank[at]]
        keep = going.copy()
        keep[at + 1] = False
        np.subtract.at(counts, owner[at], 1)
        symbols, owner = symbols[keep], owner[keep]
    return counts


@lru_cache(2)
def load(path: str) -> Merges:
    return Merges(path)


def _counter(path: str):
    rules = load(path)
    cut = regex.compile(PRE_TOKENS)
    special = regex.compile("|".join(map(regex.escape, rules.special))) if rules.special else None
    known: dict[str, int] = {}

    def count(texts):
        cuts, extra = [], []
        for text in texts.to_pylist():
            parts, found = [text or ""], 0
            if special and text and any(s in text for s in rules.special):
                parts = special.split(text)
                found = len(parts) - 1
            cuts.append([t for p in parts for t in cut.findall(p)] if len(parts) > 1 else cut.findall(parts[0]))
            extra.append(found)
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({t for c in cuts for t in c if t not in known})
        if fresh:
            known.update(zip(fresh, surviving(rules, [t.encode("utf-8") for t in fresh]).tolist()))
        return [[sum(map(known.__getitem__, c)) + e for c, e in zip(cuts, extra)]]

    return count


def count_tokens(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens of ``text`` under the byte-level BPE vocabulary at ``path`` to ``docs``, or
    to its columns ``keep``."""
    return with_columns_by_arrow(docs, ["text"], "n_tokens long", partial(_counter, path), keep)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "n_bytes"])
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
