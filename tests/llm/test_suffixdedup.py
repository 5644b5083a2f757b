"""Removed bytes against a dictionary of all windows; intervals against plain comparison."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from askorpus.llm import suffixdedup
from askorpus.llm.suffixdedup import (LENGTH, depth_order, document_order, find_repeats, op7_suffix_dedup, remove_repeats,
                                      repeats_in, segments, together)


def brute(rows):
    """rows: (key in order, text); (bytes, removed, spans, hash of the rest) by key."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - LENGTH + 1):
            w = data[s:s + LENGTH]
            if w in seen:
                gone[s:s + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed=1, n=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé ") for _ in range(draw.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(draw.randrange(20, 60))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(draw.randrange(2, 60)))]
        for _ in range(draw.randrange(3)):
            s = draw.choice(shared)
            parts.append(s[draw.randrange(len(s) // 2):])
            parts.append(word())
        out.append("".join(parts))
    out += [out[0], out[0][5:], "x" * 350, "ab" * 120, "", None, "short", "y" * 100, "y" * 100, "q" + "x" * 120, "abc" * 4000]
    return out


def hashes(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest())
            for r in df.collect()}


@pytest.mark.parametrize("hot, block", [(20_000, 2 << 20), (3, 2 << 20), (20_000, 500)])
def test_against_all_windows(docs_of, monkeypatch, hot, block):
    rows = list(enumerate(texts()))
    real = find_repeats
    monkeypatch.setattr(suffixdedup, "find_repeats", lambda docs: real(docs, hot, block))
    assert hashes(remove_repeats(docs_of(rows))) == brute(rows)


def test_order_and_intervals():
    draw = np.random.default_rng(1)
    text = draw.integers(97, 99, 3000).astype(np.uint8)
    text[1500:1800] = text[200:500]
    text[2500:2700] = ord("z")
    order = depth_order(text)
    padded = bytes(text) + bytes(LENGTH)
    strings = [padded[p:p + LENGTH] for p in order]
    assert strings == sorted(strings)
    ends = together(text, order)
    for k in range(1, len(order)):
        if max(order[k], order[k - 1]) + LENGTH <= len(text):
            assert ends[k] == (strings[k] != strings[k - 1])


def test_repeats_in_block():
    a, b = b"a" * 60 + bytes(range(80)), b"b" + b"a" * 60 + bytes(range(80))
    assert repeats_in([a, b], [41, 42]) == [(1, 1, 41)]


def test_segments_share_places():
    data = np.random.default_rng(2).integers(0, 255, 5000).astype(np.uint8)
    grams, first, count, content = segments(data)
    assert count.sum() == 4901 and (first[1:] == first[:-1] + count[:-1]).all()
    moved = segments(np.concatenate((data[1000:], data[:77])))
    inner = {(int(g), int(c)) for g, c in zip(grams, content)}
    other = {(int(g), int(c)) for g, c in zip(moved[0], moved[3])}
    assert len(inner & other) > 0.7 * len(inner)


def test_edges(spark, docs_of, table_dir, sf_dir):
    draw = random.Random(4)
    long = "".join(draw.choice("abcdefgh ") for _ in range(50000))
    rows = [(5, long), (5, long), (3, "k" + long), (None, long), (7, "a" * 150), (7, long[:300]), (8, None)]
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in remove_repeats(
        docs_of(rows).selectExpr("*", "1 AS d", "2 AS runs", "3 AS kept")).collect()}
    assert got[3, 50001] == (0, 0) and got[5, 50000] == (50000, 1) and got[None, 50000] == (50000, 1)
    assert got[7, 150] == (149, 1) or got[7, 150] == (150, 1)
    assert got[7, 300] == (300, 1) and got[8, 0] == (0, 0)
    assert remove_repeats(docs_of(rows)).count() == len(rows)
    assert op7_suffix_dedup(spark, table_dir(documents=docs_of([]))).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op7_suffix_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows} == brute(docs)


def test_texts_are_cut_together_as_one_by_one():
    draw = random.Random(6)
    parts = ["".join(draw.choice("abé ") for _ in range(draw.randrange(100, 400))) for _ in range(300)] + ["z" * 100] * 2
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array(parts)], names=["d", "text"]).slice(3)
    found = pa.Table.from_batches(list(suffixdedup._cut([rows]))).to_pydict()
    alone = []
    for d, text in enumerate(parts[3:], 3):
        grams, first, count, content = segments(np.frombuffer(text.encode(), np.uint8))
        alone += zip(grams.view(np.int64).tolist(), content.view(np.int64).tolist(), [d] * len(first), (first << 8 | count).tolist())
    assert list(zip(*(found[c] for c in ("m", "h", "d", "at")))) == alone


def test_work_on_short_texts_is_not_done_text_by_text(monkeypatch):
    calls = []
    real = suffixdedup.gram_hashes
    monkeypatch.setattr(suffixdedup, "gram_hashes", lambda data: calls.append(len(data)) or real(data))
    rows = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["w" * 150] * 500)], names=["d", "text"])
    list(suffixdedup._cut([rows]))
    assert sum(calls) == 75_000 and len(calls) <= 4


def test_pieces_are_given_back_in_parts(monkeypatch):
    monkeypatch.setattr(suffixdedup, "FETCH_BYTES", 1000)
    texts_ = ["0é" * 200, "abc" * 100]
    wanted = [[{"m": 7, "at": 3 << 8 | 40, "hot": False}, {"m": 8, "at": 50 << 8 | 9, "hot": True}], [{"m": 7, "at": 20 << 8 | 1, "hot": False}]]
    kind = pa.list_(pa.struct([("m", pa.int64()), ("at", pa.int64()), ("hot", pa.bool_())]))
    rows = pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array(texts_), pa.array(wanted, kind)], names=["d", "text", "wanted"])
    found = [r for b in suffixdedup._fetch([rows]) for r in b.to_pylist()]
    data = [t.encode() for t in texts_]
    expect = [(4, 3 << 8 | 40, False, data[0][3:142]), *((4, s << 8 | 1, True, data[0][s:s + 100]) for s in range(50, 59)),
              (5, 20 << 8 | 1, False, data[1][20:120])]
    assert [(r["d"], r["at"], r["hot"], r["bytes"]) for r in found] == expect
    assert [r["m"] for r in found if not r["hot"]] == [7, 7]
    same = {r["bytes"]: r["m"] for r in found if r["hot"]}
    assert len(same) == 3 == len(set(same.values())) and all(same[r["bytes"]] == r["m"] for r in found if r["hot"])
    assert len(list(suffixdedup._fetch([rows]))) > 1
