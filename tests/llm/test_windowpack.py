"""Packed windows against the tokenizers library: every id once, full windows, target proportions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from askorpus.llm.windowpack import Encoder, op12_mixture_packing, pack_documents, plan_rounds

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [[*e.ids, 0] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def joined(pieces):
    """Pieces of one document in order; they must follow each other without a gap."""
    ids, at = [], 0
    for p in sorted(pieces, key=lambda p: p["start"]):
        assert p["start"] == at and p["size"] > 0 and p["doc_tokens"] == sum(q["size"] for q in pieces)
        ids += np.frombuffer(p["ids"], "<u4").tolist()
        at += p["size"]
    return ids


def windows(rows, size="size", at="at"):
    """Tokens of each window, whose pieces must lie side by side."""
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r[at], r[size]))
    for pieces in found.values():
        end = 0
        for place, many in sorted(pieces):
            assert place == end
            end += many
        pieces.append(end)
    assert sorted(found) == list(range(len(found)))
    return [found[k][-1] for k in sorted(found)]


def full(sizes, length):
    return all(s == length for s in sizes if s & (s - 1)) and max(sizes, default=0) <= length


def test_encoder_gives_the_library_ids(library):
    draw = random.Random(5)
    encoder = Encoder(open(PATH, "rb").read())
    pool = ["the", " token", "aaa", "  ", "\n", " \n", "é", "漢字", "🙂", "don't", "'LL", "123", "...", " ", "\t\t", "\x85", "\xa0",
            " ", "\x1c", "​", "A" * 50, "<|endoftext|>", "<|endof"]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(40))) for _ in range(800)] + ["", " ", "  ", "x  ", "  x"]
    assert [[*encoder.ids(t), 0] for t in texts] == expected(library, texts)


def test_every_id_once_and_windows_full(docs_of, library):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["ab", "the", "né", "x1", "<|endoftext|>"]) for _ in range(draw.choice([0, 1, 9, 200])))
             for _ in range(60)] + [None, "", "long " * 3000]
    rows = [(k, t, draw.choice(["a", "a", "a", "b", None])) for k, t in enumerate(texts)]
    got = [r.asDict() for r in pack_documents(docs_of(rows), PATH, length=64, packet=4).collect()]
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [joined(by[k]) for k in range(len(texts))] == expected(library, texts)
    assert full(windows(got), 64)
    assert {r["doc_id"]: r["source"] for r in got} == {k: s for k, _, s in rows}


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1, "c": 1}, {"b": 1}])
def test_proportions_of_every_window(docs_of, weights):
    draw = random.Random(2)
    rows = [(k, "one two three " * draw.randrange(60), draw.choice("aaaaaabbc")) for k in range(200)]
    got = [r.asDict() for r in pack_documents(docs_of(rows), PATH, weights, length=128, packet=4).collect()]
    total = Counter()
    for r in got:
        total[r["source"]] += r["size"]
    held = defaultdict(Counter)
    for r in got:
        held[r["sequence_id"]][r["source"]] += r["size"]
    share = weights or total
    going = [s for s in "abc" if share.get(s)]
    left = Counter(total)
    for k in range(len(held)):
        left -= held[k]
        if any(left[s] < 128 for s in going):
            break
        for s in "abc":
            assert abs(held[k][s] - 128 * share.get(s, 0) / sum(share.values())) <= 8
    assert k > 10


def test_rounds_match_a_walk():
    """The arithmetic places packets where a walk through all rounds would."""
    draw = random.Random(4)
    for _ in range(40):
        totals = [draw.choice([0, 1, 5, 40, 300]) for _ in range(draw.randrange(1, 6))]
        weights = draw.choice([None, [draw.randrange(4) for _ in totals]])
        plan = plan_rounds(totals, weights, 32, 4)
        stream, rounds = [], 0
        taken = [0] * len(totals)
        while len(stream) < sum(totals):
            phase = np.searchsorted(plan.first, [rounds], "right") - 1
            due = plan.served(phase, np.array([rounds + 1]))[0]
            for q, d in enumerate(due.tolist()):
                stream += [(q, x) for x in range(taken[q], d)]
                taken[q] = d
            rounds += 1
        places = {}
        for q, t in enumerate(totals):
            at = 0
            while at < t:
                n = min(draw.randrange(1, 90), t - at)
                for low, size, sequence, offset in zip(*(x.tolist() for x in plan.pieces(q, at, n))):
                    for i in range(size):
                        places[q, at + low + i] = int(plan.begin(np.array([sequence]))[0]) + offset + i
                at += n
        assert places == {token: k for k, token in enumerate(stream)}


def test_many_sources_share_pools(docs_of, monkeypatch):
    monkeypatch.setattr("askorpus.llm.windowpack.QUEUES", 2)
    monkeypatch.setattr("askorpus.llm.windowpack.POOLS", 3)
    got = [r.asDict() for r in pack_documents(docs_of([(k, "a b c", f"s{k % 17}") for k in range(80)]), PATH, length=32).collect()]
    assert full(windows(got), 32) and sum(r["size"] for r in got) == 80 * 4


def test_query_and_edges(spark, sf_dir, docs_of, table_dir, library):
    rows = [r.asDict() for r in op12_mixture_packing(spark, sf_dir).collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = dict(zip((d["doc_id"] for d in docs), expected(library, [d["text"] for d in docs])))
    for r in rows:
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"]:r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own)
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert full(windows(rows, "length", "offset"), 1024)
    sf = table_dir(documents=docs_of([(None, None), (1, "a"), (1, "a"), (2, "")]).selectExpr("*", "1 AS start", "'x' AS ids", "2 AS queue"))
    rows = op12_mixture_packing(spark, sf).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["length"]) for r in rows) == [(False, 1, 2), (False, 1, 2), (False, 2, 1), (True, None, 1)]
    assert op12_mixture_packing(spark, table_dir(documents=docs_of([]))).count() == 0


def test_special_of_the_core_is_ordinary_text(library):
    """The core looks for one special string, so not at every character, and never takes it as one."""
    encoder = Encoder(open(PATH, "rb").read())
    assert encoder.core.special_tokens_set
    texts = ["<|none|>", "a<|none|><|endoftext|>b <|none|>", "one two", "one\ntwo", "one\n two", "one\x0b\x0c two", "é  é", "one  two "]
    assert [[*encoder.ids(t), 0] for t in texts] == expected(library, texts)


def test_documents_of_a_queue_are_cut_together(monkeypatch):
    draw = random.Random(6)
    for cells in (1, 7, 1 << 18):
        monkeypatch.setattr("askorpus.llm.windowpack.CELLS", cells)
        plan = plan_rounds([900, 0, 333, 70, 5], draw.choice([None, [1, 1, 2, 0, 3]]), 32, 4)
        for queue, total in ((0, 900), (2, 333), (3, 70), (4, 5)):
            edges = sorted({0, total, *(draw.randrange(total) for _ in range(12))})
            order = draw.sample(range(len(edges) - 1), len(edges) - 1)
            start, end = np.array(edges)[order], np.array(edges)[np.array(order) + 1]
            of, *got = plan.pieces_of(queue, start, end - start)
            for k in range(len(order)):
                alone = plan.pieces(queue, int(start[k]), int(end[k] - start[k]))
                assert [x[of == k].tolist() for x in got] == [x.tolist() for x in alone]
