"""Shards: near-equal bytes, copies together, gapless slots; the tree against a plain one."""

import random
from collections import Counter, defaultdict

import pytest

from askorpus.llm.sharding import assign, op5_kdtree_shards, points, scaled, shard_documents


def brute(points, leaves, first=0):
    """points: (weight, dims, tie, key); the tree of the docstring, node by node."""
    if leaves == 1 or not points:
        return {p[3]: first for p in points}
    n = len(points[0][1])
    spread = [max(p[1][d] for p in points) - min(p[1][d] for p in points) for d in range(n)]
    dim = spread.index(max(spread))
    ordered = sorted(points, key=lambda p: (p[1][dim], p[2]))
    target = sum(p[0] for p in points) * (leaves // 2) / leaves
    below = 0
    for k, p in enumerate(ordered):
        if below + p[0] >= target:
            cut = k + 1 if below + p[0] - target <= target - below else k
            break
        below += p[0]
    return brute(ordered[:cut], leaves // 2, first) | brute(ordered[cut:], leaves - leaves // 2, first + leaves // 2)


@pytest.fixture
def docs(docs_of):
    draw = random.Random(2)
    texts = ["w" * draw.randrange(1, 400) + str(draw.randrange(10**9)) for _ in range(300)]
    return docs_of([(k, t, f"src{draw.randrange(4)}") for k, t in enumerate(texts)])


@pytest.mark.parametrize("leaves", [1, 2, 5, 16])
def test_same_tree_as_plain_recursion(docs, leaves):
    names = ["d_length", "d_id", "d_source", "d_lang"]
    rows = scaled(points(docs), names).collect()
    plain = [(r["weight"], [r[n] for n in names], r["k1"] % (1 << 32), (r["k1"], r["k2"])) for r in rows]
    want = brute(plain, leaves)
    assert {(r["k1"], r["k2"]): r["shard"] for r in assign(docs, leaves).collect()} == want


def test_contract(spark, table_dir, docs):
    rows = op5_kdtree_shards(spark, table_dir(documents=docs)).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_hot_group_gets_a_shard(docs_of):
    rows = [(k, f"t{k:03d}") for k in range(200)] + [(k, "copy") for k in range(200, 300)]
    got = shard_documents(docs_of(rows), 8).collect()
    own = {r["shard"] for r in got if r["text"] == "copy"}
    assert len(own) == 1 and not own & {r["shard"] for r in got if r["text"] != "copy"}
    rest = Counter(r["shard"] for r in got if r["text"] != "copy")
    assert len(rest) == 7 and max(rest.values()) - min(rest.values()) <= 4


def test_target_bytes(docs):
    got = shard_documents(docs, None, 5000).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += len(r["text"]) + 1
    assert len(sizes) == -(-sum(sizes.values()) // 5000) and max(sizes.values()) < 5900


def test_edges(spark, docs_of, table_dir):
    rows = [(None, None, None), (1, "", None), (1, "a"), (1, "a"), (2, "b" * 100000), (3, None)]
    df = docs_of(rows).selectExpr("*", "1 AS shard", "2 AS k1", "'x' AS node")
    got = shard_documents(df, 3)
    assert sorted(got.columns) == sorted(df.columns) and got.count() == 6
    assert len({r["shard"] for r in got.collect() if not r["text"]}) == 1
    out = op5_kdtree_shards(spark, table_dir(documents=docs_of(rows))).collect()
    assert len(out) == 6 and sum(r["size"] for r in out) == 6 + 2 + 100000
    assert op5_kdtree_shards(spark, table_dir(documents=docs_of([]))).count() == 0
