"""The conversation prefix tree against a tree of Python dictionaries."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as contract
from footfall.llm import tries


def conversations(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            out[conv_id].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def plain_tree(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * (len(node[-1][1]) if node else 0)
    rows = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(node))
        rows.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=str) == expected


@pytest.fixture(scope="module")
def hard(spark):
    """Few different turns, so that beginnings are shared; missing, equal and repeated turns; rows without a number."""
    rng = random.Random(3)
    rows = [(c, rng.choice([None, t, t]), rng.choice("ua"), rng.choice(["x", "yy", None, "zzz", "é\U0001f600"])) for c in [*range(-20, 300), None, 10**12] for t in range(rng.choice([0, 1, 2, 3, 5, 9, 20]))]
    rows += [(7000 + i, t, "user", "hello") for i in range(60) for t in range(3)] + [(8000, t, "user", f"{t}") for t in range(300)] + rows[:5]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("family, shard", [(20_000, 400_000), (30, 200), (3, 50), (1, 20)])
def test_hard_rows(hard, family, shard):
    rows, df = hard
    same(tries.prefix_tree(tries.sequences(df), family, shard), plain_tree(conversations(rows)))
    same(tries.prefix_tree(tries.with_shared_starts(tries.sequences(df)), family, shard), plain_tree(rebuilt(conversations(rows))))


def test_other_columns_and_partitions_change_nothing(hard):
    rows, df = hard
    for name in ("turns", "key", "of", "n", "shard", "depth", "a b.c", "id"):
        df = df.withColumn(name, df.role)
    same(tries.prefix_tree(tries.sequences(df.repartition(7)), 30, 200), plain_tree(conversations(rows)))


def test_no_rows_and_no_turns(hard):
    _, df = hard
    assert tries.prefix_tree(tries.with_shared_starts(tries.sequences(df.limit(0)))).collect() == []
    nothing = tries.sequences(df).limit(3).selectExpr("conv_id", f"cast(array() as {tries.SEQUENCE}) as turns")
    (root,) = tries.prefix_tree(nothing).collect()
    assert (root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (0, None, 3, 0, 1, 0)


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK_BITS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(c, t, "u", f"{t}") for c in range(200) for t in range(2)] + [(c, 0, "u", "other") for c in range(200, 240)]
        same(tries.prefix_tree(tries.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), plain_tree(conversations(rows)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_against_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(contract.queries()["op13_conversation_tree"](spark, sf_dir), plain_tree(rebuilt(conversations(rows))))


def test_double_array_walks_what_was_added():
    rng = np.random.default_rng(1)
    trie, tree = tries.DoubleArray(4), {(): 0}
    level = [()]
    for _ in range(6):
        edges = sorted({(tree[node], int(s), node) for node in level for s in rng.choice(50, rng.integers(1, 6), replace=False)})
        if not edges:
            break
        places = trie.add(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
        level = [(*node, s) for _, s, node in edges]
        tree |= dict(zip(level, places.tolist()))
    assert len(set(tree.values())) == len(tree) > 100
    for node, place in tree.items():
        for s in range(50):
            assert trie.walk(np.array([place]), np.array([s]))[0] == tree.get((*node, s), -1)
