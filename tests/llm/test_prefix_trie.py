"""The prefix trie against SQL and plain loops: several blocks, hot prefixes, long, empty and repeated conversations."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF, canonical

from cellspark.llm import prefix_trie
from cellspark.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, words int, key string"


def test_equals_sql(spark, duck):
    got, want = canonical(QUERIES["op12_prefix_trie"](spark, SF).toPandas()), canonical(duck.sql(ORACLES["op12_prefix_trie"]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def rows_like_sql(rows):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "words", "key"]))
    con.sql("CREATE VIEW conversations AS SELECT conv_id::BIGINT conv_id, turn::BIGINT turn, role, text FROM given")
    return canonical(con.sql(prefix_trie.ORACLE).df())


def made_up(seed, n):
    """Few different turns, so that many conversations share prefixes or are equal; one in three begins with a hot turn."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        size = rng.choice([0, 1, 1, 2, 3, 4, 9, 30])
        texts = [rng.choice(["a", "a b", "a b  c", None, ""]) for _ in range(size)]
        if c % 3 == 0 and texts:
            texts[0] = "hot first turn"
        rows += [(c * 7 % 101 if seed else c, t if t else None, rng.choice(["user", None]), x, 3, "k") for t, x in enumerate(texts)]
    return rows + [(None, 0, "user", "nobody's", 3, "k")] + rows[:3]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_odd_conversations(spark, seed):
    rows = made_up(seed, 150)
    got = canonical(prefix_trie.op12_rows(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas())
    pd.testing.assert_frame_equal(got, rows_like_sql(rows), check_dtype=False)


@pytest.mark.parametrize("block", [300, 100_000])
def test_blocks(spark, block):
    """Blocks of any size give the same rows: equal conversations of a third of all, prefixes of one another, one of 3,000 turns."""
    rng = random.Random(5)
    lists = {c: [f"{rng.randrange(2)}" for _ in range(rng.randrange(6))] for c in range(200)}
    lists |= {c: ["same", "again"] for c in range(200, 300)} | {c: ["hot", str(c)] for c in range(300, 350)} | {400: ["hot"] * 3000, 401: ["hot"] * 2999}
    turns = [(c, [(hashlib.md5(x.encode()).hexdigest(), len(x)) for x in t]) for c, t in lists.items()]
    got = prefix_trie.prefix_trie(spark.createDataFrame(turns, "c bigint, turns array<struct<key: string, words: bigint>>"), block).collect()
    members = collections.defaultdict(list)
    for c, t in lists.items():
        for d in range(len(t) + 1):
            members[hash(tuple(t[:d])) if d > 10 else tuple(t[:d]), d].append((c, len(t), len(t[d - 1]) if d else 0, hash(tuple(t[: d - 1])) if d > 11 else tuple(t[: d - 1])))
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for (k, d), m in sorted(members.items(), key=lambda x: -x[0][1]):
        here = k, d
        leaves[here] += not children[here]
        saved[here] += (len(m) - 1) * m[0][2]
        if d:
            parent = m[0][3], d - 1
            children[parent] += 1
            leaves[parent] += leaves[here]
            saved[parent] += saved[here]
    want = [
        (min(m)[0], d, min(members[m[0][3], d - 1])[0] if d else None, len(m), children[k, d], leaves[k, d], saved[k, d], hashlib.sha256(",".join(str(c) for c, n, *_ in sorted(m) if n == d).encode()).hexdigest())
        for (k, d), m in members.items()
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_rows(spark):
    assert prefix_trie.op12_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = spark.createDataFrame([(5, []), (3, [])], "c bigint, turns array<struct<key: string, words: bigint>>")
    (root,) = prefix_trie.prefix_trie(empty).collect()
    assert tuple(root) == (3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())


def test_heads(spark):
    """A head's turns are those of the original conversation; an absent one gives none."""
    rows = [(c, t, "user", f"{c}-{t}", 0, "") for c in (*range(20, 40), 45, 46) for t in range(2)]
    lists = {r.c: [x.key for x in r.turns] for r in prefix_trie.turn_lists(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = {r.c: [x.key for x in r.turns] for r in prefix_trie.share_heads(prefix_trie.turn_lists(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c in lists:
        h = zlib.crc32(str(c).encode()) % 4
        assert got[c] == lists.get(c - c % 20, [])[:h] + lists[c][h:]


def test_extents():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50):
        shared = rng.integers(0, 4, n)
        at, depth = rng.integers(0, n, 200), rng.integers(0, 5, 200)
        left, right = prefix_trie.extents(shared, at, depth)
        for i, d, a, b in zip(at, depth, left, right):
            low, high = i, i
            while low and shared[low] >= d:
                low -= 1
            while high + 1 < n and shared[high + 1] >= d:
                high += 1
            assert (a, b) == (low, high)
