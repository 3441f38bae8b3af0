"""The trie of shared prefixes of conversations, from sorted sequences and their common prefixes.

A turn is known by 128 bits of its role and text, a conversation by its turns' keys laid end
to end, so that byte order puts prefixes first and conversations with a common prefix side by
side. Equal conversations form one class. Classes are dealt to blocks by ranges of keys. In a
block, L[i] is the number of turns that row i shares with the row before. Every L[i] is a
candidate prefix: it binary-searches its left and right extents independently, over a sparse
table of range minima of L, which gives the interval of its members without any stack; equal
intervals are one. An interval stands for the nodes from the depth that its neighbours share
down to its own, and what a row shares with neither neighbour is a path of its own. All
measures of a node are sums over its interval, taken from running sums. A prefix that goes on
in a neighbouring block is merged by key afterwards: a block has no more of them than its
first and last row have turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspark.llm.blocks import ragged
from cellspark.llm.storage import release, staged

#: Bytes of a turn's key.
WIDTH = 16
#: Turns of a block, about.
BLOCK = 1_000_000
#: Bytes of ids that travel as one piece.
PIECE = 1 << 20
#: How many conversations share the turns of one, and how many turns at most.
FAMILY, SHARED = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c``, ``turns`` (array of struct ``key``, in hex, and ``words``): each conversation's turns in order, nulls first; equal turn numbers are ordered by the md5 of role, then text.

    A null role or text is empty. Rows without a conversation are left out; other columns are not read.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("c"), F.col(turn_col).alias("t"), role.alias("r"), text.alias("x"))
    key = F.md5(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "x"))
    turn = F.struct("t", F.md5("r").alias("r"), F.md5("x").alias("x"), key.alias("key"), F.regexp_count("x", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    return rows.groupBy("c").agg(F.sort_array(F.collect_list(turn)).alias("all")).select("c", F.transform("all", lambda s: F.struct(s["key"].alias("key"), s["words"].alias("words"))).alias("turns"))


def share_heads(lists: DataFrame, family: int = FAMILY, most: int = SHARED) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % ``family``, h = crc32(c) % ``most``; remainders as in SQL."""
    h = (F.crc32(F.col("c").cast("string")) % most).cast("int")
    rows = lists.select("c", "turns", h.alias("h"), (F.col("c") - F.col("c") % family).alias("head"))
    heads = lists.where(F.col("c") % family == 0).select(F.col("c").alias("head"), F.slice("turns", 1, most - 1).alias("first"))
    none = F.slice("turns", 1, 0)
    return rows.join(heads, "head", "left").select("c", F.concat(F.coalesce(F.expr("slice(first, 1, h)"), none), F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], [*kinds])
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], [*kinds])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def classes(sequences: DataFrame, tasks: int) -> DataFrame:
    """``key, words, n, least, ends`` of ``sequences`` (``key``, ``words``, ``c``): equal ones as one row, with the digest of their ids.

    Ids are sorted over all tasks; each task joins neighbouring ids of a class to pieces, so
    that only pieces of a large class, not its rows, meet in one task, which reads them one
    after another.
    """
    kinds = {"key": pa.binary(), "words": pa.list_(pa.int64()), "least": pa.int64(), "n": pa.int64(), "ids": pa.binary()}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            key, words, ids = b"", [], []
            for k, w, c in _rows(batches):
                if ids and (k != key or len(ids) >= PIECE // 10):
                    yield key, words, ids[0], len(ids), ",".join(map(str, ids)).encode()
                    ids = []
                if not ids:
                    key, words = k, w
                ids.append(c)
            if ids:
                yield key, words, ids[0], len(ids), ",".join(map(str, ids)).encode()

        return _batches(pieces(), kinds)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple]:
            key, words, least, n, state = b"", [], 0, 0, None
            for k, w, first, count, ids in _rows(batches):
                if state is not None and k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        yield key, words, n, least, state.hexdigest()
                    key, words, least, n, state = k, w, first, 0, hashlib.sha256()
                state.update(ids)
                n += count
            if state is not None:
                yield key, words, n, least, state.hexdigest()

        return _batches(whole(), {"key": kinds["key"], "words": kinds["words"], "n": pa.int64(), "least": pa.int64(), "ends": pa.string()})

    pieces = sequences.select("key", "words", "c").repartitionByRange(tasks, "key", "c").sortWithinPartitions("key", "c").mapInArrow(join, "key binary, words array<bigint>, least bigint, n bigint, ids binary")
    return staged(pieces.repartition(tasks, "key").sortWithinPartitions("key", "least").mapInArrow(digest, "key binary, words array<bigint>, n bigint, least bigint, ends string"), "sequence-classes")


class Minima:
    """Range minima of an array in constant time each, from a table of minima over runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels, span = [values], 1
        while 2 * span <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-span], last[span:]))
            span *= 2
        size = np.array([len(x) for x in self.levels])
        self.first = np.cumsum(size) - size
        self.flat = np.concatenate(self.levels)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of ``values[low:high]``, none of them empty."""
        level = np.frexp((high - low).astype(float))[1] - 1
        at = self.first[level]
        return np.minimum(self.flat[at + low], self.flat[at + high - (1 << level)])


def extents(shared: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval around row ``at`` in which neighbours share ``depth`` turns or more; ``shared[i]`` is what row i shares with row i - 1. Both ends are binary searches of their own."""
    minima, n = Minima(shared), len(shared)
    low, high = np.zeros_like(at), at.copy()  # the first row is in [low, high]
    while (open_ := low < high).any():
        middle = (low + high) // 2
        held = np.ones(len(at), bool)
        held[open_] = minima(middle[open_] + 1, at[open_] + 1) >= depth[open_]
        high, low = np.where(open_ & held, middle, high), np.where(open_ & ~held, middle + 1, low)
    left = low
    low, high = at.copy(), np.full_like(at, n - 1)  # the last row is in [low, high]
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        held = np.ones(len(at), bool)
        held[open_] = minima(at[open_] + 1, middle[open_] + 1) >= depth[open_]
        low, high = np.where(open_ & held, middle, low), np.where(open_ & ~held, middle - 1, high)
    return left, low


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


def _chain(key: bytes) -> np.ndarray:
    """128 bits for each prefix of a key, the empty one first."""
    state, out = hashlib.sha256(), []
    for at in range(0, len(key) + 1, WIDTH):
        out.append(state.digest()[:WIDTH])
        state.update(key[at : at + WIDTH])
    return np.array([*out, None], object)[:-1]


def _common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys share; -1 where one is missing."""
    if a is None or b is None:
        return -1
    n, low = min(len(a), len(b)) // WIDTH, 0
    while low < n:
        middle = (low + n + 1) // 2
        low, n = (middle, n) if a[: middle * WIDTH] == b[: middle * WIDTH] else (low, middle - 1)
    return low


NODE = "node binary, parent binary, depth bigint, least bigint, parent_least bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string, open boolean"


def block_nodes(table: pa.Table, before: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """All nodes of a block of classes; ``before`` and ``after`` are the neighbouring rows' keys, None at either end of all rows.

    A node that goes on in a neighbouring block is ``open`` and has the block's part of each
    sum, and a key; a closed node under an open parent has the parent's key and no ``parent_least`` yet.
    """
    table = table.sort_by("key").combine_chunks()
    keys, rows = table.column("key").to_pylist(), table.num_rows
    n, least = table.column("n").to_numpy(), table.column("least").to_numpy()
    length = np.array([len(k) // WIDTH for k in keys], np.int64)
    # Running words of each row: cum[first[i] + d] are those of its first d turns.
    first = np.cumsum(length + 1) - (length + 1)
    flat = table.column("words").chunk(0).flatten().to_numpy()
    run = np.concatenate(([0], np.cumsum(flat)))
    begin = np.cumsum(length) - length
    cum = run[ragged(begin, length + 1)] - np.repeat(run[begin], length + 1)
    total = cum[first + length]
    # What a row shares with the row before it; the last entry is for the row after the block.
    shared = np.array([_common(a, b) for a, b in zip([before, *keys], [*keys, after])], np.int64)
    members, weighted, leaves = _running(n), _running(n * total), _running(shared[1:] < length)
    # Words of the nodes that begin in a row.
    fresh = _running(total - cum[first + np.maximum(shared[:-1], 0)])
    inside = shared.copy()
    inside[[0, -1]] = 0
    # Candidates: what neighbours share. Equal intervals are one; each has as many children that begin after its first row as candidates.
    at = np.flatnonzero(inside[:-1])
    left, right = extents(inside[:-1], at, inside[at])
    _, where, starts = np.unique(left * rows + right, return_index=True, return_counts=True)
    left, right, depth = left[where], right[where], inside[at][where]
    # Each row's own path, below what it shares with either side; and the root.
    own = np.flatnonzero(length > np.maximum(inside[:-1], inside[1:]))
    left, right, depth = np.concatenate((left, own, [0])), np.concatenate((right, own, [rows - 1])), np.concatenate((depth, length[own], [0]))
    starts = np.concatenate((starts, np.zeros(len(own), np.int64), [int((shared[1:-1] == 0).sum())]))
    # An interval's nodes: from the depth that its neighbours share down to its own.
    outer = np.maximum(inside[left], inside[right + 1])
    outer[-1] = -1
    levels = depth - outer
    which = np.repeat(np.arange(len(left)), levels)
    d = ragged(outer + 1, levels)
    l, r = left[which], right[which]
    count = members[r + 1] - members[l]
    above = cum[first[l] + np.maximum(d - 1, 0)]
    goes_back, goes_on = shared[l] >= d, shared[r + 1] >= d
    # Words of the distinct nodes from here down: those of the first row, and the fresh ones of the others.
    words = np.where(goes_back, total[l] - cum[first[l] + np.maximum(shared[l], 0)], total[l] - above) + fresh[r + 1] - fresh[l + 1]
    # A child begins in a row that goes deeper and shares no more than this depth with the row before.
    children = np.where(d == depth[which], starts[which], 0) + ((length[l] > d) & (shared[l] <= d))
    smallest, up = Minima(least), np.maximum(d - 1, 0)
    pl, pr = extents(inside[:-1], l, up)
    parent_back, parent_on = (shared[pl] >= up) & (d > 0), (shared[pr + 1] >= up) & (d > 0)
    # An open prefix is one of the first or the last row.
    low, high = _chain(keys[0]), _chain(keys[-1])
    node = np.where(goes_back, low[np.where(goes_back, d, 0)], np.where(goes_on, high[np.where(goes_on, d, 0)], None))
    parent = np.where(parent_back, low[np.where(parent_back, up, 0)], np.where(parent_on, high[np.where(parent_on, up, 0)], None))
    terminal = length[l] == d
    ends = table.column("ends").take(pa.array(np.where(terminal, l, None), pa.int64())).combine_chunks()
    columns = [
        pa.array(node, pa.binary()), pa.array(parent, pa.binary()), pa.array(d), pa.array(smallest(l, r + 1)), pa.array(smallest(pl, pr + 1), mask=parent_back | parent_on | (d == 0)),
        pa.array(count), pa.array(children.astype(np.int64)), pa.array(leaves[r + 1] - leaves[l]), pa.array(weighted[r + 1] - weighted[l] - count * above - words), ends, pa.array(goes_back | goes_on),
    ]
    return pa.record_batch(columns, [x.split()[0] for x in NODE.split(", ")])


def prefix_trie(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct prefix of the conversations ``lists`` (``c``, ``turns``), the empty one included.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. Conversations without turns are members of the root.
    Without any conversation there is no row. A conversation's turns (24 bytes each) must fit
    into a task, and a block's: about ``block`` turns and one conversation more.
    """
    key = F.unhex(F.array_join("turns.key", ""))
    sequences = staged(lists.select(key.alias("key"), F.col("turns.words").alias("words"), "c"), "sequences")
    size = sequences.agg(F.sum(F.size("words") + 1).alias("turns")).first()
    tasks = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size.turns or 0) // block))
    each = classes(sequences, tasks)
    dealt = staged(each.repartitionByRange(tasks, "key").withColumn("block", F.spark_partition_id()), "trie-blocks")
    release(sequences, each)
    # One row for each block: the keys beside it.
    rims = dealt.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("block")
    rims = rims.select("block", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))

    def nodes(left: pa.Table, right: pa.Table) -> pa.Table:
        before, after = (right.column(c)[0].as_py() for c in ("before", "after"))
        return pa.Table.from_batches([block_nodes(left, before, after)])

    made = staged(dealt.groupBy("block").cogroup(rims.groupBy("block")).applyInArrow(nodes, NODE), "trie-nodes")
    release(dealt)
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    spread = made.where("open or depth = 0").groupBy("depth", "node")
    # The root is in every block, and open but in a table of one block.
    merged = staged(spread.agg(F.first("parent").alias("parent"), F.min("least").alias("least"), *sums, F.max("ends").alias("ends")), "trie-open")
    above = merged.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("up"))
    columns = ["depth", "parent", "least", "parent_least", "n", "children", "leaves", "saved", "ends"]
    closed = made.where("not open and depth > 0").select(columns)
    waiting = closed.where("parent_least is null").unionByName(merged.withColumn("parent_least", F.lit(None).cast("bigint")).select(columns))
    named = waiting.join(above, ["depth", "parent"], "left").select("depth", "least", F.col("up").alias("parent_least"), "n", "children", "leaves", "saved", "ends")
    done = closed.where("parent_least is not null").drop("parent").unionByName(named)
    return done.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op12_rows(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt with shared heads; a null turn comes first, null roles and texts are empty, rows with a null id belong to no conversation, other columns are not read."""
    return prefix_trie(share_heads(turn_lists(conversations)))


#: The same in SQL: all prefixes of all conversations, grouped; subtrees by joining nodes with their prefixes.
ORACLE = r"""
WITH lists AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda acc, b: list_reduce(range(8), lambda a, j: xor(a >> 1, 3988292384 * (a & 1)), xor(acc, b)), 4294967295::BIGINT), 4294967295) % 4 AS h
  FROM lists
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM hashed a LEFT JOIN lists b ON b.c = a.c - a.c % 20
), prefixes AS (
  SELECT c, d, s[1:d] AS k, d = len(s) AS whole FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (whole), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].x, '[^\x20\x09-\x0D]+')) END AS words
  FROM prefixes GROUP BY d, k
), children AS (
  SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS children FROM nodes WHERE d > 0 GROUP BY 1, 2
), every AS (
  SELECT n.*, coalesce(children, 0) AS children FROM nodes n LEFT JOIN children USING (d, k)
), below AS (
  SELECT e AS d, k[1:e] AS k, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM every) GROUP BY 1, 2
)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, a.children AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM every a JOIN below b USING (d, k) LEFT JOIN nodes p ON p.d = a.d - 1 AND p.k = a.k[1:a.d - 1]
"""
