"""Removal of word passages that occur more than once in a corpus, by prefix-partitioned suffix trees.

The suffixes of all texts, one for each word with ``window`` words from there on, are split
by prefix into groups that fit into one task's memory. A prefix is ``GRAM`` words that the
suffix itself chooses, those of the smallest hash among its first ``window`` words: equal
suffixes choose alike, and neighbouring ones mostly do, so that a run of them travels as one
stretch of words. Prefixes are counted first. One that occurs once ends in a leaf, and its
suffixes go nowhere; one with more than ``MOST`` suffixes is lengthened to all ``window``
words. Each group's suffixes are sorted by their words (prefix doubling down to depth
``window``, the words themselves compared): suffixes that share a node there are leaves of
an internal node, a repeat, and neighbouring repeats make up the maximal ones. A task first
looks for equal runs among its own, and sends each once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspark.llm import blocks
from cellspark.llm.lattice import cut as pieces
from cellspark.llm.simhash import whole_groups

GRAM = 8
#: Suffixes of a group; larger groups have longer prefixes.
MOST = 200_000
#: Bytes of runs that a task remembers to find equal ones.
GATHER = 32_000_000
#: Compression of texts on their way.
CODEC = "zstd"
_ODD = np.uint64(0xD6E8FEB86659FD93)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have, span = values, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(values) - width + 1], have[rest : len(values) - width + 1 + rest])


def suffixes(buf: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word in it, place of that word and prefix of every suffix of a block; and the hash of the ``GRAM`` words from every place."""
    starts, ends, first = blocks.words(buf, offsets)
    n = np.diff(first)
    many = np.maximum(n - window + 1, 0)
    if not many.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    words = blocks.byte_hashes(buf, starts, ends)
    at = blocks.ragged(first[:-1], many)
    i = np.arange(len(words) - GRAM + 1)
    grams = blocks.span_hashes(words, i, i + GRAM)
    doc = np.repeat(np.arange(len(n)), many)
    return doc, at - first[:-1][doc], at, smallest(grams, window - GRAM + 1)[at], grams


def stretches(flag: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of set flags inside one run."""
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on
    new = np.concatenate(([True], (np.diff(on) > 1) | (np.diff(run[on]) != 0)))
    firsts = np.flatnonzero(new)
    return on[firsts], on[np.append(firsts[1:], len(on)) - 1]


def repeats(codes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether the ``window`` words from each start occur at another start too: ranks of ever longer prefixes, each from two shorter ones."""
    rank, span = codes.astype(np.int64), 1

    def longer(step: int) -> np.ndarray:
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - step] = rank[step:]
        return np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1]

    while span * 2 <= window:
        rank, span = longer(span), span * 2
    if span < window:
        rank = longer(window - span)
    leaf = rank[starts]
    return np.bincount(leaf)[leaf] > 1


def _keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that name a row by its content: equal rows may share them, as they share the result."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(7), text_col, id_col).alias("k2")]


def _runs(rows: DataFrame, window: int) -> DataFrame:
    """``prefix, k1, k2, lo, hi, again``: neighbouring suffixes of a row with the same prefix, first and last start, and whether their words have the prefix in several places."""

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, start, at, prefix, grams = suffixes(*blocks.layout(part.column("text")), window)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (prefix[1:] != prefix[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc))[: len(first)] - 1
        spread = last - first + window - GRAM + 1
        here = grams[blocks.ragged(at[first], spread)] == np.repeat(prefix[first], spread)
        again = np.add.reduceat(here, np.cumsum(spread) - spread, dtype=np.int64) > 1 if len(first) else np.zeros(0, bool)
        who = pa.array(doc[first])
        columns = [pa.array(prefix[first].view(np.int64)), part.column("k1").take(who), part.column("k2").take(who), pa.array(start[first].astype(np.int32)), pa.array(start[last].astype(np.int32)), pa.array(again)]
        return pa.record_batch(columns, ["prefix", "k1", "k2", "lo", "hi", "again"])

    return rows.select("k1", "k2", "text").mapInArrow(blocks.in_blocks(find), "prefix bigint, k1 bigint, k2 bigint, lo int, hi int, again boolean")


def _packed(rows: DataFrame, *others: str) -> DataFrame:
    """``k1, k2, packed`` and the columns of ``others``: texts compressed, each with its size in front."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = blocks.layout(part.column("text"))
        data = buf.tobytes()
        small = [b"" if a == b else int(b - a).to_bytes(8, "little") + pa.compress(data[a:b], CODEC, asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.record_batch([*[part.column(c) for c in ("k1", "k2", *others)], pa.array(small, pa.binary())], ["k1", "k2", *others, "packed"])

    schema = rows.select("k1", "k2", *others).schema.add("packed", "binary")
    return rows.select("k1", "k2", *others, "text").mapInArrow(blocks.in_blocks(run), schema)


def _unpacked(packed: pa.Array) -> pa.Array:
    texts = [b"" if not x else pa.decompress(x[8:], int.from_bytes(x[:8], "little"), CODEC, asbytes=True) for x in packed.to_pylist()]
    return pa.array(texts, pa.large_binary())


def repeat_ranges(rows: DataFrame, window: int) -> DataFrame:
    """``k1, k2, lo, hi``: ranges of first words of repeated windows, by row key."""
    size = F.col("hi") - F.col("lo") + 1
    runs = _runs(rows, window)
    # A prefix in one place of one run ends in a leaf.
    counted = runs.groupBy("prefix").agg(F.count("*").alias("runs"), F.sum(size).alias("suffixes"), F.bool_or("again").alias("again")).where((F.col("runs") > 1) | F.col("again"))
    wanted = runs.join(counted.select("prefix", (F.col("suffixes") > MOST).alias("long")), "prefix").groupBy("k1", "k2").agg(F.collect_set(F.struct("prefix", "lo", "hi", "long")).alias("runs"))
    chosen = _packed(rows).join(wanted, ["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], tuple | None] = {}
        held = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "k1", "k2", "lo", "hi", "words"])

        for part in blocks.slices(batches, "packed", blocks.BLOCK_BYTES // 4):
            buf, offsets = blocks.layout(_unpacked(part.column("packed")))
            starts, ends, first = blocks.words(buf, offsets)
            flat, begin, end = blocks.squeeze(buf, starts, ends)
            data, lists = flat.tobytes(), part.column("runs")
            field = {n: lists.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("prefix", "lo", "hi", "long")}
            doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            lo, hi = field["lo"].astype(np.int64), field["hi"].astype(np.int64)
            # Suffixes with long prefixes go one by one.
            times = np.where(field["long"], hi - lo + 1, 1)
            which = np.repeat(np.arange(len(lo)), times)
            long, doc = field["long"][which], doc[which]
            lo = lo[which] + np.where(long, blocks.ragged(np.zeros(len(times), np.int64), times), 0)
            hi = np.where(long, lo, hi[which])
            at, to = first[doc] + lo, first[doc] + hi + window
            key = field["prefix"][which]
            if long.any():
                hashes = blocks.byte_hashes(buf, starts, ends)
                key[long] = blocks.span_hashes(hashes * _ODD, at[long], to[long]).view(np.int64)
            k1, k2 = part.column("k1").to_numpy()[doc].tolist(), part.column("k2").to_numpy()[doc].tolist()
            rows: list[tuple] = []
            for k, a, b, x, y, i, j in zip(key.tolist(), k1, k2, lo.tolist(), hi.tolist(), begin[at].tolist(), end[to - 1].tolist()):
                words = data[i:j]
                if (k, words) not in seen:
                    seen[k, words] = (a, b, x, y)
                    held += len(words)
                    rows.append((k, a, b, x, y, words))
                    continue
                # The first one's range is known from the second on.
                if known := seen[k, words]:
                    rows.append((known[0], *known, None))
                    seen[k, words] = None
                rows.append((a, a, b, x, y, None))
            for i in range(0, len(rows), 20_000):
                yield out(rows[i : i + 20_000])
            if held > GATHER:
                seen.clear()
                held = 0

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "lo", "hi"]
        for _, k1, k2, lo, hi, words in whole_groups(batches, 20_000):
            known = np.array([w is None for w in words])
            if known.any():
                yield pa.record_batch([pa.array(c[known]) for c in (k1, k2, lo, hi)], names)
            runs = np.flatnonzero(~known)
            if len(runs) < 1:
                continue
            buf, offsets = blocks.layout(pa.array(words[runs], pa.large_binary()))
            starts, ends, first = blocks.words(buf, offsets)
            codes = pieces(buf, starts, ends).dictionary_encode().indices.to_numpy()
            n = (hi - lo)[runs].astype(np.int64) + 1
            run = np.repeat(np.arange(len(runs)), n)
            a, b = stretches(repeats(codes, blocks.ragged(first[:-1], n), window), run)
            if len(a):
                r, begin = run[a], np.cumsum(n) - n
                low = lo[runs][r]
                yield pa.record_batch([pa.array(k1[runs][r]), pa.array(k2[runs][r]), pa.array((low + a - begin[r]).astype(np.int32)), pa.array((low + b - begin[r]).astype(np.int32))], names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.mapInArrow(cut, "key bigint, k1 bigint, k2 bigint, lo int, hi int, words binary")
    return dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sort, "k1 bigint, k2 bigint, lo int, hi int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for each row of ``docs``.

    A word goes if it lies in a window of ``window`` words whose sequence also starts
    anywhere else in the table, the same row included; windows are judged on the input.
    ``kept_text`` is the other words joined by a space. A null, empty or short text keeps
    all its words; repeated rows are repeats of each other; an empty table gives an empty
    result; other columns are not read.
    """
    text = F.col(text_col).cast("string").alias("text")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text).select("*", *_keys("doc_id", "text"))
    ranges = repeat_ranges(rows, window).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = _packed(rows, "doc_id").join(ranges, ["k1", "k2"], "left").select("doc_id", "packed", "ranges")

    def rebuild(part: pa.RecordBatch) -> pa.RecordBatch:
        starts, ends, first = blocks.words(*(layout := blocks.layout(_unpacked(part.column("packed")))))
        change = np.zeros(len(starts) + 1, np.int64)
        ranges = part.column("ranges")
        flat = ranges.flatten()
        if len(flat):
            owner = np.repeat(np.arange(part.num_rows), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            np.add.at(change, first[owner] + flat.field("lo").to_numpy(), 1)
            np.add.at(change, first[owner] + flat.field("hi").to_numpy() + window, -1)
        kept = np.cumsum(change[:-1]) == 0
        left = np.concatenate(([0], np.cumsum(kept)))[first]
        flat_text, s, e = blocks.squeeze(layout[0], starts[kept], ends[kept])
        data = flat_text.tobytes()
        texts = [data[s[a] : e[b - 1]] if b > a else b"" for a, b in zip(left[:-1], left[1:])]
        n = np.diff(first)
        return pa.record_batch(
            [part.column("doc_id"), pa.array(n), pa.array(n - np.diff(left)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        )

    return joined.mapInArrow(blocks.in_blocks(rebuild, "packed", blocks.BLOCK_BYTES // 4), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
