"""Subword lattices over a fixed public vocabulary: marginal word probabilities and EM.

A word is the bytes of a space and the word; its lattice has an edge for every substring
that is a piece of the vocabulary, found exactly by a walk down the trie of pieces. A word's probability sums all segmentations (forward
recursion in log space); expected piece counts come from forward and backward together.
All single bytes are pieces, so every word has a segmentation.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.llm import blocks

#: Bytes of words that are worked on at once.
CHUNK = 65_536
#: Words with more bytes are summed edge by edge, one word after another.
LONG = 2048


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Lattice:
    """Pieces of a vocabulary file in the ``tiktoken`` rank format that can occur in a word: without white space but for one space in front.

    They form a trie. Nodes are numbered by depth, parent and byte, so that a node's children
    are neighbours: a node has 256 bits that say which bytes go on, in four words, and for each
    word the number of the first child.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
        usable = {p for p in pieces if p and not blocks.SPACE[np.frombuffer(p[1:] or b"x", np.uint8)].any()} | {bytes([b]) for b in range(256)}
        self.pieces = sorted(usable)
        size = np.array([len(p) for p in self.pieces])
        self.longest = int(size.max())
        table = np.zeros((len(size), self.longest), np.int64)
        table[np.repeat(np.arange(len(size)), size), blocks.ragged(np.zeros(len(size), np.int64), size)] = np.frombuffer(b"".join(self.pieces), np.uint8)
        node, nodes, keys = np.zeros(len(size), np.int64), 1, []
        ends = [np.array([-1])]
        for depth in range(self.longest):
            on = np.flatnonzero(size > depth)
            key, inverse = np.unique(node[on] << 8 | table[on, depth], return_inverse=True)
            node[on] = nodes + inverse
            keys.append(key)
            nodes += len(key)
            end = np.full(len(key), -1)
            last = on[size[on] == depth + 1]
            end[node[last] - (nodes - len(key))] = last
            ends.append(end)
        self.piece = np.concatenate(ends).astype(np.int32)
        key = np.concatenate(keys)
        word = key >> 6
        self.bits = np.zeros(nodes * 4, np.uint64)
        np.bitwise_or.at(self.bits, word, np.uint64(1) << (key & 63).astype(np.uint64))
        self.child = np.zeros(nodes * 4, np.int32)
        words, first = np.unique(word, return_index=True)
        self.child[words] = first + 1

    def __len__(self) -> int:
        return len(self.pieces)

    def edges(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every piece in ``flat`` that begins at a position and does not pass that position's end."""
        at = np.arange(len(ends))
        node = np.zeros(len(ends), np.int64)
        out = []
        for depth in range(self.longest):
            byte = flat[at + depth].astype(np.int64)
            word = node * 4 + (byte >> 6)
            bit, have = np.uint64(1) << (byte & 63).astype(np.uint64), self.bits[word]
            hit = np.flatnonzero(have & bit)
            node = self.child[word[hit]] + np.bitwise_count(have[hit] & (bit[hit] - np.uint64(1))).astype(np.int64)
            at = at[hit]
            piece = self.piece[node]
            full = np.flatnonzero(piece >= 0)
            out.append((at[full], np.full(len(full), depth + 1), piece[full]))
            on = np.flatnonzero(ends[at] > at + depth + 1)
            at, node = at[on], node[on]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out))

    def _chunks(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words by falling length, a space in front of each: their numbers, bytes and lengths. Long words come one by one, others in chunks of some ``CHUNK`` bytes."""
        buf, offsets = blocks.layout(words)
        order = np.argsort(-np.diff(offsets), kind="stable")
        size = np.diff(offsets)[order] + 1
        long = int(np.searchsorted(-size, -LONG))
        share = np.cumsum(size[long:]) // CHUNK
        cuts = np.concatenate((np.arange(1, long + 1), long + 1 + np.flatnonzero(np.diff(share))))
        for part in np.split(np.arange(len(order)), cuts):
            if len(part):
                pick, n = order[part], size[part]
                flat = np.full(int(n.sum()), 32, np.uint8)
                flat[blocks.ragged(np.cumsum(n) - n + 1, n - 1)] = buf[blocks.ragged(offsets[pick], n - 1)]
                yield pick, flat, n

    def score(self, words: pa.Array, logp: np.ndarray) -> np.ndarray:
        """Natural-log marginal probabilities [word, model] for ``logp`` [model, piece]."""
        out = np.zeros((len(words), len(logp)))
        for pick, flat, size in self._chunks(words):
            if size[0] > LONG:
                out[pick[0]] = [self._one(flat, x)[-1] for x in logp]
            else:
                steps = Steps(self, flat, size)
                out[pick] = steps.forward(logp.T)[steps.first + size]
        return out

    def expected(self, words: pa.Array, weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations, words weighted."""
        counts = np.zeros(len(self))
        for pick, flat, size in self._chunks(words):
            if size[0] > LONG:
                alpha, beta = self._one(flat, logp), self._one(flat, logp, True)
                for start, length, piece in self._parts(flat):
                    p = np.exp(alpha[start] + logp[piece] + beta[start + length] - alpha[-1])
                    counts += np.bincount(piece, weights[pick[0]] * p, len(self))
            else:
                steps = Steps(self, flat, size)
                alpha, beta = steps.forward(logp[:, None])[:, 0], steps.backward(logp)
                whole = alpha[steps.first + size]
                p = np.exp(alpha[steps.start] + logp[steps.piece] + beta[steps.end] - whole[steps.lane])
                counts += np.bincount(steps.piece, weights[pick][steps.lane] * p, len(self))
        return counts

    def _parts(self, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The edges of one word of any length, by ranges of their starts."""
        for low in range(0, len(word), CHUNK):
            high = min(len(word), low + CHUNK)
            part = word[low : high + self.longest]
            start, length, piece = self.edges(part, np.full(high - low, len(part)))
            yield start + low, length, piece

    def _one(self, word: np.ndarray, logp: np.ndarray, backward: bool = False) -> np.ndarray:
        """Forward (or backward) log sums at all positions of one word, edge by edge: time in proportion to its length."""
        n = len(word)
        out = np.full(n + 1, -np.inf)
        done = [0.0]  # sums at the last ``longest`` positions and all of this part, the newest last
        out[n if backward else 0] = 0
        parts = list(range(0, n, CHUNK))
        for low in reversed(parts) if backward else parts:
            high = min(n, low + CHUNK)
            if backward:
                begin, part = low, word[low : high + self.longest]
                start, length, piece = self.edges(part, np.full(high - low, len(part)))
                near = start
            else:
                begin = max(0, low + 1 - self.longest)
                part = word[begin:high]
                start, length, piece = self.edges(part, np.full(len(part), len(part)))
                near = start + length + begin - low - 1
                inside = near >= 0
                near, length, piece = near[inside], length[inside], piece[inside]
            order = np.argsort(near, kind="stable")
            cuts = np.searchsorted(near[order], np.arange(high - low + 1)).tolist()
            length, weight = length[order].tolist(), logp[piece[order]].tolist()
            places = range(high - low)
            for k in reversed(places) if backward else places:
                a, b = cuts[k], cuts[k + 1]
                sums = [weight[j] + done[-length[j]] for j in range(a, b)]
                top = max(sums)
                done.append(top + math.log(sum([math.exp(x - top) for x in sums])) if b - a > 1 else top)
            fresh = np.array(done[-(high - low) :])
            if backward:
                out[low:high] = fresh[::-1]
            else:
                out[low + 1 : high + 1] = fresh
            del done[: -self.longest]
        return out


class Steps:
    """Lattices of many words side by side: one step sums all edges that end (or start) at one place of each word.

    Positions of all words lie end to end, one more than bytes for each word.
    """

    def __init__(self, grid: Lattice, flat: np.ndarray, size: np.ndarray):
        lane = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        self.first = begin + np.arange(len(size))
        self.size, self.total = size, len(flat) + len(size)
        start, length, self.piece = grid.edges(flat, (begin + size)[lane])
        self.lane = lane[start]
        place = start - begin[self.lane]
        self.start = self.first[self.lane] + place
        self.end = self.start + length
        self.place, self.length = place, length

    def _sweep(self, place: np.ndarray, to: np.ndarray, via: np.ndarray, logp: np.ndarray, sums: np.ndarray, back: bool) -> None:
        lanes = len(self.size)
        order = np.argsort(place * lanes + self.lane)
        place, to, via = place[order], to[order], via[order]
        piece = self.piece[order]
        fresh = np.flatnonzero(np.diff(to, prepend=-1))
        steps = np.arange(int(self.size[0]) + 2)
        at, cuts = np.searchsorted(place, steps), np.searchsorted(place[fresh], steps)
        places = range(int(self.size[0]) + 1)
        for t in reversed(places) if back else places:
            a, b = at[t], at[t + 1]
            if a < b:
                groups = fresh[cuts[t] : cuts[t + 1]]
                sums[to[groups]] = np.logaddexp.reduceat(logp[piece[a:b]] + sums[via[a:b]], groups - a, axis=0)

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log sums [position, model] over all ways from a word's start, for ``logp`` [piece, model]."""
        sums = np.full((self.total, logp.shape[1]), -np.inf)
        sums[self.first] = 0
        self._sweep(self.place + self.length, self.end, self.start, logp, sums, False)
        return sums

    def backward(self, logp: np.ndarray) -> np.ndarray:
        """Log sums [position] over all ways to a word's end."""
        sums = np.full(self.total, -np.inf)
        sums[self.first + self.size] = 0
        self._sweep(self.place, self.start, self.end, logp, sums, True)
        return sums


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One per vocabulary file and process."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


class Lookup:
    """Values (several for each key) kept by 64-bit hash between the blocks of one task; emptied when it holds ``most`` keys."""

    def __init__(self, width: int, most: int = 500_000):
        self.most, self.width = most, width
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, width))

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the distinct, sorted ``keys`` are not held."""
        if not len(self.keys):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values, axis=0)

    def get(self, keys: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.keys, keys)]

    def trim(self) -> None:
        if len(self.keys) > self.most:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, self.width))


def lowered_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, word starts and ends, first word of each document, word hashes."""
    buf, offsets = blocks.layout(column)
    buf = blocks.LOWER[buf]
    starts, ends, first = blocks.words(buf, offsets)
    return buf, starts, ends, first, blocks.byte_hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)


def cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a binary array."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = buf[blocks.ragged(starts, size)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Tally:
    """Word types with counts, gathered over the blocks of a task."""

    def __init__(self, width: int, most: int = 1_000_000):
        self.most, self.width, self.held, self.size = most, width, [], 0

    def add(self, hashes: np.ndarray, words: pa.Array, counts: np.ndarray) -> None:
        self.held.append((hashes, words, counts))
        self.size += len(hashes)

    def merge(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        hashes = np.concatenate([x[0] for x in self.held])
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.zeros((len(keys), self.width), np.int64)
        np.add.at(counts, inverse, np.concatenate([x[2] for x in self.held]))
        merged = keys, pa.concat_arrays([x[1] for x in self.held]).take(pa.array(first)), counts
        self.held, self.size = [merged], len(keys)
        return merged

    def full(self) -> bool:
        """After merging, whether it is time to hand the types on."""
        return self.size > 2 * self.most and len(self.merge()[0]) > self.most


def distinct_counts(hashes: np.ndarray, groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, a place of each, and how often each occurs with group 0, 1, … (-1: not counted)."""
    keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.zeros((len(keys), width), np.int64)
    for g in range(width):
        counts[:, g] = np.bincount(inverse[groups == g], minlength=len(keys))
    return keys, first, counts


def estimate(types: DataFrame, groups: int, path: str, rounds: int = 2, prior: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Log piece probabilities [group, piece], and expected pieces of each group, by EM over ``types`` (``word BINARY, counts ARRAY<BIGINT>``, one count for each group).

    What comes to the driver is the model: groups times pieces. The first round starts from
    equal probabilities; ``prior`` is added to each piece's expected count.
    """
    n = len(lattice(path))
    logp = np.full((groups, n), -np.log(n))
    for _ in range(rounds):
        model = logp

        @blocks.lean
        def expect(batches: Iterator[pa.RecordBatch], model: np.ndarray = model) -> Iterator[pa.RecordBatch]:
            grid, total = lattice(path), np.zeros((groups, n))
            for batch in batches:
                counts = np.array(batch.column("counts").to_pylist(), np.float64).reshape(-1, groups)
                for g in range(groups):
                    some = np.flatnonzero(counts[:, g])
                    if len(some):
                        total[g] += grid.expected(pc.take(batch.column("word"), pa.array(some)), counts[some, g], model[g])
            g, piece = np.nonzero(total)
            yield pa.record_batch([pa.array(g.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[g, piece])], ["g", "piece", "n"])

        sums = types.mapInArrow(expect, "g int, piece int, n double").groupBy("g", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((groups, n), prior)
        counts[sums.g, sums.piece] += sums.n
        logp = np.log(counts / counts.sum(1, keepdims=True))
    return logp, counts.sum(1)
