"""Mixture-controlled packing of token streams into sequences of fixed length.

Every source is a queue: its documents' tokens end to end. A window is ``window`` sequences
long and takes from each source its share of tokens by deficit round-robin: in each round a
source's deficit grows by its quantum, the share of a window, it gives the whole tokens of
that, and the fraction is carried to the next window. After k windows a source with T
tokens, of K windows in all, has therefore given exactly floor(k * T / K) tokens. That makes the
plan arithmetic: given where a document starts in its queue, all its pieces follow from
the table of totals, without running through the windows, and no deficit is lost between
partitions. Given target weights, shares change where a source runs dry, in the same way. All
sequences but the last are full.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspark.llm import blocks
from cellspark.llm.lattice import cut
from cellspark.llm.storage import staged

#: Fixed value: the id after each document.
END = 1
LENGTH = 2048
#: Windows whose plans a task keeps.
KEPT = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokens:
    """Token ids of whole texts, byte-level BPE.

    Text is cut before each run of white space: the vocabulary's pattern never lets a token
    cross such a place, so equal pieces have equal ids, and a piece is encoded once for a
    task. Texts with other than ASCII white space may have tokens across and are encoded as
    a whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their offsets."""
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.uint16), np.zeros(n + 1, np.int64)
        space = blocks.SPACE[buf]
        begin = space & ~np.concatenate(([False], space[:-1]))
        begin[offsets[:-1][offsets[:-1] < len(buf)]] = True
        starts = np.flatnonzero(begin)
        # Lead bytes of all white space beyond ASCII, and of much else.
        wide = np.flatnonzero(np.isin(buf, (0xC2, 0xE1, 0xE2, 0xE3)))
        wide = wide[(buf[wide] != 0xC2) | np.isin(buf[np.minimum(wide + 1, len(buf) - 1)], (0x85, 0xA0))]
        if len(wide):
            whole = np.zeros(n, bool)
            whole[np.searchsorted(offsets, wide, "right") - 1] = True
            doc = np.searchsorted(offsets, starts, "right") - 1
            starts = starts[~whole[doc] | (starts == offsets[doc])]
        ends = np.append(starts[1:], len(buf))
        hashes = blocks.byte_hashes(buf, starts, ends)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            encoded = [self.encode(x.decode("utf-8", "replace")) for x in cut(buf, starts[first[new]], ends[first[new]]).to_pylist()]
            size = np.array([len(x) for x in encoded], np.int64)
            start = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate((self.ids, np.array([i for x in encoded for i in x], np.uint16)))
            every = np.concatenate((self.keys, keys[new]))
            order = np.argsort(every, kind="stable")
            self.keys, self.start, self.size = every[order], np.concatenate((self.start, start))[order], np.concatenate((self.size, size))[order]
        at = np.searchsorted(self.keys, keys)[inverse]
        size = self.size[at]
        before = np.concatenate(([0], np.cumsum(size)))
        return self.ids[blocks.ragged(self.start[at], size)], before[np.searchsorted(starts, offsets)]


def quota(k: np.ndarray, totals: np.ndarray, windows: int) -> np.ndarray:
    """Tokens that each source has given after ``k`` windows, [k, source], without overflow."""
    k = np.asarray(k, np.int64)[..., None]
    return k * (totals // windows) + k * (totals % windows) // windows


class Schedule:
    """What every source has given after each window.

    Without weights sources keep their own shares and all run dry at the end. With weights a
    source gives ``weight`` tokens for each step of a common clock until it runs dry; from
    then on the others share the windows by their weights. The time between two such moments
    is a phase of whole windows.
    """

    def __init__(self, totals: np.ndarray, size: int, weights: np.ndarray | None = None):
        self.totals, self.weights = totals, weights
        self.windows = max(1, -(-int(totals.sum()) // size))
        self._known: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        if weights is not None:
            self.dry = totals / weights
            self.end = np.unique(self.dry)
            self.begin = np.concatenate(([0.0], self.end[:-1]))
            given = np.array([np.minimum(weights * t, totals).sum() for t in (*self.begin, *self.end)]).reshape(2, -1)
            self.count = np.maximum(1, np.ceil((given[1] - given[0]) / size)).astype(np.int64)
            self.first = np.cumsum(self.count) - self.count
            self.windows = int(self.count.sum())

    def given(self, k: int) -> np.ndarray:
        if self.weights is None:
            return quota(k, self.totals, self.windows)
        if k >= self.windows:
            return self.totals
        phase = int(np.searchsorted(self.first, k, "right")) - 1
        clock = self.begin[phase] + (self.end[phase] - self.begin[phase]) * ((k - self.first[phase]) / self.count[phase])
        return np.where(self.dry <= self.begin[phase], self.totals, np.minimum((self.weights * clock).astype(np.int64), self.totals))

    def window(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each source has given before and after window ``k``, and where in all tokens its part of the window begins; the last windows asked for are kept."""
        if k not in self._known:
            if len(self._known) >= KEPT:
                self._known.clear()
            before, after = self.given(k), self.given(k + 1)
            self._known[k] = before, after, before.sum() + np.cumsum(after - before) - (after - before)
        return self._known[k]

    def find(self, source: int, at: int) -> int:
        """The window that takes token ``at`` of the queue of ``source``."""
        if self.weights is None:
            k = at * self.windows // int(self.totals[source])
        else:
            clock = at / self.weights[source]
            phase = min(int(np.searchsorted(self.end, clock, "right")), len(self.end) - 1)
            k = int(self.first[phase] + (clock - self.begin[phase]) / (self.end[phase] - self.begin[phase]) * self.count[phase])
            k = min(max(k, 0), self.windows - 1)
            while self.window(k)[0][source] > at:
                k -= 1
        while self.window(k)[1][source] <= at:
            k += 1
        return k


def pieces(start: int, size: int, source: int, schedule: Schedule, length: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of all pieces of ``size`` tokens that begin at ``start`` in the queue of ``source``."""
    out, done = [], 0
    while done < size:
        at = start + done
        before, after, first = schedule.window(schedule.find(source, at))
        place = int(first[source] + at - before[source])
        here = int(min(size - done, after[source] - at))
        while here:
            n = min(here, length - place % length)
            out.append((done, n, place // length, place % length))
            done, here, place = done + n, here - n, place + n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, window: int = 32, vocabulary: str | None = None, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's tokens are its text's ids and an end. Documents queue in the order of the
    table's partitions. A null text is empty and has only the end; null sources form one
    queue; repeated rows are packed repeatedly; an empty table gives an empty result; other
    columns are not read. Sequences are gapless; only the last may be shorter and is padded.
    Windows take from the sources in proportion to ``weights`` (above 0, for every source;
    null is a source), until a source runs dry; by default in proportion to their tokens.
    One row for each source comes to the driver and goes to all tasks.
    """
    path = vocabulary or default_vocabulary()
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), source.alias("source"))

    @blocks.lean
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokens, held = TaskContext.get().partitionId(), Tokens(path), {}
        for part in blocks.slices(batches):
            ids, offsets = tokens(*blocks.layout(part.column("text")))
            data = cut(ids.view(np.uint8), offsets[:-1] * 2, offsets[1:] * 2).cast(pa.binary())
            size, start = np.diff(offsets) + 1, np.zeros(part.num_rows, np.int64)
            names = part.column("source").to_pylist()
            for i, (name, n) in enumerate(zip(names, size.tolist())):
                start[i] = held.get(name, 0)
                held[name] = int(start[i]) + n
            yield pa.record_batch([part.column("doc_id"), part.column("source"), pa.array(np.full(part.num_rows, task, np.int32)), pa.array(start), pa.array(size), data], ["doc_id", "source", "task", "first", "size", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    encoded = staged(rows.mapInArrow(tokenise, f"doc_id {kind}, source string, task int, first bigint, size bigint, ids binary"), "tokens")
    parts = encoded.groupBy("source", "task").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = staged(parts.select("source", "task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"), "size"), "shift")
    queues = sorted((r.source, int(r.total)) for r in shift.groupBy("source").agg(F.sum("size").alias("total")).collect())
    number, totals = {s: i for i, (s, _) in enumerate(queues)}, np.array([n for _, n in queues], np.int64)
    shares = None if weights is None else np.array([{"" if k is None else f"s{k}": v for k, v in weights.items()}[s] for s, _ in queues], float)
    if shares is not None and not (shares > 0).all():
        raise ValueError("weights must be above 0")
    shared = docs.sparkSession.sparkContext.broadcast((number, totals, shares))

    @blocks.lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, totals, shares = shared.value
        schedule = Schedule(totals, window * length, shares)
        for part in blocks.slices(batches, "ids"):
            out, row = [], []
            first = (part.column("first").to_numpy() + part.column("shift").to_numpy()).tolist()
            size, source = part.column("size").to_pylist(), part.column("source").to_pylist()
            for i, data in enumerate(part.column("ids")):
                ids = np.append(np.frombuffer(data.as_py(), "<u2"), np.uint16(END)).astype("<u4")
                for start, n, sequence, offset in pieces(first[i], size[i], number[source[i]], schedule, length):
                    out.append((start, n, zlib.crc32(ids[start : start + n].tobytes()), size[i], sequence, offset))
                    row.append(i)
            columns = np.array(out, np.int64).reshape(-1, 6)
            yield pa.record_batch([part.column("doc_id").take(pa.array(row, pa.int64())), *map(pa.array, columns.T)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # A few rows for each task of the input: Spark sends them to all tasks as long as they are small, else it joins by shuffle.
    return encoded.join(shift.drop("size"), ["source", "task"]).select("doc_id", "source", "first", "shift", "size", "ids").mapInArrow(
        place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
