"""Near-duplicate texts by SimHash and anchor-point covering.

A text's fingerprint has 64 bits: a bit is 1 if it is set in more than half of the XXH64
values of its word shingles. Fingerprints that differ in at most ``threshold`` bits link.

Links are found through a covering code. The 64 bits are cut into three blocks of 22, 21
and 21; of two linked fingerprints one block differs in at most ``threshold // 3`` bits.
The anchors of a block are the 4096 words of the perfect binary Golay code of length 23,
whose covering radius is 3: every block value has one *home* anchor within distance 3. A
fingerprint is replicated to every anchor within ``3 + threshold // 3``, so a linked pair
meets at the home anchor of either one. Per anchor, homes are compared with all arrivals.
Very many fingerprints are dealt to pairs of anchors of two blocks instead, of which there
are 4096 times as many, so that comparisons don't grow with the square; links are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.llm import blocks
from cellspark.llm.components import connected_components, join
from cellspark.llm.storage import release, staged

#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GOLAY = 0xC75
RADIUS = 3
#: (first bit, number of bits) of the three blocks.
PARTS = ((0, 22), (22, 21), (43, 21))
ANCHORS = 4096
#: Homes and arrivals of one comparison task at most; larger anchors are cut both ways.
CELL = 8192
#: Crowded cells that are cut, at most; others are compared whole.
LISTED = 100_000
#: Fingerprints above which cells are pairs of anchors.
MANY = 4_000_000
#: Fingerprints dealt at once.
PIECE = 8_000


def fingerprints(buf: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """One 64-bit fingerprint for each document of a block."""
    return majority(*shingle_hashes(buf, offsets, width, seed))


def majority(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Fingerprints of documents that have ``many`` of the ``hashes`` each, one after another: a bit is set if it is in more than half of them."""
    bits = np.zeros((len(many), 64), bool)
    full = np.flatnonzero(many)
    if len(full):
        each = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(each, np.cumsum(many[full]) - many[full], axis=0, dtype=np.int32)
        bits[full] = 2 * count > many[full][:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (GOLAY << (bit - 11))
    return x


def covering_table(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns by syndrome: an array (2048, most) of patterns of weight up to ``reach``, the lightest first; how far beyond ``RADIUS`` each is; and how many of them each syndrome has up to 0, 1, … beyond, [excess, syndrome]."""
    patterns = np.array([sum(1 << i for i in c) for w in range(reach + 1) for c in combinations(range(23), w)], np.int64)
    syndromes = _syndrome(patterns)
    order = np.argsort(syndromes, kind="stable")
    count = np.bincount(syndromes, minlength=2048)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    table, beyond = np.zeros((2048, int(count.max())), np.int64), np.zeros((2048, int(count.max())), np.int64)
    table[syndromes[order], rank] = patterns[order]
    excess = np.maximum(np.bitwise_count(patterns).astype(np.int64) - RADIUS, 0)
    beyond[syndromes[order], rank] = excess[order]
    counts = np.array([np.bincount(syndromes[excess <= k], minlength=2048) for k in range(reach - RADIUS + 1)])
    return table, beyond, counts


class Covering:
    """Cells of fingerprints: anchors of single blocks, or pairs of anchors of two blocks.

    Of two linked fingerprints one block differs in at most ``threshold // 3`` bits, and some
    two blocks in at most ``2 * threshold // 3``. Pairs make cells 4096 times as many, and
    ten times as many arrivals.
    """

    def __init__(self, threshold: int, double: bool):
        self.double = double
        self.over = (2 * threshold if double else threshold) // 3
        self.table, self.beyond, self.counts = covering_table(RADIUS + self.over)

    def __call__(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all fingerprints and anchors that they reach: index of the fingerprint, cell, whether it is the home."""
        values = [((fp >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in PARTS]
        syndromes = [_syndrome(x) for x in values]
        index, cells, home = [], [], []
        for part in range(3):
            x, s = values[part], syndromes[part]
            many = self.counts[-1][s]
            who = np.repeat(np.arange(len(fp)), many)
            rank = blocks.ragged(np.zeros(len(fp), np.int64), many)
            cell, own = part * ANCHORS + ((x[who] ^ self.table[s[who], rank]) >> 11), rank == 0
            if self.double:
                left = self.over - self.beyond[s[who], rank]
                x, s = values[(part + 1) % 3], syndromes[(part + 1) % 3]
                many = self.counts[left, s[who]]
                rank = blocks.ragged(np.zeros(len(who), np.int64), many)
                who, cell, own = np.repeat(who, many), np.repeat(cell, many), np.repeat(own, many)
                cell, own = cell * ANCHORS + ((x[who] ^ self.table[s[who], rank]) >> 11), own & (rank == 0)
            index.append(who)
            cells.append(cell)
            home.append(own)
        return np.concatenate(index), np.concatenate(cells), np.concatenate(home)


def forest(homes: np.ndarray, guests: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between ``homes`` and ``guests``."""
    every, inverse = np.unique(np.concatenate((homes, guests)), return_inverse=True)
    at, to = inverse[: len(homes)], inverse[len(homes) :]
    label = np.arange(len(every))
    step = max(1, 2_000_000 // max(1, len(guests)))
    for i in range(0, len(homes), step):
        apart = np.bitwise_count(homes[i : i + step, None] ^ guests[None, :])
        linked = (apart > 0) & (apart <= threshold)  # a home's own copy may be among the guests or, in a cut anchor, in another cell
        a, b = np.nonzero(linked)
        join(label, at[i + a], to[b])
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _links(prints: DataFrame, threshold: int, double: bool | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all linked ones; pairs of blocks by default where there are more than ``MANY``."""
    reach = Covering(threshold, prints.count() > MANY if double is None else double)

    @blocks.lean
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, PIECE):
                _, cells, home = reach(batch.column(0).slice(part, PIECE).to_numpy().view(np.uint64))
                cells, homes = (cells[home], home[home]) if reach.double else (cells, home)
                here, at = np.unique(cells, return_inverse=True)
                yield pa.record_batch([pa.array(here), pa.array(np.bincount(at, homes).astype(np.int64)), pa.array(np.bincount(at) if not reach.double else np.zeros(len(here), np.int64))], ["cell", "homes", "guests"])

    # Crowded cells only, and few of them: cells that are not listed are compared whole.
    counted = prints.mapInArrow(sizes, "cell bigint, homes bigint, guests bigint").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests"))
    crowded = counted.where((F.col("homes") > CELL) | (F.col("guests") > CELL)).orderBy(F.desc("homes"), F.desc("guests"), "cell").limit(LISTED).toPandas().sort_values("cell")
    listed, rows, columns = crowded.cell.to_numpy(), np.maximum(1, -(-crowded.homes.to_numpy() // CELL)), np.maximum(1, -(-crowded.guests.to_numpy() // CELL))

    def cuts(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many rows and columns each cell is cut."""
        if not len(listed):
            return np.ones(len(cells), np.int64), np.ones(len(cells), np.int64)
        at = np.minimum(np.searchsorted(listed, cells), len(listed) - 1)
        hit = listed[at] == cells
        return np.where(hit, rows[at], 1), np.where(hit, columns[at], 1)

    @blocks.lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, PIECE):
                fp = batch.column(0).slice(part, PIECE).to_numpy().view(np.uint64)
                index, cells, home = reach(fp)
                value = fp[index]
                salt = blocks.mix(value)
                every = cuts(cells)
                out = []
                for is_home in (True, False):
                    pick = home if is_home else np.ones(len(cells), bool)
                    c, v, s = cells[pick], value[pick], salt[pick]
                    own, times = (x[pick] for x in (every if is_home else every[::-1]))
                    mine = np.repeat((s % own.astype(np.uint64)).astype(np.int64), times)
                    yours = blocks.ragged(np.zeros(len(c), np.int64), times)
                    row, column = (mine, yours) if is_home else (yours, mine)
                    c, v = np.repeat(c, times), np.repeat(v, times)
                    out.append((c << 36 | row << 18 | column, v, np.full(len(c), is_home)))
                task, v, is_home = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch([pa.array(task), _longs(v), pa.array(is_home)], ["task", "fp", "home"])

    @blocks.lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, fp, home in whole_groups(batches):
            cut = np.flatnonzero(np.diff(task)) + 1
            for a, b in zip([0, *cut], [*cut, len(task)]):
                v, h = fp[a:b].view(np.uint64), home[a:b]
                if h.any() and not h.all():
                    x, y = forest(v[h], v[~h], threshold)
                    if len(x):
                        yield pa.record_batch([_longs(x), _longs(y)], ["a", "b"])

    dealt = prints.mapInArrow(deal, "task bigint, fp bigint, home boolean")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "task").sortWithinPartitions("task").mapInArrow(compare, "a bigint, b bigint")


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by its first column, in pieces that never part a group."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in held) >= least:
            columns = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last:
                yield [c[:last] for c in columns]
            held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id``, ``fp``: one fingerprint (BIGINT) for each row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints(*blocks.layout(part.column("text")), width)
        return pa.record_batch([part.column("id"), _longs(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(blocks.in_blocks(run), "id bigint, fp bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, threshold: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for each row of ``docs``.

    Letters A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a shingle is ``width``
    words joined by a space (fewer words: all of them). A null or wordless text has
    fingerprint zero and links like any other. ``component_id`` is the smallest id
    reachable over links, itself included; a null id never is the smallest, and a
    component of null ids alone has a null. Repeated rows come out repeated; an empty
    table gives an empty result; other columns are not read.
    """
    each = staged(fingerprint_table(docs, id_col, text_col, width), "fingerprints")
    prints = staged(each.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    roots = connected_components(_links(prints.select("fp"), threshold))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(smallest, "root").select(F.col("fp").alias("of"), "component_id"), "components")
    release(prints)
    return each.join(named, each.fp == named.of).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 values of the word shingles of a block's documents, one document after another, and how many each has."""
    buf = blocks.LOWER[buf]
    starts, ends, first = blocks.words(buf, offsets)
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    full = np.flatnonzero(many)
    if not len(full):
        return np.zeros(0, np.uint64), many
    flat, starts, ends = blocks.squeeze(buf, starts, ends)
    begin = blocks.ragged(first[:-1][full], many[full])
    end = begin + np.repeat(np.minimum(n[full], width) - 1, many[full])
    return blocks.xxh64(flat, starts[begin], ends[end], seed), many


#: Bands of a MinHash signature and values in each: a pair at a similarity of 0.8 shares a band
#: with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996.
BANDS, ROWS = 20, 5
#: Shingles in one side of a verification cell, about.
SHINGLES = 2_000_000


def minhash_bands(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """One key for each band, [document, band]; documents of similar shingle sets share keys. Zeros for a document without shingles."""
    out = np.zeros((len(many), BANDS), np.uint64)
    full = np.flatnonzero(many)
    if len(full):
        at = np.cumsum(many[full]) - many[full]
        factors = blocks.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for factor in factors[band * ROWS : (band + 1) * ROWS]:
                key = blocks.mix(key ^ np.minimum.reduceat(hashes * factor, at))
            out[full, band] = key
    return out


def jaccard_labels(sets: list[np.ndarray], at: np.ndarray, to: np.ndarray, least: float) -> np.ndarray:
    """A label for each of ``sets`` (distinct values): equal for those joined by pairs, between rows ``at`` and ``to``, of a similarity of ``least`` or more."""
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    there = code[blocks.ragged(first[to], size[to])]
    begin = np.cumsum(size[to]) - size[to]
    mark = np.zeros(len(values), bool)
    for i in at:
        if (label[to] == label[i]).all():
            continue
        mine = code[first[i] : first[i] + size[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[there], begin, dtype=np.int64)
        mark[mine] = False
        near = to[both >= least * (size[i] + size[to] - both)]
        join(label, np.full(len(near), i), near)
    return label


def _candidates(prints: DataFrame, threshold: int) -> DataFrame:
    """``pid, comp`` of the rows of ``pid, fp, bands, n`` whose fingerprint links with another's or that share a band with another, joined over both."""

    @blocks.lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<u8")
            yield pa.record_batch([_longs(keys), pa.array(np.repeat(batch.column("pid").to_numpy(), BANDS))], ["bucket", "pid"])

    dealt = prints.where("n > 0").select("pid", "bands").mapInArrow(deal, "bucket bigint, pid bigint")
    crowded = dealt.groupBy("bucket").agg(F.min("pid").alias("low"), F.count("*").alias("many")).where("many > 1").select("bucket", "low")
    banded = dealt.join(crowded.hint("merge"), "bucket").select(F.col("pid").alias("a"), F.col("low").alias("b"))
    # Links between fingerprints hold for the first row of each, and equal fingerprints for all their rows.
    worded = prints.where("n > 0").select("pid", "fp")
    firsts = staged(worded.groupBy("fp").agg(F.min("pid").alias("low"), F.count("*").alias("many")), "fingerprints")
    equal = worded.join(firsts.where("many > 1").hint("merge"), "fp").select(F.col("pid").alias("a"), F.col("low").alias("b"))
    a, b = (firsts.select(F.col("fp").alias(x), F.col("low").alias(f"low_{x}")).hint("merge") for x in "ab")
    linked = _links(firsts.select("fp"), threshold).join(a, "a").join(b, "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    joined = connected_components(banded.unionByName(equal).unionByName(linked))
    release(firsts)
    return joined.select(F.col("node").alias("pid"), F.col("root").alias("comp")).unionByName(joined.select(F.col("root").alias("pid"), F.col("root").alias("comp")).distinct())


def _verified(rows: DataFrame, prints: DataFrame, width: int, least: float, threshold: int) -> DataFrame:
    """Edges (a, b) between rows of ``prints`` that connect all candidates of a similarity of ``least`` or more; large groups of candidates are cut into cells, all of which are compared."""
    piece = max(1, CELL // 8)
    member = staged(prints.select("pid", "kid", "tid", "n").join(_candidates(prints, threshold).hint("merge"), "pid"), "members")
    pieces = F.greatest(F.ceil(F.count("*") / piece), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    cut = member.join(member.groupBy("comp").agg(pieces.alias("pieces")), "comp")
    chosen = cut.select("kid", "tid", "pid", "comp", "pieces", F.pmod(F.xxhash64("pid"), "pieces").cast("int").alias("mine"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, many = shingle_hashes(*blocks.layout(part.column("text")), width)
        sets = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(many)[:-1])]
        names = ["pid", "comp", "pieces", "mine"]
        return pa.record_batch([*map(part.column, names), pa.array(sets, pa.binary())], [*names, "shingles"])

    @blocks.lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, pid, side, shingles in whole_groups(batches, 5_000):
            edge = np.flatnonzero(np.diff(task)) + 1
            for a, b in zip([0, *edge], [*edge, len(task)]):
                ids, place = np.unique(pid[a:b], return_index=True)
                at, to = np.flatnonzero(side[a:b][place] <= 0), np.flatnonzero(side[a:b][place] >= 0)
                if len(ids) < 2 or not len(at) or not len(to):
                    continue
                label = jaccard_labels([np.frombuffer(x, "<u8") for x in shingles[a:b][place]], at, to, least)
                moved = np.flatnonzero(label != np.arange(len(ids)))
                if len(moved):
                    yield pa.record_batch([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    sets = rows.join(chosen.hint("merge"), ["kid", "tid"]).select("pid", "comp", "pieces", "mine", "text").mapInArrow(blocks.in_blocks(run), "pid bigint, comp bigint, pieces int, mine int, shingles binary")
    dealt = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("yours"))
    # Side: zero in a cell of one piece with itself, else which of the two pieces.
    dealt = dealt.select(F.xxhash64("comp", F.least("mine", "yours"), F.greatest("mine", "yours")).alias("task"), "pid", F.signum(F.col("mine") - F.col("yours")).cast("int").alias("side"), "shingles")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "task").sortWithinPartitions("task").mapInArrow(compare, "a bigint, b bigint")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, threshold: int = 4) -> DataFrame:
    """Rows of ``docs``, all columns, without the near copies: of each component the row of the smallest id stays.

    Texts link if the similarity (Jaccard) of their sets of ``width``-word shingles, lower
    case, is ``least`` or more, by the sets themselves. Pairs to compare are those joined over
    SimHash fingerprints that differ in at most ``threshold`` bits, all found by the covering of
    ``simhash_components``, and, as copies at a similarity of 0.8 differ in more, over shared
    bands of MinHash signatures too: at 0.8 a pair shares one with probability 0.9996, more above it. Rows with null ids come last in that order; rows with equal ids and
    texts are copies, of which one stays; rows with equal ids and different texts are different.
    Wordless and null texts are copies of each other. An empty table stays empty; other columns
    may have any name.
    """
    text = F.col(text_col).cast("string")
    # A null id is replaced by a large number from the text. An id may come with several texts.
    kid = F.coalesce(F.col(id_col).cast("bigint"), F.pmod(F.xxhash64(text), F.lit(1 << 62)) + F.lit(1 << 62))
    rows = docs.select(kid.alias("kid"), F.xxhash64(text).alias("tid"), text.alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, many = shingle_hashes(*blocks.layout(part.column("text")), width)
        # Texts with the same shingles, as often each, have the same sums.
        sums = np.zeros((2, len(many)), np.uint64)
        full = np.flatnonzero(many)
        if len(full):
            at = np.cumsum(many[full]) - many[full]
            for k in range(2):
                sums[k, full] = np.add.reduceat(blocks.mix(hashes + np.uint64(k)), at)
        bands = pa.array([x.tobytes() for x in minhash_bands(hashes, many)], pa.binary())
        return pa.record_batch([part.column("kid"), part.column("tid"), _longs(sums[0]), _longs(sums[1]), pa.array(many), _longs(majority(hashes, many)), bands], ["kid", "tid", "s1", "s2", "n", "fp", "bands"])

    each = staged(rows.mapInArrow(blocks.in_blocks(run), "kid bigint, tid bigint, s1 bigint, s2 bigint, n bigint, fp bigint, bands binary"), "signatures")
    alike = each.groupBy("s1", "s2", "n").agg(F.min(F.struct("kid", "tid")).alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    prints = staged(alike.select(F.monotonically_increasing_id().alias("pid"), "first.kid", "first.tid", "n", "fp", "bands"), "prints")
    roots = connected_components(_verified(rows, prints, width, least, threshold))
    rooted = prints.join(roots, F.col("pid") == F.col("node"), "left").select("kid", "tid", F.coalesce("root", "pid").alias("root"))
    keep = staged(rooted.groupBy("root").agg(F.min(F.struct("kid", "tid")).alias("first")).select("first.kid", "first.tid"), "kept")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), kid.alias("kid"), F.xxhash64(text).alias("tid"))
    # The kept rows grow with the input and are never sent to all tasks.
    kept = keyed.join(keep.hint("merge"), ["kid", "tid"], "left_semi")
    repeated = each.groupBy("kid", "tid").agg(F.count("*").alias("many")).where("many > 1").join(keep, ["kid", "tid"], "left_semi").limit(1).count()
    release(each, prints)
    return (kept.dropDuplicates(["kid", "tid"]) if repeated else kept).select("row.*")
