"""Language-model scoring by subword lattice likelihood.

A text's probability is the product of its words' and an end's. A word's lattice has an
edge for every substring that is a piece of a fixed public vocabulary, and for a word of
the training rows one edge over all of it; the word's probability sums all paths, by a
forward recursion in log space. Edges over whole words weigh c / (N + V), the paths of
pieces together V / (N + V) (N words, V word types: the rate at which new words turned up).
Piece probabilities come from EM over every word type of the training rows, each once, as
it is new words that they have to spell. Beside it stands an add-one unigram score.

Word types are joined to texts by 64-bit hash. The most frequent types (``head`` of them at
most) go to all tasks; the rest, of which no single one is frequent, are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspark.llm import blocks
from cellspark.llm.lattice import Tally, cut, default_vocabulary, distinct_counts, estimate, lattice, lowered_words
from cellspark.llm.storage import release, staged

LN10 = math.log(10)


def _hash_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def word_types(rows: DataFrame, groups: int) -> DataFrame:
    """``h, word, counts`` of every word type of ``rows`` (``text``, ``grp``): one count for each group, rows of group -1 not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(groups)

        def out() -> pa.RecordBatch:
            keys, words, counts = tally.merge()
            tally.held, tally.size = [], 0
            n = pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), groups).cast(pa.list_(pa.int64()))
            return pa.record_batch([pa.array(keys.view(np.int64)), words.cast(pa.binary()), n], ["h", "word", "counts"])

        for part in blocks.slices(batches):
            buf, starts, ends, first, hashes = lowered_words(part.column("text"))
            if not len(hashes):
                continue
            group = np.repeat(part.column("grp").to_numpy(), np.diff(first))
            keys, place, counts = distinct_counts(hashes, group, groups)
            tally.add(keys, cut(buf, starts[place], ends[place]), counts)
            if tally.full():
                yield out()
        if tally.held:
            yield out()

    some = rows.mapInArrow(run, "h bigint, word binary, counts array<bigint>")
    sums = [F.sum(F.col("counts")[g]).alias(f"n{g}") for g in range(groups)]
    return some.groupBy("h").agg(F.min("word").alias("word"), *sums).select("h", "word", F.array(*[f"n{g}" for g in range(groups)]).alias("counts"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, rounds: int = 2, head: int = 200_000, word_edges: bool = True) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Learns from rows whose crc32(id as text) mod 7 is not 2. A-Z is lower-cased; tokens are
    the words and one end. A null or empty text has one token. A null id counts as the
    empty text in the split. Repeated rows come out repeated; an empty table gives an empty
    result; with no training rows pieces are equally likely and the end counts once; other
    columns are not read. Without ``word_edges`` the lattices have edges of pieces only, and
    piece probabilities come from all words of the training rows, repeats included.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (_hash_mod(id_col, 7) == 2).alias("held_out"))
    types = staged(word_types(rows.select("text", F.when(F.col("held_out"), 1).otherwise(0).alias("grp")), 2).withColumn("c", F.col("counts")[0]), "types")
    ends = rows.where("not held_out").count()
    total = types.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = int(total.n or 0) + ends, int(total.v) + (ends > 0)
    logp, _ = estimate(types.where("c > 0").select("word", F.array(F.lit(1).cast("bigint") if word_edges else F.col("c")).alias("counts")), 1, path, rounds)
    words, kinds = n - ends, v - (ends > 0)
    # A token is an end or a word; without training rows all of it is spelled.
    end = (ends + 1) / (n + 2)
    spelled = math.log(kinds / (words + kinds)) if words and word_edges else 0.0

    def score_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = lattice(path)
        for batch in batches:
            if batch.num_rows:
                c = batch.column("c").to_numpy()
                with np.errstate(divide="ignore"):
                    whole = np.log(c * word_edges / max(1, words + kinds))
                p = np.logaddexp(whole, spelled + grid.score(batch.column("word"), logp)[:, 0]) + math.log1p(-end)
                yield pa.record_batch([batch.column("h"), batch.column("c"), batch.column("m"), pa.array(p)], ["h", "c", "m", "p"])

    scored = staged(types.select("h", "word", "c", (F.col("counts")[0] + F.col("counts")[1]).alias("m")).mapInArrow(score_types, "h bigint, c bigint, m bigint, p double"), "scored")
    release(types)
    # Types by occurrences, in steps of an eighth of a power of two: a few hundred rows.
    steps = sorted(scored.groupBy(F.floor(F.log2("m") * 8).alias("step")).count().collect(), key=lambda r: -r.step)
    kept, least = 0, 1e9
    for r in steps:
        if kept + r["count"] > head:
            break
        kept, least = kept + r["count"], r.step
    top = scored.where(F.floor(F.log2("m") * 8) >= least).select("h", "c", "p").toPandas()
    order = np.argsort(top.h.to_numpy().view(np.uint64))
    known = [top.h.to_numpy().view(np.uint64)[order], top.c.to_numpy()[order], top.p.to_numpy()[order]]
    shared = docs.sparkSession.sparkContext.broadcast(known)
    bottom = math.log10(n + v + 1)

    def look_up(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts, logs = shared.value
        _, starts, _, first, hashes = lowered_words(part.column("text"))
        doc = np.repeat(np.arange(part.num_rows), np.diff(first))
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
        in_head, where = doc[hit], at[hit]
        size = part.num_rows
        seen = np.bincount(in_head, counts[where] > 0, size).astype(np.int64)
        base = np.bincount(in_head, np.log10(counts[where] + 1.0), size).astype(float)
        full = np.bincount(in_head, logs[where], size).astype(float)
        rest_doc, rest = doc[~hit], hashes[~hit].view(np.int64)
        offsets = np.searchsorted(rest_doc, np.arange(size + 1)).astype(np.int32)
        return pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first)), pa.array(seen), pa.array(base), pa.array(full), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rest))], ["doc_id", "held_out", "n", "seen", "base", "full", "rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    first_pass = rows.mapInArrow(blocks.in_blocks(look_up), f"doc_id {kind}, held_out boolean, n bigint, seen bigint, base double, full double, rest array<bigint>")
    first_pass = staged(first_pass.withColumn("row", F.monotonically_increasing_id()), "texts")
    rest = first_pass.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
    found = rest.join(scored, "h").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("seen2"), F.sum(F.log10(F.col("c") + 1.0) * F.col("k")).alias("base2"), F.sum(F.col("p") * F.col("k")).alias("full2")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tokens = F.col("n") + 1
    return first_pass.drop("rest").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        tokens.cast("bigint").alias("n_tokens"),
        (F.col("seen") + zero("seen2") + (1 if ends else 0)).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("base2") + math.log10(ends + 1) - tokens * bottom).alias("base_score"),
        ((F.col("full") + zero("full2") + math.log(end)) / LN10).alias("score"),
    )
