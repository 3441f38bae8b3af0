"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary, fitted by EM
on a sample of its labelled rows. A text's likelihood under a language sums, for every
word, all segmentations; the score is the posterior of the best language. A text's fit is
how much better than equally likely pieces that language explains it: text of no learned
language has none, however sure the choice between the languages is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellspark.llm import blocks
from cellspark.llm.lattice import Lookup, cut, default_vocabulary, estimate, lattice, lowered_words
from cellspark.llm.lm import _hash_mod, word_types
from cellspark.llm.storage import staged

UNKNOWN = "und"


def language_model(rows: DataFrame, per_language: int, vocabulary: str, rounds: int, seed: int = 42) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log shares, and log piece probabilities [language, piece].

    ``rows`` has ``text`` and a non-null ``lang``. About ``per_language`` rows of each
    language are fitted on, picked by a hash of the text; shares are those of all rows.
    """
    shares = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())
    names = [x for x, _ in shares]
    if not names:
        return [], np.zeros(0), np.zeros((0, len(lattice(vocabulary))))
    count = np.array([x for _, x in shares], float)
    chance = F.pmod(F.xxhash64(F.col("text"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    quota = F.create_map(*[x for name, n in shares for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])
    number = F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k))])
    sample = rows.where(chance < quota[F.col("lang")]).select("text", number[F.col("lang")].alias("grp"))
    types = staged(word_types(sample, len(names)), "types")
    return names, np.log(count / count.sum()), estimate(types.select("word", "counts"), len(names), vocabulary, rounds)[0]


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, vocabulary: str | None = None, rounds: int = 2, hold_out: bool = True, carry: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, fit`` for each row of ``docs``; with ``carry`` the row of ``docs`` too, as a struct ``carried``.

    Learns from text and non-null language of rows whose crc32(id as text) mod 4 is not 2
    (all rows if not ``hold_out``), from about ``per_language`` rows of each language.
    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if no row
    has a language. ``fit`` is the log ratio, for each word on average, of the text's
    likelihood under ``lang_pred`` and under equal probabilities of all pieces (0 where
    ``lang_pred`` is ``und``). Every word of a text counts; equal likelihoods go to the first language
    by name. A null id counts as the empty text in the split. Repeated rows come out
    repeated; an empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()
    held = (_hash_mod(id_col, 4) == 2) if hold_out else F.lit(False)
    text = F.col(text_col).cast("string")
    train = docs.where(~held & F.col(lang_col).isNotNull() & text.isNotNull()).select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    names, shares, logp = language_model(train, per_language, path, rounds)
    # The last row is no language: all pieces alike.
    shared = docs.sparkSession.sparkContext.broadcast(np.vstack((logp, np.full((1, logp.shape[1]), -np.log(logp.shape[1])))))
    labels = np.array([*names, UNKNOWN], object)

    # A text that is in the carried row as it is doesn't go to Python a second time.
    inside = docs.columns.index(text_col) if carry and docs.columns.count(text_col) == 1 and docs.schema[text_col].dataType == StringType() else None

    def texted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch if inside is None else batch.append_column("text", batch.column("carried").field(inside))

    @blocks.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, cache = lattice(path), Lookup(len(names) + 1)
        for part in blocks.slices(texted(batches)):
            best, score, fit = np.full(part.num_rows, len(names)), np.zeros(part.num_rows), np.zeros(part.num_rows)
            if names:
                buf, starts, ends, first, hashes = lowered_words(part.column("text"))
                total = np.zeros((part.num_rows, len(names) + 1))
                if len(hashes):
                    keys, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                    new = cache.missing(keys)
                    if new.any():
                        cache.add(keys[new], grid.score(cut(buf, starts[place[new]], ends[place[new]]), shared.value))
                    each = cache.get(keys)[inverse]
                    some = np.flatnonzero(np.diff(first))
                    total[some] = np.add.reduceat(each, first[:-1][some], axis=0)
                    cache.trim()
                weighed, each_row = total[:, :-1] + shares, np.arange(len(total))
                best = weighed.argmax(1)
                score = 1 / np.exp(weighed - weighed[each_row, best][:, None]).sum(1)
                fit = (total[each_row, best] - total[:, -1]) / np.maximum(1, np.diff(first))
            silent = ~part.column("letter").to_numpy(zero_copy_only=False)
            best[silent], score[silent], fit[silent] = len(names), 0, 0
            kept = [part.column(i) for i in range(part.num_columns - 2)]
            yield pa.record_batch([*kept, pa.array(labels[best], pa.string()), pa.array(score), pa.array(fit)], [*part.schema.names[:-2], "lang_pred", "score", "fit"])

    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter")
    carried = [F.struct(*docs.columns).alias("carried")] if carry else []
    source = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), *carried, letter, *([text.alias("text")] if inside is None else []))
    out = source.mapInArrow(run, source.drop("text", "letter").schema.add("lang_pred", "string").add("score", "double").add("fit", "double"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "fit", *(["carried"] if carry else []))
