"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and digit substitutions to plain letters,
everything else to spaces. The lexicon holds whole words and word beginnings with the
log-odds of toxic against clean documents; a document's mass is the sum of its words'
weights, without words inside exception phrases, and is normalised by length. A logistic
curve, fitted on the same sample, turns mass and density into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.llm import blocks
from cellspark.llm.lm import _hash_mod
from cellspark.llm.storage import staged

#: Characters that stand for a plain letter. i, l, 1 and their look-alikes are one class.
FOLD = {
    "а": "a", "α": "a", "@": "a", "4": "a", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "3": "e", "ɡ": "g", "һ": "h",
    "і": "i", "ι": "i", "ı": "i", "1": "i", "!": "i", "|": "i", "l": "i", "ӏ": "i", "ј": "j", "κ": "k", "к": "k", "м": "m", "ո": "n",
    "о": "o", "ο": "o", "0": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "5": "s", "$": "s", "т": "t", "τ": "t", "7": "t",
    "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
}
#: Phrases whose words don't count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "class clown", "sore loser rule", "disgusting taste", "worthless stock", "not an idiot", "not stupid", "not worthless", "not pathetic")

_TABLE = str.maketrans(FOLD)
_OTHER = re.compile(r"[\W\d_]+")
#: Letter-like signs count only next to a letter: elsewhere they are punctuation.
_SIGNS = re.compile(r"(?<![^\W_])[@!|$]+|[@!|$]+(?![^\W_])")
PREFIXES = (4, 5, 6, 7)


def fold(text: str) -> str:
    return f" {_OTHER.sub(' ', _SIGNS.sub(' ', text.lower()).translate(_TABLE)).strip()} "


def features(folded: str) -> set[str]:
    """Whole words as `` word ``, beginnings of longer ones as `` begi``."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


class Lexicon:
    """Folded patterns with weights; exceptions are patterns of weight None."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, weight in weights.items():
            self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in exceptions:
            pattern = fold(phrase)
            self.automaton.add_word(pattern, (len(pattern), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def mass(self, folded: str) -> float:
        """Each word counts once, with its heaviest pattern."""
        if not len(self.automaton):
            return 0.0
        hits: dict[int, float] = {}
        covered = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                covered.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        if covered:
            hits = {k: v for k, v in hits.items() if not any(a <= k < b for a, b in covered)}
        return sum(hits.values())


def signals(mass: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Inputs of the curve: 1, log mass, log density in percent."""
    return np.column_stack((np.ones(len(mass)), np.log1p(mass), np.log1p(100 * mass / np.maximum(words, 1))))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Logistic regression, classes weighed equally, by Newton steps."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = -3.0
        return w
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 20_000, terms: int = 5_000, threshold: float = 0.7, exceptions: Sequence[str] = EXCEPTIONS, seed: int = 42
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Learns from labelled rows whose crc32(id as text) mod 3 is not 1, about ``per_class`` of
    each label and one of a group of near copies. The lexicon has at most ``terms`` entries: those
    of at least 4 toxic documents and 0.3 % of them, with log-odds of 3 or more, cut at 6.
    Whole texts are scored; a null or empty text has no mass. Null labels are left out; a
    document with several labels is learned with each. Without rows of both labels all
    scores are low. A null id has no label and counts as the empty text in the split.
    Repeated rows come out repeated; an empty table gives an empty result; other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (_hash_mod(id_col, 3) == 1).alias("held_out"))
    known = labels.where(F.col(label_col).isin(0, 1) & (_hash_mod(id_col, 3) != 1)).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    chance = F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    rate = F.when(F.col("y") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    picked = known.where(chance < rate)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.slices(batches):
            buf, offsets = blocks.layout(part.column("text"))
            starts, ends, first = blocks.words(buf, offsets)
            key = np.zeros(part.num_rows, np.uint64)
            if len(starts):
                last = np.minimum(np.arange(len(starts)) + 4, np.repeat(first[1:], np.diff(first)) - 1)
                h = blocks.byte_hashes(buf, starts, ends[last])
                some = np.flatnonzero(np.diff(first))
                # Three independent minima: a passage that many texts share would have to be the least in all.
                for salt in (1, 2, 3):
                    key[some] = blocks.mix(key[some] + np.minimum.reduceat(blocks.mix(h + np.uint64(salt)), first[:-1][some]))
            yield pa.record_batch([part.column("y"), pa.array(key.view(np.int64)), part.column("text")], ["y", "near", "text"])

    # About 2 * per_class short rows, whatever the input: they go to the texts.
    sample = staged(rows.join(F.broadcast(picked), rows.doc_id == picked.label_id).select("y", "text").mapInArrow(near, "y int, near bigint, text string").dropDuplicates(["y", "near"]), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                seen[y].update(features(fold(text or "")))
            for y in (0, 1):
                if seen[y]:
                    yield pa.record_batch([pa.array([y] * len(seen[y]), pa.int32()), pa.array(list(seen[y]), pa.string()), pa.array(list(seen[y].values()), pa.int64())], ["y", "term", "n"])

    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    table = sample.select("y", "text").mapInArrow(count, "y int, term string, n bigint").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    best = table.where(F.col("bad") >= max(4, 0.003 * toxic)).withColumn("weight", odds).where("weight >= 3").orderBy(F.desc(F.col("weight") * F.log1p("bad")), "term").limit(terms).collect() if toxic and clean else []
    weights = {r.term: min(6.0, r.weight) for r in best}
    shared = spark.sparkContext.broadcast((weights, tuple(exceptions)))

    def measure(texts: list) -> tuple[np.ndarray, np.ndarray]:
        lexicon = _lexicon(shared.value)
        mass, words = np.zeros(len(texts)), np.zeros(len(texts))
        for i, text in enumerate(texts):
            folded = fold(text or "")
            mass[i], words[i] = lexicon.mass(folded), folded.count(" ") - 1
        return mass, words

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.slices(batches):
            mass, words = measure(part.column("text").to_pylist())
            yield pa.record_batch([part.column("y"), pa.array(mass), pa.array(words)], ["y", "mass", "words"])

    points = sample.select("y", "text").mapInArrow(learn, "y int, mass double, words double").toPandas()  # at most about 2 * per_class rows
    curve = fit_curve(signals(points.mass.to_numpy(), points.words.to_numpy()), points.y.to_numpy(float))

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        p = 1 / (1 + np.exp(-np.clip(signals(*measure(part.column("text").to_pylist())) @ curve, -30, 30)))
        return pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(blocks.in_blocks(score), f"doc_id {kind}, held_out boolean, score double, predicted int")


_LEXICON: list = []


def _lexicon(value: tuple) -> Lexicon:
    """Built once for each broadcast value and process; the value is held, so that another one can't have its identity."""
    if not _LEXICON or _LEXICON[0] is not value:
        _LEXICON[:] = [value, Lexicon(*value)]
    return _LEXICON[1]
