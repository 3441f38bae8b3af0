"""Scores of the learned text operators against plain loops over the same data, and odd columns and words."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from cellspark.llm import langid, lattice, lm, mixing, packing, pii, quality, simhash, substring_dedup, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "").encode().split()


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


class Plain:
    """Marginals and expected pieces of one word at a time, in plain probabilities."""

    def __init__(self):
        pieces = lattice.lattice(lattice.default_vocabulary()).pieces
        self.index, self.longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))

    def edges(self, w):
        return [(a, b, i) for b in range(1, len(w) + 1) for a in range(max(0, b - self.longest), b) if (i := self.index.get(w[a:b])) is not None]

    def forward(self, w, p):
        out = [1.0] + [0.0] * len(w)
        for a, b, i in self.edges(w):
            out[b] += out[a] * p[i]
        return out

    def em(self, counts, rounds=2, prior=0.05):
        p = np.full(len(self.index), 1 / len(self.index))
        for _ in range(rounds):
            total = np.full(len(p), prior)
            for word, n in counts.items():
                w = b" " + word
                edges, alpha, beta = self.edges(w), self.forward(w, p), [0.0] * len(w) + [1.0]
                for a, b, i in reversed(edges):
                    beta[a] += beta[b] * p[i]
                for a, b, i in edges:
                    total[i] += n * alpha[a] * p[i] * beta[b] / alpha[-1]
            p = total / total.sum()
        return p

    def log(self, word, p):
        return math.log(self.forward(b" " + word, p)[-1])


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_long_words_agree(monkeypatch):
    """Words summed edge by edge have the scores and expected pieces of those summed side by side; parts of a word meet without a seam."""
    grid = lattice.lattice(lattice.default_vocabulary())
    rng = np.random.default_rng(7)
    logp = np.log(rng.dirichlet(np.ones(len(grid)), 2))
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 50, 700, 1900)] + [b"-" * 300, b"", "é".encode() * 90]
    column, weights = pa.array(words, pa.large_binary()), np.arange(1.0, 8.0)
    want, counts = grid.score(column, logp), grid.expected(column, weights, logp[0])
    monkeypatch.setattr(lattice, "LONG", 2)
    monkeypatch.setattr(lattice, "CHUNK", 64)
    assert np.allclose(grid.score(column, logp), want, atol=1e-9) and np.allclose(grid.expected(column, weights, logp[0]), counts, atol=1e-7)


def test_unbroken_text_is_linear(spark):
    """A word of 200,000 bytes is scored as fast as its length lets it."""
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["ab" * 100_000, "a few words here", "and some more words"])], "doc_id bigint, text string, lang string")
    assert np.isfinite(lm.lm_scores(d).toPandas().score).all() and langid.language_scores(d).count() == 3


@pytest.mark.parametrize("edges", [True, False])
def test_lm_score(docs, plain, edges):
    rows = [(r.doc_id, lowered(r.text)) for r in docs.collect()]
    train = [w for i, w in rows if not held(i, 7, 2)]
    counts = collections.Counter(x for w in train for x in w)
    n, kinds = sum(counts.values()), len(counts)
    p = plain.em(counts if not edges else dict.fromkeys(counts, 1))
    end = (len(train) + 1) / (n + len(train) + 2)

    def word(x):
        spelled = plain.log(x, p) + (math.log(kinds / (n + kinds)) if edges else 0)
        return math.log1p(-end) + math.log((counts[x] / (n + kinds) if edges else 0) + math.exp(spelled))

    got = {r.doc_id: r.score for r in lm.lm_scores(docs, word_edges=edges).collect()}
    for i, w in rows:
        assert got[i] == pytest.approx((sum(map(word, w)) + math.log(end)) / math.log(10), rel=1e-6)


def test_langid_score(docs, plain):
    rows = [(r.doc_id, lowered(r.text), r.lang, r.text) for r in docs.collect()]
    train = [(w, lang) for i, w, lang, _ in rows if lang and not held(i, 4, 2)]
    names = sorted({lang for _, lang in train})
    models = [plain.em(collections.Counter(x for w, lang in train if lang == name for x in w)) for name in names]
    share = [math.log(sum(lang == name for _, lang in train) / len(train)) for name in names]
    alike = [1 / len(plain.index)] * len(plain.index)
    got = {r.doc_id: r for r in langid.language_scores(docs).collect()}
    for i, w, _, text in rows:
        total = [s + sum(plain.log(x, p) for x in w) for s, p in zip(share, models)]
        best = max(range(len(names)), key=lambda k: total[k])
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].fit == 0
        else:
            assert got[i].lang_pred == names[best] and got[i].score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total), abs=1e-6)
            assert got[i].fit == pytest.approx(sum(plain.log(x, models[best]) - plain.log(x, alike) for x in w) / len(w), rel=1e-6, abs=1e-6)


def test_strange_texts_have_no_fit(spark, docs):
    """Random letters and a language without rows are explained little better than by equal pieces; every document with a letter is by far."""
    rng = np.random.default_rng(4)
    strange = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)), "Быстрая коричневая лиса прыгает через ленивую собаку и потом возвращается домой"]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(strange)], "doc_id bigint, text string, lang string"))
    for r in langid.language_scores(rows, hold_out=False).where("lang_pred <> 'und'").collect():
        assert r.fit < 1 if r.doc_id < 0 else r.fit > 2


def test_toxicity_score(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkmnprst" for b in ("ake", "ilo", "ora", "une") for c in ("n", "sh", "t")]
    bad = ["moron", "idiots", "trash", "loathsome"]
    rows = []
    for i in range(500):
        words = [f"own{i}", *rng.choice(vocabulary, 30), f"tail{i}"]
        if i % 5 == 0:
            words[5:8] = rng.choice(bad, 3)
        if i % 40 == 0:
            words[12:14] = ["trash", "can"]
        rows.append((i, " ".join(words).replace("moron", "m0r0n") if i % 3 else " ".join(words)))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    labels = [(i, int(i % 5 == 0)) for i in range(500) if i % 7]
    # Lexicon by counting, matching by looking at each word.
    seen = {0: collections.Counter(), 1: collections.Counter()}
    train = [(dict(rows)[i], y) for i, y in labels if not held(i, 3, 1)]
    for text, y in train:
        seen[y].update(toxicity.features(toxicity.fold(text)))
    n = collections.Counter(y for _, y in train)
    odds = {t: math.log((c + 0.5) / (n[1] + 1)) - math.log((seen[0][t] + 0.5) / (n[0] + 1)) for t, c in seen[1].items() if c >= max(4, 0.003 * n[1])}
    weights = {t: min(6.0, v) for t, v in odds.items() if v >= 3}
    assert weights

    def measure(text):
        folded = toxicity.fold(text or "")
        words = folded.split()
        hidden = [any(f" {' '.join(words[max(0, k - a) : k - a + len(e)])} " == f" {' '.join(e)} " for e in (toxicity.fold(x).split() for x in toxicity.EXCEPTIONS) for a in range(len(e)) if k >= a) for k in range(len(words))]
        mass = sum(max([weights.get(f" {w} ", 0), *[weights.get(f" {w[:m]}", 0) for m in toxicity.PREFIXES if len(w) > m]]) for w, h in zip(words, hidden) if not h)
        return mass, folded.count(" ") - 1

    points = np.array([measure(t) for t, _ in train])
    curve = toxicity.fit_curve(toxicity.signals(points[:, 0], points[:, 1]), np.array([float(y) for _, y in train]))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(d, spark.createDataFrame(labels + [(3, None)], "doc_id bigint, toxic int")).collect()}
    for i, text in [*rows, (900, None), (901, "")]:
        m = np.array([measure(text)])
        p = 1 / (1 + math.exp(-float((toxicity.signals(m[:, 0], m[:, 1]) @ curve)[0])))
        assert got[i].score == pytest.approx(p, abs=1e-6) and got[i].predicted == int(p >= 0.7) and got[i].held_out == held(i, 3, 1)


def test_terms_by_counting(spark):
    """Disclosing terms against a plain count of documents that hold terms, entities and both."""
    rng = np.random.default_rng(13)
    common = [f"common{chr(97 + k)}{chr(97 + j)}" for k in range(8) for j in range(8)]
    rare = [f"rare{chr(97 + k)}{chr(97 + j)}" for k in range(5) for j in range(8)]
    people = [f"p{k}@site.example" for k in range(12)]
    rows = []
    for i in range(400):
        w = list(rng.choice(common, 25))
        if i % 4 == 0:
            k = int(rng.integers(12))
            w.insert(int(rng.integers(25)), people[k])
            w += [rare[k], rare[int(rng.integers(40))]] if i % 8 else [rare[k]]
        elif i % 9 == 0:
            w.append(rare[int(rng.integers(40))])
        rows.append((i, " ".join(w)))
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    letters = re.compile(r"[^\W\d_]{4,}")
    terms_of = {i: set(letters.findall(pattern.sub(" ", t).lower())) for i, t in rows}
    n_term = collections.Counter(x for _, t in rows for x in set(letters.findall(t.lower())))
    has = {i: [(m.group().lower(), t[max(0, m.start() - 60) : m.start()], t[m.end() : m.end() + 60]) for m in pattern.finditer(t)] for i, t in rows}
    n_entity = collections.Counter(e for x in has.values() for e in {y[0] for y in x})
    contexts = collections.defaultdict(set)
    both = collections.Counter()
    for i, found in has.items():
        for x in terms_of[i] if found else ():
            contexts[x].add(found[0][1:])
            both.update((e, x) for e in {y[0] for y in found})
    total = len(rows)
    share = lambda e, x: math.log2(both[e, x] * total / (n_term[x] * n_entity[e])) / math.log2(total / n_entity[e])
    want = {i: sorted(x for x in terms_of[i] if len(contexts[x]) >= 3 and any(share(e, x) >= 0.8 for e in {y[0] for y in found})) for i, found in has.items()}
    assert sum(map(len, want.values())) > 20
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in got:
        text = dict(rows)[r.doc_id]
        hit = sorted({text[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"})
        assert hit == want[r.doc_id]


def test_secrets(spark):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'the token = "{key}" is kept'), (2, "a" * 60), (3, "averyveryverylongwordwithoutdigits"), (4, "1234567890" * 4), (5, None)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = rows[0][1].index(key)
    assert f"secret:{at}:{at + len(key)}" in got[1].spans and got[1].clean_text == 'the token = "[SECRET]" is kept' and got[1].n_spans == got[1].n_secret == 1
    assert all(got[i].n_secret == 0 for i in (2, 3, 4, 5))


NAMES = (
    "_text letter held_out lang_pred score carried row kid tid _kid _tid _copies copies key k1 k2 words lines line gate good hashes windows h i size task first ids shift target whole "
    "bucket plan of fp id v packed runs prefix lo hi grp n c m p seen full rest _t _term terms y label_id near node root"
).split()


@pytest.fixture(scope="module")
def crowded(spark, docs):
    """Documents with a column of every name that operators use inside, a null in each column and a repeated row."""
    rows = docs.limit(40)
    rows = rows.unionByName(rows.limit(1)).unionByName(spark.createDataFrame([(None, None, None, None, None)], rows.schema))
    return rows.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)]).cache()


def test_names_of_columns(spark, crowded):
    n = crowded.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("*", F.lit(1).alias("y"), F.lit(2).alias("label_id"), F.lit("x").alias("text"))
    for out in (
        quality.quality_rules(crowded), simhash.simhash_components(crowded), lm.lm_scores(crowded), langid.language_scores(crowded), mixing.op5_rows(crowded), substring_dedup.remove_repeats(crowded),
        toxicity.toxicity_scores(crowded, labels), pii.personal_data(crowded),
    ):
        assert out.count() == n
    assert packing.pack(crowded).where("start = 0").count() == n
    carried = langid.language_scores(crowded, carry=True)
    assert carried.select("carried.*").columns == crowded.columns and carried.count() == n
    for out, most in ((simhash.drop_near_duplicates(crowded), n - 1), (mixing.mix_documents(crowded), 3 * n), (pii.sanitise(crowded), n)):
        assert out.columns == crowded.columns and 0 < out.count() <= most


def test_no_rows(crowded):
    empty = crowded.where("false")
    for out in (simhash.drop_near_duplicates(empty), mixing.mix_documents(empty), pii.sanitise(empty)):
        assert out.columns == empty.columns and out.count() == 0
