"""Personal data: patterns, and terms that give a protected entity away. Built-in expressions only.

Base spans come from four patterns. Each of their values is a protected entity. How
strongly a term discloses an entity is their pointwise mutual information over the corpus,
as a share of the entity's own information: 1 if the term occurs with that entity only.
Terms of an entity's documents that reach ``disclosure``, and come with entities of its kind
in at least ``evidence`` different contexts (copies of a text count once), are hidden in the
documents that hold the entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspark.llm.storage import scratch, staged

#: The kinds in their order. Look-behinds and possessive repeats only save
#: time: a match never starts inside a run that it could have started with.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Fixed value: a run that may be a key or a password.
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = (*PATTERNS, "secret", "term")
#: Marks around a match; the text's own are replaced first.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
#: Different characters that a secret has at least: three bits for each one drawn.
LEAST_KINDS = 8
_SPANS = "array<struct<s:int,e:int,m:string>>"


def spans(text: Column, pattern: Column, valid: Callable[[Column], Column]) -> Column:
    """Start, end (exclusive, code points) and string of the leftmost non-overlapping matches that are valid."""
    parts = F.split(F.regexp_replace(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f"{OPEN}$1{CLOSE}")), OPEN)
    start = F.struct(F.lit(-1).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(a: Column, p: Column) -> Column:
        match = F.substring_index(p, CLOSE, 1)
        here = F.struct(a.at.alias("s"), (a.at + F.length(match)).alias("e"), match.alias("m"))
        # The first part, before any match, has no mark at its end.
        return F.struct(
            F.when(a.at < 0, F.length(p)).otherwise(a.at + F.length(p) - 1).alias("at"),
            F.when((a.at >= 0) & valid(match), F.concat(a.out, F.array(here))).otherwise(a.out).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda a: a.out)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _byte),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
#: What a text must have for a kind to be looked for at all.
GATES: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds a column of spans for each base kind to ``rows`` with a column ``_t``."""
    t = F.col("_t")
    return rows.select("*", *[F.when(GATES[k](t), spans(t, F.lit(p), VALID[k])).otherwise(F.array().cast(_SPANS)).alias(f"_{k}") for k, p in PATTERNS.items()])


def secret_spans(t: Column) -> Column:
    """Spans of keys: long runs with letters and digits whose characters hardly repeat. Nothing in a text predicts them, so all they say is about their owner."""
    valid = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= LEAST_KINDS) & (F.length(_digits(m)) * 8 >= F.length(m))
    return F.when(t.rlike("[A-Za-z0-9+/_-]{20}"), spans(t, F.lit(SECRET), valid)).otherwise(F.array().cast(_SPANS))


def disclosing_terms(found: DataFrame, context: int = 60, evidence: int = 3, disclosure: float = 0.8) -> DataFrame:
    """``k1, k2, terms`` of the rows of ``found`` in which a term anywhere in the text discloses an entity of the text.

    Words of four letters or more outside e-mail addresses are terms. The evidence of a term is
    in how many different contexts, of different documents, it comes with the entity's kind, so
    that an entity seen once can be given away too; the disclosure is that of the entity itself.
    """
    entities = lambda k: F.transform(f"_{k}", lambda x: F.struct(F.lit(k).alias("kind"), x.s.alias("s"), x.e.alias("e"), F.concat(F.lit(f"{k}:"), F.lower(x.m)).alias("entity")))
    every = F.concat(*map(entities, PATTERNS))
    beside = f"transform(_x, x -> struct(x.kind, x.entity, xxhash64(substring(_t, greatest(x.s - {context}, 0) + 1, x.s - greatest(x.s - {context}, 0)), substring(_t, x.e + 1, {context})) AS context))"
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{4,}"), F.lit(0)))
    bare = F.regexp_replace("_t", PATTERNS["email"], " ")
    holders = staged(found.where(F.size(F.concat(*[F.col(f"_{k}") for k in PATTERNS])) > 0).select("k1", "k2", "_t", every.alias("_x")).select("k1", "k2", words(bare).alias("words"), F.expr(beside).alias("x")), "holders")
    seen = holders.select("k1", "k2", F.explode("x").alias("x")).select("k1", "k2", "x.kind", "x.entity", "x.context")
    n_entity = seen.select("entity", "k1", "k2").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = F.lit(float(max(found.count(), 1)))
    whose = staged(seen.select("k1", "k2", "kind", "entity").distinct().join(n_entity, "entity").where(F.col("n_entity") < total), "entities")
    terms = holders.select("k1", "k2", F.explode("words").alias("term")).distinct()
    # A term in more documents than this can't reach the disclosure of an entity in n documents, as they have at most n in common.
    bound = lambda n: F.pow(total, F.lit(1 - disclosure)) * F.pow(n, F.lit(disclosure)) * 1.000001
    reach = whose.groupBy("k1", "k2", "kind").agg(bound(F.max("n_entity")).alias("reach"))
    # A document counts with one context for each kind, whatever the number of its entities.
    contexts = seen.groupBy("k1", "k2", "kind").agg(F.min("context").alias("context")).join(reach, ["k1", "k2", "kind"])
    each = terms.join(contexts, ["k1", "k2"]).groupBy("kind", "term", "context").agg(F.max("reach").alias("reach"))
    shown = each.groupBy("kind", "term").agg(F.count("*").alias("contexts"), F.max("reach").alias("reach")).where(F.col("contexts") >= evidence).alias("x")
    # How many documents hold each term: words are counted before they meet the candidates, as a candidate may be frequent.
    held = found.select(F.explode(words(F.col("_t"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).alias("h")
    candidates = staged(shown.join(held, (F.col("x.term") == F.col("h.term")) & (F.col("h.n_term") <= F.col("x.reach"))).select("kind", "x.term", "n_term"), "candidates").alias("c")
    inside = terms.join(reach, ["k1", "k2"]).alias("y").join(candidates, (F.col("y.kind") == F.col("c.kind")) & (F.col("y.term") == F.col("c.term")) & (F.col("c.n_term") <= F.col("y.reach"))).select("y.*", "c.n_term")
    pairs = staged(
        inside.join(whose, ["k1", "k2", "kind"]).where(F.col("n_term") <= bound(F.col("n_entity"))).select("k1", "k2", "entity", "term", "n_term", "n_entity"),
        "pairs",
    )
    share = F.log2(F.col("n_both") * total / (F.col("n_term") * F.col("n_entity"))) / F.log2(total / F.col("n_entity"))
    telling = pairs.groupBy("entity", "term", "n_term", "n_entity").agg(F.count("*").alias("n_both")).where(share >= disclosure).select("entity", "term")
    return pairs.join(telling, ["entity", "term"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3, disclosure: float = 0.8, carry: bool = False) -> DataFrame:
    """Spans of personal data and the sanitised text of each row of ``docs``.

    Columns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term,
    n_spans, clean_text``; ``n_spans`` counts all kinds.
    ``spans`` lists kind:start:end (code points, end exclusive) by kind, then start, joined
    by commas; ``base_sha256`` is the hash of the same list without terms. In ``clean_text``
    each stretch is replaced by its kind in brackets (of overlapping ones, the first). With
    ``carry``, the other columns of ``docs`` come as a struct ``carried``. A null text is empty; a text without spans is unchanged; repeated rows come out repeated;
    an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [c for c in docs.columns if c != text_col]
    carried = F.struct(*others).alias("carried") if carry and others else F.lit(None).alias("carried")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), carried).select("*", F.translate("_text", OPEN + CLOSE, OTHER * 2).alias("_t"))
    keyed = base_spans(rows.select("*", F.xxhash64("doc_id", "_text").alias("k1"), F.xxhash64(F.lit(7), "_text", "doc_id").alias("k2")))
    with scratch(docs.sparkSession) as keep:
        terms = keep(staged(disclosing_terms(keyed, evidence=evidence, disclosure=disclosure), "terms"))
    joined = keyed.join(terms, ["k1", "k2"], "left")
    term_pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    every = joined.select("*", F.when(F.col("terms").isNotNull(), spans(F.col("_t"), term_pattern, lambda m: F.lit(True))).otherwise(F.array().cast(_SPANS)).alias("_term"), secret_spans(F.col("_t")).alias("_secret"))
    listed = lambda k: F.transform(f"_{k}", lambda x: F.concat_ws(":", F.lit(k), x.s.cast("string"), x.e.cast("string")))
    base = F.array_join(F.concat(*map(listed, PATTERNS)), ",")
    named = lambda k: F.transform(f"_{k}", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(k.upper()).alias("k")))
    tagged = F.array_sort(F.concat(*map(named, KINDS)))
    rebuilt = F.aggregate(
        tagged,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x.s >= a.at, F.struct(x.e.alias("at"), F.concat(a.out, F.substring(F.col("_text"), a.at + 1, x.s - a.at), F.lit("["), x.k, F.lit("]")).alias("out"))).otherwise(
            F.struct(F.greatest(a.at, x.e).alias("at"), a.out.alias("out"))
        ),
        lambda a: F.concat(a.out, F.substring(F.col("_text"), a.at + 1, F.length("_text"))),
    )
    return every.select(
        "doc_id",
        *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*map(listed, KINDS)), ",").alias("spans"),
        F.size("_secret").cast("bigint").alias("n_secret"),
        F.size("_term").cast("bigint").alias("n_term"),
        sum((F.size(f"_{k}") for k in KINDS), F.lit(0)).cast("bigint").alias("n_spans"),
        F.when(F.size(tagged) > 0, rebuilt).otherwise(F.col("_text")).alias("clean_text"),
        *(["carried"] if carry else []),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3, disclosure: float = 0.8) -> DataFrame:
    """``docs``, all rows and columns, with the text sanitised.

    A null text becomes empty; a null id is an id like any other; repeated rows come out
    repeated; an empty table stays empty; other columns may have any name.
    """
    out = personal_data(docs, id_col, text_col, evidence, disclosure, carry=True)
    return out.select(*[F.col("clean_text").alias(c) if c == text_col else F.col("carried").getField(c).alias(c) for c in docs.columns])
