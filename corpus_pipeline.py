"""A training-data pipeline over ``documents``: five of the operators, one after another.

Each stage reads what the stage before has written and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.llm.langid import UNKNOWN, language_scores
from cellspark.llm.mixing import mix_documents
from cellspark.llm.packing import pack
from cellspark.llm.pii import sanitise
from cellspark.llm.simhash import drop_near_duplicates
from cellspark.llm.storage import scratch, staged

#: A document whose best language has a lower posterior is rejected.
LEAST_SCORE = 0.5
#: So is one whose words that language explains no better than e to this times equally likely pieces, on average.
LEAST_FIT = 1.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null texts among them, those of no clear language, and those of none that the rows' labels teach. Equal rows are treated alike; of an empty table nothing is left."""
    scored = language_scores(docs, hold_out=False, carry=True)
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("fit") >= LEAST_FIT)).select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: candidates by SimHash fingerprints within four bits, through the covering of op2, and by MinHash bands for the less similar; then exactly, by sets of five-word shingles, a similarity of 0.8 or more; of several the smallest id, of equal rows one, of wordless texts one."""
    return drop_near_duplicates(docs, width=5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and counts their characters again. All rows stay; a null text becomes empty."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources, null as one, come to their target weights; ids and ties are ordered by a seeded hash."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; a null text has its end alone, repeated rows are packed repeatedly."""
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL has no byte-pair encoding, no XXH64 and no EM; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 < len(STAGES):
            # What a stage has staged for itself goes once its rows are written.
            with scratch(spark) as keep:
                docs = keep(staged(stage(spark, docs, sf_dir), f"stage-{name}"))
        else:
            docs = stage(spark, docs, sf_dir)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
