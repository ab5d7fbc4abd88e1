"""A corpus pipeline of five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last adds the
tokens. ``run`` writes each stage's result to the shared folder and reads it back.

Defined results: null and empty texts fail the base test of the rules and go in the first stage; a stage alone treats a null text as an
empty one. doc_id may be null, equal on several rows or tied: rows are told apart by their text, and of rows with equal text one stays
(the least doc_id, nulls last) in the second stage. Texts of any length are handled whole. Columns beside those of documents
pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.bpe import bpe_encode
from strataweave.llm.decontamination import without_contaminated
from strataweave.llm.minhash_dedup import one_of_each
from strataweave.llm.pii import find_pii
from strataweave.llm.quality_rules import apply_rules
from strataweave.llm.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; repeated rows are judged alike. Null and empty texts go."""
    return apply_rules(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays (nulls last; of equal ones that with the least MD5 of its text, once)."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each for its own text. Null and empty texts and items match nothing."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind in brackets; n_chars follows (null for a null text)."""
    return find_pii(docs, redact=True).drop("pii").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and the token ids (little-endian unsigned 32-bit integers); null and empty texts have no tokens."""
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("bpe", tokens)]

#: SQL cannot express the samples of the near-duplicate stage, the transducers or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
