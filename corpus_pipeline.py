"""A corpus pipeline of five of the operators, each stage's output the next's input.

Stages return the columns of documents, extra ones included, whatever their names;
the last returns packed pieces. A null or empty text, and one without a letter, fails
the base rules. Rows that repeat an id are rows of their own up to near_dedup, which
keeps one row of each group of near copies, repeats and null ids included. A very
long text is read whole by every stage. An empty table gives no rows; without labels
the base rules alone decide, and without learnable languages no document is told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import language_id, minhash_dedup, packing, pii, quality_rules
from trialspark.llm.common import apart, quoted, table, written

#: A language is taken as told when its posterior probability is this, at least.
SURE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    ratio = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return apart(docs, ("doc_id", "text"), lambda d: quality_rules.judge(d, ratio).where("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang becomes the told one."""
    model = language_id.fit(docs)

    def told(d: DataFrame) -> DataFrame:
        named = language_id.identify(d, model)
        return named.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).withColumn("lang", F.col("lang_pred"))

    return apart(docs, ("doc_id", "text", "lang"), told)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five words and a similarity of 0.8."""
    return minhash_dedup.dedup(docs, minhash_dedup.Near()).select(*quoted(docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers masked in the texts; n_chars counts the new text."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast("long"))
    return masked.select(*quoted(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near_dedup), ("pii", personal_data), ("packing", pack)]

#: Hashed counts and tokenizers have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
