"""The corpus pipeline: documents through the operators of ``momentloom.llm``, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.llm import bpe, decontaminate, neardup, pii, quality
from momentloom.llm.common import table
from momentloom.llm.queries import RANKS, SECRET
from momentloom.session import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep, their cutoffs certified on the labelled ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in four fifths of its five-word shingles."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by stand-ins; n_chars follows the new text."""
    changed = pii.pseudonymize(docs, key=SECRET).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return changed.select(*docs.columns)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (base64 of little-endian 32-bit integers) of each text, proven by decoding."""
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    tokens = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    intact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return tokens.select("doc_id", "lang", "source", "n_chars", "n_tokens", F.base64("ids").alias("ids_base64"), intact.alias("intact"))


STAGES = [
    ("quality", good_documents),
    ("near-duplicates", distinct_documents),
    ("decontamination", unseen_documents),
    ("private-data", private_documents),
    ("byte-bpe", encoded_documents),
]

#: Near-duplicates, stand-ins and tokens are not SQL; the result is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
