"""The text pipeline: rejects toxic documents, drops exact and near copies, cuts repeated strings, packs what is left.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. Texts may be null or empty
anywhere; columns that the stages do not read are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from saccade.llm import exact, packing, simhash, substrings, toxicity
from saccade.llm.common import read_table
from saccade.session import scratch_path

#: Length of the strings that the stage cuts; op1's own is 400. Passages of over 50 words have to be found: at 6 to 7 bytes a
#: word they begin at some 310 bytes, and 200 holds down to 4 bytes a word.
REPEAT_BYTES = 200


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as not toxic. The model learns from the labelled documents of the same input."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal normalised texts: the one with the smallest id."""
    return exact.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (0.8 or more of the distinct five-word shingles in common): the one with
    the smallest id. This is the stages' rule; op6 links fingerprints of four-word shingles within 4 bits."""
    return simhash.drop_similar(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of ``REPEAT_BYTES`` bytes that occur again in the corpus."""
    return substrings.remove_repeats(docs, REPEAT_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near),
          ("suffix_dedup", cut_repeats), ("packing", pack)]

#: SQL can express neither the scores nor the similar sets nor the ids. tests/llm/test_pipeline.py holds the stages of near copies
#: and repeats against plain versions; toxicity, exact copies and packing have no such test as stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
