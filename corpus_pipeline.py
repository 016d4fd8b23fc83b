"""The corpus pipeline: documents in, packed training sequences out.

Stages, in order: drop toxic documents, drop exact copies, keep one document of
each near-duplicate group, mix the sources to their target weights, pack. Each
stage works on everything that the one before kept, gets it from Parquet in the
shared checkpoint folder, and all but the last return the columns of
``documents``. A lost executor costs the tasks it ran; finished stages are files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchmart.llm import exact_dedup, minhash, mixing, packing, toxicity
from matchmart.llm.common import load, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the labels are the corpus's."""
    return toxicity.clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return minhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's repetition rate says."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack", pack),
]

#: the toxicity stage trains a network, which SQL cannot express; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
