"""The corpus pipeline: each stage calls one training-data operator on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import lines, mixing, packing, simhash, toxicity
from riskweave.llm.common import Scratch, load


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, scores as toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones, to a few edits, go; no document does."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: texts with 0.8 or more of their five-word shingles in common.

    The pigeonring join of SimHashes finds groups of such texts, keys of least hashes those further apart.
    """
    scratch = Scratch(spark, "near")
    return simhash.keep_one(docs, scratch, simhash.near_duplicates(docs, scratch))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a text that is taken twice comes out twice."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token of the mix goes."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Classifiers, SimHash and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is written to the shared folder and reread, what it no longer needs removed."""
    scratch, docs = Scratch(spark, "pipeline"), load(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        mark = len(Scratch.live)
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop_since(mark)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
