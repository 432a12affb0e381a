"""A corpus pipeline: quality rules, toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns the columns of `documents`, but for the last, which returns a row of
token ids' digests per document. run() writes each stage's rows to the shared
folder, so that a lost executor costs a task and not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, pieces, quality_rules, toxicity
from tidemark.llm.common import Workspace, held_out
from tidemark.llm.queries import piece_model

TOXIC_FROM = 0.3


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality_rules.keep_documents(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM; the model learns from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 4, 2))
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, "toxic", copies_once=True)
    rows = toxicity.scored(docs, model, docs.columns, name="toxic_score__")
    return rows.where(rows["toxic_score__"] < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least id, of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_first(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weights, one epoch in all, shuffled globally."""
    return mixing.mix(docs, epochs=1.0, seed=7).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests per document row."""
    return pieces.tokenize(docs, piece_model(), digests_only=True)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The toxicity model and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if before:  # a stage's rows are on disk before its predecessor's go
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
