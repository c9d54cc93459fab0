"""The corpus pipeline: toxicity, exact copies, near copies, mixing to weights, and tokens, one stage after another.

Each stage takes ``(spark, docs, sf_dir)``. :func:`run` writes what a stage keeps as Parquet in the shared folder and
reads it back as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from gaugework.llm.common import materialise_last
from gaugework.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX_WEIGHTS = [5, 2, 1]
MIX_SHARE = 1.5
MIX_EPOCHS = 2
VOCABULARY = "byte_bpe_50k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled ones among them."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), load(spark, sf_dir, "labels").select("doc_id", "toxic"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts (five-word shingles, 0.75) the document with the smallest id."""
    return jaccard_join.drop_near_duplicates(docs.select(*COLUMNS), width=5, percent=75)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the proportions of their sources' weights: each as a row for every time it is taken."""
    return mixing.mix(docs.select(*COLUMNS), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decoded`` of every row: ids as little-endian 32-bit integers."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id", "source"])


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Neither the fitted model, the similarity join nor the vocabulary has a form in SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # what the stage wrote on its way goes once its documents are written
        docs = materialise_last(partial(stage, spark, docs, sf_dir), spark, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
