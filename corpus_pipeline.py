"""Corpus pipeline over ``documents``: quality filter, exact and near dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; the stages
before the last return the columns of ``documents``.  ``run`` writes every stage as Parquet into the
shared folder and rereads it, so a lost executor costs only running tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticeflow.llm import block_naming, byte_bpe, byte_cnn, mixing, simhash
from noticeflow.llm.common import Scratch, read
from noticeflow.llm.queries import default_vocabulary


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level classifier does not reject."""
    return byte_cnn.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the longest original."""
    return block_naming.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a five-word similarity of 0.8 or more, the document with the smallest id."""
    return simhash.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy that the mix takes, shuffled within its shards."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and decoded bytes."""
    tokens = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), *default_vocabulary())
    return byte_bpe.digest(tokens, "doc_id", keep=("source", "ids"))


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mixing", mix_sources),
    ("token ids", encode),
]

#: Classifier, fingerprints and token ids are not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per document copy of the mix."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        new = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
