"""From raw documents to a sharded training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it sees only what its
predecessor kept, written as Parquet and read again. All but the last return the columns of
documents; the last adds the shard and the slot in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pliego.llm import decontam, mixing, near_copies, resharding, toxicity
from pliego.llm.base import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Near-duplicates share 0.8 of their five-word shingles or more.
    """
    return near_copies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix of their sources draws them."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard (0 to 15, near equal bytes) and slot."""
    return resharding.resharded(docs, shards=16).select("row.*", "shard", "slot")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the classifier or the edit matching; tests compare with a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
