"""A corpus pipeline of five of the llm subpackage's operators.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns documents
with the columns they came with; the last adds shard and slot. A stage's result is written as
Parquet in the shared folder and read again as the next one's documents; the copy before goes then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import contamination, jaccard, mixing, sharding, toxicity
from pathloom.llm.common import removed, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, doesn't reject."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect."""
    return jaccard.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot."""
    return sharding.shard(docs, adding=("shard", "slot"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
    ("sharding", place_in_shards),
]

#: The toxicity model is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return docs
