"""Documents to shards: quality rules, near copies, benchmark leaks, source weights, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm import decontaminate, mixing, nearcopies, quality, sharding
from casegraph.llm.common import shared_folder, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the default policy rejects."""
    return quality.filtered(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: 5-word shingles, Jaccard similarity 0.8 or more. SimHash groups (op2's
    fingerprints and index) come first and are checked exactly; MinHash finds what 4 bits leave."""
    return nearcopies.deduplicated(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.filtered(docs, table(spark, sf_dir, "benchmark"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once at least, documents of small sources more often, up to the target weights."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot."""
    return sharding.sharded(docs).withColumn("grown_shard", F.lit(None).cast("int"))


STAGES = [("quality_rules", rules), ("near_copies", near_copies), ("benchmark_leaks", leaks), ("source_weights", weights), ("shards", shards)]

#: Fingerprints are XXH64 and shards follow a bisection over hashes, which SQL can't express; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. The tables between them go to the folder that the cluster shares."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
