"""What the training-data operators share: reading texts from Arrow, cutting lineage, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte as it is.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(array: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only a local master may do without the setting: it has no other machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (shared or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


#: Spark's setting by which the shuffle files of a query are removed as it ends, rather than when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside is read from its table only, so its shuffle files go at once; steps of many rounds would else keep those of all rounds."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the folder that the cluster shares, so that a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, group_bytes: int = 0) -> DataFrame:
    """df as a Parquet table in the folder that the cluster shares, read again; later passes read only what they need.

    Row groups of group_bytes, if given: writer and reader hold one at a time, which matters where rows are large."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable over undirected edges (a, b).

    Large-star and small-star rounds on DataFrames. Every node ends up next to its component's
    smallest node after about log(n) rounds. A round's edges go to a table in the shared folder;
    only their count and checksum reach the driver. Nodes without an edge are not returned.
    """
    pairs = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )

    def mark(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = mark(pairs)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, low, ["u"], "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        pairs = written(small)
        after = mark(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(pairs.select("v", "v").distinct())


#: A key is hot if it has more than one in HOT of all rows; there are HOT such keys at most.
HOT = 2000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with keyed, whose keys are unique and whose `count` is their number of rows, of `total` in all.

    The few hot keys are broadcast, so that no task gets all rows of one; the others meet in a shuffle, or as Spark chooses.
    """
    hot = keyed.where(F.col(count) * HOT > total)
    met = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(count) * HOT <= total), on)
    return met.unionByName(rest)
