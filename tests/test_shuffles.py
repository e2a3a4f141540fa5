"""Intermediate tables keep no shuffle files of the queries that wrote them."""

import time

import pytest
from pyspark.sql import functions as F

from casegraph.operators import graph as g


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        if (name := files.next().getName()).startswith("shuffle_"):
            found.add(name)
    return found


@pytest.mark.parametrize("package", ["graph", "llm"])
def test_written_tables_leave_no_shuffles(spark, package):
    if package == "llm":
        common = pytest.importorskip("casegraph.llm.common")
    writers = [g.checkpointed] if package == "graph" else [common.written]
    before, setting = shuffle_files(spark), spark.conf.get(g.CLEANUP)
    tables = [w(spark.range(10_000).groupBy((F.col("id") % 977).alias("k")).agg(F.count("*").alias("n"))) for w in writers]
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert [t.count() for t in tables] == [977] * len(writers) and spark.conf.get(g.CLEANUP) == setting
