"""Articulation points of a graph that is two thousand levels deep, with a hub of 3,000 neighbours; typed wedges by their middles."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.operators import blocks
from casegraph.operators import findings as b


def test_long_chain_and_hub(spark):
    row = lambda s, t: ("1L as investigation_id", "id", f"{s} as source_entity_id", f"{t} as target_entity_id", "'knows' as relationship_type", "0.5d as confidence", "cast(null as long) as evidence_id")
    chain = spark.range(1_999).selectExpr(*row("id", "id + 1"))
    hub = spark.range(3_000).selectExpr(*row("20000L", "30000 + id"))
    ties = spark.range(1).selectExpr(*row("1000L", "20000L")).union(spark.range(1).selectExpr(*row("1500L", "1200L")))
    r = b.valid(chain.union(hub).union(ties))
    nodes = r.select("investigation_id", F.explode(F.array("s", "t")).alias("x")).distinct()
    comp = nodes.withColumn("component", F.lit(0).cast("long")).withColumn("size", F.lit(5_001).cast("long"))
    found = {x.x for x in b.articulation_points(r, comp).collect()}
    assert found == (set(range(1, 1_999)) - set(range(1_201, 1_500))) | {20_000}


def test_forest_of_nothing(spark):
    none = spark.createDataFrame([], "x long, y long")
    assert blocks.spanning_forest(none).count() == 0
    assert blocks.blocks(none, spark.createDataFrame([], "x long, component long")).count() == 0


def test_typed_middles_count_their_wedges(spark):
    import collections
    import random

    rand = random.Random(1)
    rows = [(i % 2, i, rand.randrange(12), rand.randrange(12), rand.choice(["knows", "uses", "calls"]), 0.5, None) for i in range(90)]
    r = b.valid(spark.createDataFrame(rows, "investigation_id long, id long, source_entity_id long, target_entity_id long, relationship_type string, confidence double, evidence_id long"))
    legs = b.typed_legs(r)
    wedges = b.typed_wedges(r).collect()
    times = collections.Counter((w.investigation_id, w.m) for w in wedges)
    assert {(x.investigation_id, x.m): x.wedges for x in b.typed_middles(legs).collect()} == times and times
    some = spark.createDataFrame([(0, 3), (1, 5)], "investigation_id long, m long")
    assert sorted(map(tuple, b.typed_wedges(r, some).collect())) == sorted(tuple(w) for w in wedges if (w.investigation_id, w.m) in ((0, 3), (1, 5)))
