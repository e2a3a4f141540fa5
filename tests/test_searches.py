"""Nodes within some edges of many seeds, by pairs and by bits of blocks, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import graph as g


@pytest.fixture(scope="module")
def graph():
    rand = random.Random(8)
    edges = [(rand.randrange(400), 1000 + rand.randrange(60)) for _ in range(700)] + [(1000 + i, 2000 + i % 3) for i in range(60)] + [(3000 + i, 3001 + i) for i in range(8)] + [(5, 5)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return edges, near


def within(near, seeds, depth):
    out = set()
    for s in seeds:
        at, front = {s: 0}, [s]
        for d in range(1, depth + 1):
            front = [y for x in front for y in near.get(x, ()) if y not in at and not at.update({y: d})]
        out |= {(s, x, d) for x, d in at.items()}
    return out


@pytest.mark.parametrize("depth", [3, 4])
def test_pairs_and_bits_find_the_same(spark, graph, depth):
    edges, near = graph
    df = spark.createDataFrame(edges, "src long, dst long").select("src", "dst", F.lit("t").alias("rel_type"), F.lit(1.0).alias("confidence"))
    seeds = [*range(0, 400, 3), 3000, 3004, 7777] + list(range(1000, 1030))
    own = spark.createDataFrame([(s,) for s in seeds] * 2, "seed_id long")
    expected = within(near, seeds, depth)
    for dense in (0, g.DENSE, 1e9):
        got = [tuple(x) for x in g.k_hop(own, df, depth, include_seed=True, dense=dense).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_hubs_are_met_once_for_many_seeds(spark, monkeypatch):
    """200 seeds at one hub of 3,000: 600,000 pairs used to be shuffled at once, and 200 rows for each edge behind them."""
    written, write = [], g.checkpointed

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(g, "checkpointed", counted)
    edges = [(i, 10**6) for i in range(3000)] + [(i, 10**7 + i) for i in range(3000)]
    df = spark.createDataFrame(edges, "src long, dst long").select("src", "dst", F.lit("t").alias("rel_type"), F.lit(1.0).alias("confidence"))
    got = g.k_hop(spark.createDataFrame([(s,) for s in range(200)], "seed_id long"), df, 3)
    assert got.groupBy("distance").count().orderBy("distance").collect() == [(1, 400), (2, 200 * 2999), (3, 200 * 2999)]
    assert max(written) <= 12_000


def test_numbers_go_on_over_partitions(spark):
    rows = [(i * 7919 % 5000,) for i in range(5000)]
    got = g.numbered(spark.createDataFrame(rows, "v long").repartition(9), F.desc("v")).collect()
    assert sorted((x.n, x.v) for x in got) == [(i, 4999 - i) for i in range(5000)]
