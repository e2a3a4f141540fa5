"""Shortest paths against plain Python, and that hubs cost no pairs of their neighbours."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import graph as g


def table(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long").select("src", "dst", F.lit("t").alias("rel_type"), F.lit(1.0).alias("confidence"))


def shortest(near, a, b, depth):
    paths = [[a]]
    for _ in range(depth + 1):
        hit = [p for p in paths if p[-1] == b]
        if hit:
            return min(hit)
        paths = [[*p, y] for p in paths for y in near.get(p[-1], ()) if y not in p]
    return None


@pytest.mark.parametrize("walks", [1, 16])
def test_paths_of_up_to_four_edges(spark, monkeypatch, walks):
    monkeypatch.setattr(g, "WALKS", walks)
    rand = random.Random(walks)
    # Persons 0-29 and 90, leaves 100-, groups and two hubs, so that pairs lie 2 to 4 edges and more apart.
    edges = [(p, 100 + p // 3) for p in range(30)] + [(p, 200 + rand.randrange(12)) for p in range(30)] + [(200 + i, 300 + i % 4) for i in range(12)] + [(200, 201), (205, 204), (203, 207)] + [(p, 400 + p % 2) for p in range(0, 30, 4)] + [(90, 199)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    pairs = [(a, b) for a in range(30) for b in range(30)] + [(0, 90), (90, 0), (0, 77)]
    want = {p: shortest(near, *p, 4) for p in pairs}
    assert {len(x) - 1 for x in want.values() if x} == {0, 2, 3, 4} and None in want.values()
    got = g.shortest_paths(spark.createDataFrame(pairs, "source long, target long"), table(spark, edges), 4).collect()
    assert {(x.source, x.target): x.path for x in got} == {p: x for p, x in want.items() if x}
    assert all(x.distance == len(x.path) - 1 for x in got) and len(got) == len({(x.source, x.target) for x in got})


def test_a_hub_is_not_squared(spark, monkeypatch):
    # 3,000 persons at one hub and one apart from it each: the next person is 4 edges away. Tables between hold no hub times persons.
    edges = [x for i in range(3000) for x in ((i, 10_000 + i), (10_000 + i, 50_000))]
    sizes, write = [], g.checkpointed

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(g, "checkpointed", counted)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(2999)], "source long, target long")
    got = g.shortest_paths(pairs, table(spark, edges), 4).collect()
    assert {(x.source, x.target): x.path for x in got} == {(i, i + 1): [i, 10_000 + i, 50_000, 10_001 + i, i + 1] for i in range(2999)}
    assert max(sizes) <= 200_000
