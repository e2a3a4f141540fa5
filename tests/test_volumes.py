"""What the finding rules read and hold: each table once, ids once, no rows of one key in one task."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import findings as b
from casegraph.operators import graph as g
from casegraph.plans import adapters as m

SF = "/root/testdata/sf0.001"
SCHEMA = "investigation_id long, id long, source_entity_id long, target_entity_id long, relationship_type string, confidence double, evidence_id long"


def scans(df, table):
    return df._jdf.queryExecution().optimizedPlan().toString().count(table)


def test_lines_are_read_once(spark):
    """Each kind of relationship used to read and join the lines on its own: two and four times."""
    lines = len(m.read(spark, SF, "lineitem").inputFiles())
    assert lines == 1
    for df in (m.relationships(spark, SF), m.finding_relationships(spark, SF)):
        assert df._jdf.queryExecution().executedPlan().toString().count("l_discount#") > 0
        assert scans(df, "RepartitionByExpression") == 1
        assert scans(df, "l_linenumber") > 0 and scans(df, "Aggregate [l_orderkey") == 1


def odd_relationships(seed, n=400):
    """Few entities and kinds, loops, repeated rows and ids, null evidence, confidences at the bounds."""
    rnd = random.Random(seed)
    rows = [(rnd.randrange(3), i, rnd.randrange(9), rnd.randrange(9), rnd.choice(["a", "B", " b "]), rnd.choice([None, 0.1, 0.75, 0.7996, 0.79951, 0.8, 0.85, 0.9, 1.0, 7.0]), rnd.choice([None, rnd.randrange(40)])) for i in range(n // 2)]
    rows += [(9 + i, 1000 + i, 1, rnd.choice([1, 2]), "a", rnd.choice([0.5, 0.8]), rnd.choice([None, 5])) for i in range(n // 2)]
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_without_findings_are_those_of_the_findings(spark, seed):
    r = b.valid(spark.createDataFrame(odd_relationships(seed), SCHEMA))
    key = lambda df: sorted(map(tuple, df.select("investigation_id", "x", "h", "k", "titles", "rel", "ev").collect()))
    base = b.b1(r).union(b.b2(r)).union(b.b3(r)).union(b.b4(r)).union(b.b5(r))
    assert key(b.high_counts_of(r)) == key(b.high_counts(base))
    assert sorted(map(str, base.collect())) == sorted(map(str, b.base_of(r).collect()))


def test_components_with_a_hub_and_chains(spark):
    """A hub of half of all pairs, a chain, and a ladder, by group; compared with a plain search."""
    pairs = [(0, 5000, i) for i in range(3000)] + [(1, i, i + 1) for i in range(200)] + [(1, 300 + i, 300 + i // 2) for i in range(1, 64)]
    found = g.components(spark.createDataFrame([(k, x) for k, a, c in pairs for x in (a, c)] + [(2, 7)], "k int, node_id long"), spark.createDataFrame(pairs, "k int, src long, dst long"), by=["k"])
    got = {(r.k, r.node_id): r.component for r in found.collect()}
    want = {(0, i): 0 for i in [*range(3000), 5000]} | {(1, i): 0 for i in range(201)} | {(1, 300 + i): 300 for i in range(64)} | {(2, 7): 7}
    assert got == want


def test_intermediate_tables_are_compressed(spark, tmp_path):
    rows = spark.range(200_000).select(F.lit("one and the same text").alias("t"), (F.col("id") % 3).alias("k"))
    path = g.checkpointed(rows).inputFiles()
    assert path and all(x.endswith(".parquet") for x in path)


def test_document_confidence_does_not_depend_on_the_order(spark):
    """Means whose tie falls on a digit: 0.2 + 0.4 * mean(0.9, 0.85, 0.9, 0.9) + 0.4 * 0.9 is 0.915; sums of another order gave either side of ties."""
    from casegraph.operators import text as t

    values = [0.99, 0.82, 0.45, 0.9, 0.88, 0.85, 0.86, 0.75]
    got = set()
    for turn in range(8):
        found = spark.createDataFrame([(1, c) for c in values[turn:] + values[:turn]], "doc_id long, confidence double").coalesce(1)
        rel = spark.createDataFrame([(1, 0.45), (1, 0.855)], "doc_id long, confidence double")
        docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
        got |= {r.confidence for r in t.document_confidence(docs, found, rel).collect()}
    assert len(got) == 1


def test_neighbourhoods_are_searched_once(spark):
    """A search of depth 2 used to form the edges in each round, and the summary searched twice."""
    from casegraph.operators import analytics as a

    edges = spark.createDataFrame([(i, i + 1, "knows", 0.5) for i in range(6)] + [(9, 9, "knows", 0.5)], "src long, dst long, rel_type string, confidence double")
    nodes = spark.createDataFrame([(i, "person" if i % 2 else None, str(i)) for i in range(10)], "node_id long, entity_type string, value string")
    found = a.neighbourhood_summary(spark.createDataFrame([(0,), (3,), (9,)], "seed_id long"), nodes, edges, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("src#") == 0
    assert {r.seed: (r.neighbour_count, r.type_counts, r.density) for r in found.collect()} == {0: (2, {"person": 1}, 0.5), 3: (4, {"person": 2}, 0.25), 9: (0, {}, 0.0)}
