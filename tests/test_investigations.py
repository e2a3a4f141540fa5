"""What is found from one row of an investigation, against the joins that take investigations of any size."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import findings as b
from casegraph.operators import risk as k

FINDING = "investigation_id long, rule int, title string, severity string, confidence double, entity_ids array<long>, evidence_ids array<long>, relationship_ids array<long>"
REL = "investigation_id long, id long, source_entity_id long, target_entity_id long, relationship_type string, confidence double, evidence_id long"


def odd_findings(seed, n=160):
    """Few ids, so that groups overlap; equal findings, empty lists, confidence 0, an investigation without an id."""
    r = random.Random(seed)
    ids = lambda most, least=0: sorted(r.sample(range(7), r.randint(least, most)))
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.randint(1, 5), r.choice(list(b.TITLES.values())), r.choice(["high", "medium", "low"]), r.choice([0.0, 0.5, 0.82, 0.9]), ids(2, 1), ids(3), r.choice([[], ids(3)])) for _ in range(n)]
    return rows + rows[:9]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_signals_of_rows_are_those_of_joins(spark, seed):
    f = spark.createDataFrame(odd_findings(seed), FINDING)
    rows = lambda local: sorted(map(str, k.finding_risk(f, local).collect()))
    assert rows(k.LOCAL) == rows(0) == rows(70)


def test_links_of_findings_hold_no_lists(spark):
    """Each id of a finding used to carry the finding's lists: a finding of 3,000 ids made rows of 9 million."""
    f = spark.createDataFrame([(1, 3, "x", "high", 0.9, [1], list(range(3000)), list(range(3000)))], FINDING).withColumn("fid", F.lit(1).cast("long")).withColumn("iv", F.lit("1")).withColumn("place", F.lit(1)).withColumn("w", F.lit(1.0)).withColumn("c", F.lit(1.0))
    assert not any(kind.startswith("array") or "array" in kind for _, kind in k._groups_of(f, "relationship_ids").dtypes)
    assert k._groups_of(f, "relationship_ids").count() == 3000


def odd_relationships(seed, n=70):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, 3, None]), i, r.randrange(12), r.randrange(12), r.choice(["a", "b", "c"]), r.choice([0.5, 0.8, 0.9]), r.choice([None, r.randrange(9)])) for i in range(n)]
    chain = [(4, 1000 + i, 50 - i, 49 - i, "a", 0.9, None) for i in range(8)]
    return rows + rows[:5] + chain


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_of_rows_are_those_of_joins(spark, seed):
    r = b.valid(spark.createDataFrame(odd_relationships(seed, 45), REL))
    base = b.base_of(r)
    rows = lambda df: sorted(map(str, df.select("investigation_id", "a", "b", "distance", "path").collect()))
    assert rows(b.indirect_paths(r)) == rows(b._paths_by_joins(r.where("investigation_id is not null"), 4)) == rows(b.indirect_paths(r, local=20))
    found = lambda df: sorted(map(str, df.select("investigation_id", "a", "b", "distance", "path", "h").collect()))
    assert found(b.reinforced_paths(r, base)) == found(b._reinforced_by_joins(b._paths_by_joins(r, 4), base))


def test_paths_make_one_shuffle_of_pairs(spark):
    """A round of joins and groupings for each distance used to shuffle and write all pairs with their paths."""
    r = b.valid(spark.createDataFrame(odd_relationships(1), REL))
    assert b.indirect_paths(r)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    wedges = b.b24(r)
    assert "transform" not in wedges._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, wedges.collect())) == sorted(map(str, b._finding(b.typed_wedges(r), 24, F.lit(0.83), None, F.array_sort(F.array("a", "m", "b"))).collect()))
