"""Similar entities by classes of equal key sets, against brute force, and where thousands of nodes have one key set."""

from __future__ import annotations

import random

from casegraph.operators import analytics as a
from casegraph.operators import risk


def test_classes_brute_force(spark):
    r = random.Random(2)
    sets = {i: {f"k{j}" for j in r.sample(range(8), r.randint(1, 4))} | ({"all"} if i % 3 else set()) for i in range(60)}
    keys = spark.createDataFrame([(i, k) for i, s in sets.items() for k in s for _ in range(1 + i % 2)], "node long, key string")
    score = lambda i, j: round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 4)
    for threshold, only in ((0.2, None), (0.5, range(0, 60, 2)), (1.0, None)):
        nodes = list(sets if only is None else only)
        entities = None if only is None else spark.createDataFrame([(i,) for i in only], "node long")
        pairs = {(i, j): (len(sets[i] & sets[j]), score(i, j)) for i in nodes for j in nodes if i < j and sets[i] & sets[j] and score(i, j) >= threshold}
        rows = a.jaccard(keys, entities, threshold).collect()
        assert {(x.a, x.b): (x.shared, x.score) for x in rows} == pairs and len(rows) == len(pairs)
        for top in (1, 3, 100):
            expected = set()
            for i in nodes:
                others = sorted((-score(i, j), j) for j in nodes if (min(i, j), max(i, j)) in pairs)
                expected |= {(i, j, -s, rank) for rank, (s, j) in enumerate(others[:top], 1)}
            assert {(x.entity, x.similar_id, x.score, x.rank) for x in a.similar_entities(keys, entities, threshold, top).collect()} == expected


def test_many_nodes_of_one_key_set(spark):
    keys = spark.range(10_000).selectExpr("id as node", "'place:x' as key").union(spark.createDataFrame([(10_000, "place:x"), (10_000, "other:y")], "node long, key string"))
    _, classes = a.key_classes(keys)
    assert sorted((x.cls, x.members) for x in classes.collect()) == [(0, 10_000), (10_000, 1)]
    assert [tuple(x) for x in a.similar_classes(classes, 0.2).collect()] == [(0, 10_000, 1, 0.5)]
    found = a.similar_entities(keys, top=3)
    assert found.count() == 3 * 10_001
    assert sorted((x.similar_id, x.rank) for x in found.where("entity = 1").collect()) == [(0, 1), (2, 2), (3, 3)]
    assert sorted((x.similar_id, x.score) for x in found.where("entity = 10000").collect()) == [(0, 0.5), (1, 0.5), (2, 0.5)]
    assert a.similar_entities(keys.limit(0)).count() == 0


def test_mean_score_ties_go_to_the_even_digit(spark):
    scope = [(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (4, 1), (4, 1), (5, 1), (5, 2), (5, 5)]
    scores = spark.createDataFrame([(1, 0.1234), (2, 0.1235), (3, 0.1235), (4, 0.1236)], "node_id long, score double")
    found = {x.investigation_id: (x.entities, x.max_score, x.mean_score) for x in risk.risk_rollup(spark.createDataFrame(scope, "investigation_id long, entity_id long"), scores).collect()}
    assert found == {1: (2, 0.1235, 0.1234), 2: (2, 0.1236, 0.1236), 3: (1, 0.0, 0.0), 4: (1, 0.1234, 0.1234), 5: (3, 0.1235, 0.0823)}


def test_no_pairs_of_a_key_are_shuffled(spark):
    """100 keys that 600 nodes each have used to make 18 million rows of pairs, and each pair's lists twice; blocks of 50 against brute force."""
    from casegraph.operators import similar

    r = random.Random(4)
    sets = {i: frozenset(r.sample(range(60), r.randint(2, 12))) for i in range(300)}
    classes = spark.createDataFrame([(i, [f"k{j}" for j in sorted(s)], 1) for i, s in sets.items()], "cls long, keys array<string>, members long")
    want = {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.2 * len(sets[i] | sets[j])}
    links = similar.class_links(classes, 0.2, block=50)
    assert {(x.a, x.b): x.shared for x in links.collect()} == want and links.count() == len(want)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ids#") > 0 and "array_intersect" not in plan
    score = lambda i, j: round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 4)
    for i, best in ((x.a, x.b) for x in similar.class_links(classes, 0.2, 1, block=50).collect()):
        assert best == min((-score(i, j), j) for j in sets if (min(i, j), max(i, j)) in want)[1]
