"""The degree ranking of a text-mined network, against plain Python."""

import random

from casegraph.operators import reports


def test_nodes_are_ranked_by_degree(spark):
    rng = random.Random(4)
    values = [f"v{i:03}" for i in range(300)]
    rel = [(f"{i}", "KNOWS", rng.choice(values[:250]), values[min(int(rng.expovariate(0.05)), 249)], 0.5) for i in range(600)]
    found = [(i, rng.choice(["PERSON", "CASE"]), v) for i, v in enumerate(values * 2)]
    near = {}
    for _, _, a, b, _ in rel:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    order = sorted(near, key=lambda v: (-len(near[v]), v))
    expected = {(t, v): (sum(x[1:] == (t, v) for x in found), len(near.get(v, ())), order.index(v) + 1 if v in near else None, "HIGH-DEGREE" if len(near.get(v, ())) >= 2 else None) for _, t, v in found}
    relations = spark.createDataFrame(rel, "doc_id string, relation_type string, source_normalized string, target_normalized string, confidence double").repartition(7)
    out = reports.mined_network(spark.createDataFrame(found, "doc_id long, entity_type string, normalized_value string"), relations)
    assert out.columns == ["entity_type", "normalized_value", "mentions", "degree", "rank", "flag"]
    assert {(r["entity_type"], r["normalized_value"]): (r["mentions"], r["degree"], r["rank"], r["flag"]) for r in out.collect()} == expected
