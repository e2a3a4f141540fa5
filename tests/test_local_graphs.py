"""Components, articulation points and typed wedges of an investigation from one row, and by joins, against plain Python."""

import random
from itertools import combinations

import pytest

from casegraph.operators import findings as b
from casegraph.operators import graph as g
from casegraph.operators import investigations

REL = "investigation_id long, id long, s long, t long, kind string, c double, e long"


def components(nodes, edges):
    label = {x: x for x in nodes}
    for _ in nodes:
        for s, t in edges:
            if s in label and t in label:
                label[s] = label[t] = min(label[s], label[t])
    return label


@pytest.fixture(scope="module")
def rows():
    rand = random.Random(5)
    out = [(rand.choice([None, 7, 8, 9, 10]), i, rand.randrange(16) * 10**9, rand.randrange(16) * 10**9, rand.choice("abc"), rand.random(), rand.choice([None, i])) for i in range(110)]
    return out + [(5, 1000 + i, i, i + 1, "ab"[i % 2], 0.5, None) for i in range(50)] + [(6, 2000, 1, 1, "a", 0.5, None)]


def edges_of(rows, inv):
    return {tuple(sorted(x[2:4])) for x in rows if x[0] == inv}


INVS = (5, 6, 7, 8, 9, 10)


def test_components(spark, rows):
    expected = set()
    for inv in INVS:
        label = components({x for e in edges_of(rows, inv) for x in e}, edges_of(rows, inv))
        expected |= {(inv, x, c, list(label.values()).count(c)) for x, c in label.items()}
    r = spark.createDataFrame(rows, REL)
    for local in (None, 0, 30):
        assert {tuple(x) for x in b.components(r, local).collect()} == expected


def test_articulation_points(spark, rows, monkeypatch):
    expected = set()
    for inv in INVS:
        edges = edges_of(rows, inv)
        nodes = {x for e in edges for x in e}
        n = len(set(components(nodes, edges).values()))
        expected |= {(inv, x) for x in nodes if len(set(components(nodes - {x}, edges).values())) > n}
    r = spark.createDataFrame(rows, REL)
    comp = g.checkpointed(b.components(r))
    for local, levels in ((None, 30), (0, 30), (0, 2), (30, 30)):
        assert {tuple(x) for x in b.articulation_points(r, comp, levels, local).collect()} == expected
    monkeypatch.setattr(investigations, "PAIRS", 7)
    assert {tuple(x) for x in b.articulation_points(r, comp).collect()} == expected


def test_components_and_blocks_take_no_rounds(spark, monkeypatch):
    """They used to be written once a round, for all investigations."""
    written, write = [], g.checkpointed
    monkeypatch.setattr(g, "checkpointed", lambda df: written.append(1) or write(df))
    r = spark.createDataFrame([(i % 5, i, j, j + 1, "a", 0.5, None) for i in range(10) for j in range(20)], REL)
    assert b.b23(r, b.components(r)).count() == 5 * 19
    assert len(written) <= 4


def test_typed_wedges(spark, rows):
    kinds, expected = {}, set()
    for inv, _, s, t, kind, *_ in rows:
        if inv is not None and s != t:
            kinds.setdefault((inv, *sorted((s, t))), set()).add(kind)
    for inv in INVS:
        own = {k[1:]: v for k, v in kinds.items() if k[0] == inv}
        for x, y in combinations(own, 2):
            if len({*x, *y}) == 3 and len(own[x] | own[y]) > 1:
                expected.add((inv, *sorted({*x, *y})))
    r = spark.createDataFrame(rows, REL)
    for local in (b.LOCAL, 0, 30):
        got = [(x.investigation_id, *x.entity_ids) for x in b.typed_triples(r, local).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    pairs = spark.createDataFrame([(*k, min(v) if len(v) == 1 else None) for k, v in kinds.items()], "investigation_id long, a long, b long, kind string")
    for most in (1, 9):
        assert sorted(tuple(x) for x in investigations.wedges(pairs, most).collect()) == sorted(expected)


def test_all_findings_are_those_of_their_rules_once(spark, rows):
    relationships = spark.createDataFrame([(i, k, s, t, kind, c, e) for i, k, s, t, kind, c, e in rows + rows[:20]], "investigation_id long, id long, source_entity_id long, target_entity_id long, relationship_type string, confidence double, evidence_id long")
    r = g.checkpointed(b.valid(relationships))
    base, comp, central, high = g.checkpointed(b.base_of(r)), g.checkpointed(b.components(r)), g.checkpointed(b.central_entities(r)), g.checkpointed(b.high_counts_of(r))
    rules = [base, b.b6(r), b.b7(r), b.b8(high), b.b9(base), b.b10(central, high), b.b11(comp), b.b12(b.density(r)), b.b13(b.indirect_paths(r)), b.b14(central, high), b.b15(central, high, r, comp), b.b16(central, r),
             b.b17(b.reinforced_paths(r, base)), b.b18(r), b.b19(comp, central, base), b.b20(r), b.b21(r), b.b22(r), b.b23(r, comp), b.b24(r), b.b25(central, high, r)]
    row = lambda x: (x.investigation_id, x.rule, x.title, x.severity, x.confidence, tuple(x.entity_ids), tuple(x.evidence_ids), tuple(x.relationship_ids))
    able, best = {x[0] for x in base.select("investigation_id").distinct().collect()}, {}
    for f in rules:
        for x in filter(lambda x: x[0] in able, map(row, f.collect())):
            key = (x[0], x[2], *x[5:])
            if key not in best or x[4] > best[key][4]:
                best[key] = x
    got = [row(x) for x in b.all_findings(relationships).collect()]
    assert len(got) == len(set(got))
    assert set(got) ^ set(best.values()) == set()
