"""Fuzzy names: every match of a brute force, whatever the blocks; new names merged by components."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from casegraph.functions import normalize as n
from casegraph.operators import resolve as r
from casegraph.plans import QUERIES

DIR = "/root/testdata/sf0.001"
LETTERS = "abcdeiorst"


def changed(rand, token):
    letters = list(token)
    for _ in range(rand.choice([0, 1, 1, 2])):
        i, kind = rand.randrange(len(letters) + 1), rand.random()
        if kind < 0.7 and i < len(letters):
            letters[i : i + 1] = [rand.choice(LETTERS)] if kind < 0.4 or len(letters) == 1 else []
        else:
            letters.insert(i, rand.choice(LETTERS))
    return "".join(letters)


def similarity(x, y):
    """The rule as it is stated, of two normalised names."""
    if x == y:
        return 1.0
    a, b = x.split(), y.split()
    if len(a) != len(b) or not set(a) & set(b):
        return 0.0
    best = [max(SequenceMatcher(None, s, t).ratio() for t in b) for s in a]
    score = 0.6 * SequenceMatcher(None, x, y).ratio() + 0.4 * sum(best) / len(best)
    return score if min(best) >= 0.65 and sum(best) / len(best) >= 0.8 and score >= 0.84 else 0.0


def normal(spark, names):
    df = spark.createDataFrame([(x,) for x in set(names)], "name string")
    return {row.name: row.n for row in df.select("name", n.normalize_company_tokens(F.col("name")).alias("n")).collect()}


def matches(spark, new, existing):
    text, found = normal(spark, [x[2] for x in new + existing]), {}
    for i, kind, x in new:
        scores = [(similarity(text[x], text[y]), -j) for j, other, y in existing if kind == other and text[x] and text[y]]
        score, j = max(scores, default=(0.0, 0))
        if score:
            found[i] = (-j, score)
    return found


def merged(spark, new):
    text = normal(spark, [x[2] for x in new])
    first, of = {}, {}
    for i, kind, x in sorted(new, key=lambda y: y[0]):
        if text[x]:
            first.setdefault((kind, text[x]), i)
    names = sorted((i, k, x) for (k, x), i in first.items())
    of = {i: i for i, _, _ in names}
    for i, kind, x in names:
        for j, other, y in names:
            if j < i and kind == other and similarity(x, y):
                low, high = sorted((of[i], of[j]))
                of = {k: low if v == high else v for k, v in of.items()}
    sizes = {e: list(of.values()).count(e) for e in set(of.values())}
    return {i: (of[first[kind, text[x]]], sizes[of[first[kind, text[x]]]]) for i, kind, x in new if text[x]}


def test_similar_tokens(spark):
    rand = random.Random(5)
    tokens = ["".join(rand.choice(LETTERS) for _ in range(rand.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 30]))) for _ in range(150)]
    tokens = sorted({t for x in tokens for t in (x, changed(rand, x), changed(rand, x))} | {"a" * 40, "ab" * 20})
    df = spark.createDataFrame([(t,) for t in tokens], "s string")
    found = {(x.s, x.t) for x in r.similar_tokens(df, df.withColumnRenamed("s", "t")).collect()}
    assert found == {(s, t) for s in tokens for t in tokens if SequenceMatcher(None, s, t).ratio() >= 0.65}


def some_names(rand):
    tokens = ["".join(rand.choice(LETTERS) for _ in range(rand.choice([1, 2, 3, 5, 7, 9]))) for _ in range(40)]
    names = [" ".join([*(rand.choice(tokens) for _ in range(rand.choice([0, 1, 1, 2, 3]))), "Ltd." if rand.random() < 0.8 else rand.choice(tokens)]) for _ in range(150)]
    return names + [" ".join(t if t == "Ltd." and rand.random() < 0.9 else changed(rand, t) for t in x.split()) for x in names] + ["", " - ", "ltd ltd", "ltd limitd", "limited limited"]


def test_fuzzy_matches_brute_force(spark):
    rand = random.Random(6)
    names = some_names(rand)
    existing = [(i, rand.choice(["organization", "person"]), x) for i, x in enumerate(names)] + [(900, "organization", names[0])]
    new = [(i, "organization", x) for i, x in enumerate(rand.sample(names, 150) + names[-5:])] + [(800, "organization", names[1])]
    schema = "{}_id long, entity_type string, name string, words int, tokens int, x string, y string, kind string"
    frame = lambda rows, kind: spark.createDataFrame([(*x, 1, 2, "x", "y", "k") for x in [*rows, (990, "organization", None), (991, None, "ltd")]], schema.format(kind))
    expected = matches(spark, new, existing)
    for block in (0, 40, 10_000):  # common tokens: all, some, none
        found = {x.new_id: (x.existing_id, x.score) for x in r.fuzzy_matches(frame(new, "new"), frame(existing, "existing"), block_pairs=block).collect()}
        assert {i: x[0] for i, x in found.items()} == {i: x[0] for i, x in expected.items()}
        assert all(abs(found[i][1] - x[1]) < 1e-6 for i, x in expected.items())
    none = frame(new, "new").limit(0)
    assert r.fuzzy_matches(none, frame(existing, "existing")).count() == r.merged_names(none).count() == 0
    got = {x.new_id: (x.entity_id, x.names) for x in r.merged_names(frame(new, "new"), block_pairs=40).collect()}
    assert got == merged(spark, new)


@pytest.mark.parametrize("name", ["r02_fuzzy_matches", "r02_merged_names"])
def test_registered_names_brute_force(spark, name):
    part = spark.read.parquet(f"{DIR}/part.parquet").collect()
    if name == "r02_fuzzy_matches":
        new = [(x.p_partkey, "device", x.p_name.replace("e", "3") + " ltd") for x in part]
        found = {x.new_id: x.existing_id for x in QUERIES[name](spark, DIR).collect()}
        assert found == {i: x[0] for i, x in matches(spark, new, [(x.p_partkey, "device", x.p_name + " limited") for x in part]).items()}
    else:
        spelled = lambda x: (x.p_name, x.p_name.replace("e", "3"), x.p_name.replace("l", ""))[x.p_partkey % 3]
        new = [(x.p_partkey, "device", f"{spelled(x)} {x.p_brand} ltd") for x in part]
        found = {x.new_id: (x.entity_id, x.names) for x in QUERIES[name](spark, DIR).collect()}
        assert found == merged(spark, new) and len({e for e, _ in found.values()}) > 1
