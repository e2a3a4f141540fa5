"""B22's triangles: from one row of an investigation, in parts of its wedges, and by joins, all as plain Python finds them."""

import random
from itertools import combinations

import pytest

from casegraph.operators import findings as b
from casegraph.operators import investigations

REL = "investigation_id long, id long, s long, t long, kind string, c double, e long"


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles_are_those_of_brute_force(spark, seed):
    rand = random.Random(seed)
    rows = [(rand.choice([None, 7, 8, 9]), i, rand.randrange(14) * 10**9, rand.randrange(14) * 10**9, "a", 0.5, None) for i in range(160)]
    rows += [(5, 1000 + i, 0, i, "a", 0.5, None) for i in range(1, 40)] + [(5, 2000, 3, 4, "a", 0.5, None), (6, 2001, 1, 1, "a", 0.5, None)]
    r = spark.createDataFrame(rows, REL)
    near = {(inv, *sorted((s, t))) for inv, _, s, t, *_ in rows if inv is not None and s != t}
    expected = sorted((inv, *t) for inv in (5, 6, 7, 8, 9) for t in combinations(sorted({x for i, *p in near if i == inv for x in p}), 3) if all((inv, *e) in near for e in combinations(t, 2)))
    assert expected
    for local in (b.LOCAL, 0, 41):
        assert sorted(map(tuple, b.triangles(r, local).collect())) == expected
    pairs = spark.createDataFrame(list(near), "investigation_id long, a long, b long")
    for wedges in (1, 7):
        assert sorted(map(tuple, investigations.triangles(pairs, wedges).collect())) == expected


def test_lines_are_shuffled_once_for_triangles(spark):
    """Degrees, wedges and closing edges used to read the relationships anew."""
    r = spark.createDataFrame([(1, 1, 1, 2, "a", 0.5, None), (1, 2, 2, 3, "a", 0.5, None), (1, 3, 1, 3, "a", 0.5, None)], REL)
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    assert [tuple(x) for x in b.triangles(r.mapInArrow(passed, r.schema)).collect()] == [(1, 1, 2, 3)]
    assert seen.value == 3
