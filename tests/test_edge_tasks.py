"""Edges are grouped in tasks that follow the number of order lines."""

from casegraph.operators import graph as g
from casegraph.plans import adapters as m

SF = "/root/testdata/sf0.001"


def test_tasks_follow_the_lines(spark, monkeypatch):
    query = lambda: g.undirected_edges(m.edges(spark, SF), m.tasks(spark, SF))
    assert m.tasks(spark, SF) is None
    few = sorted(map(tuple, query().collect()))
    n = m.read(spark, SF, "lineitem").count()
    for lines in (600, 300):  # half the lines a task, twice the tasks
        monkeypatch.setattr(m, "LINES", lines)
        many = query()
        assert m.tasks(spark, SF) == n // lines + 1 == many.rdd.getNumPartitions()
        assert sorted(map(tuple, many.collect())) == few
