"""Findings over relationships (B1-B27), per investigation.

relationships: investigation_id, id, source_entity_id, target_entity_id, relationship_type, confidence, evidence_id. Rows without
an id, an end or a type are left out; confidences are clamped to [0, 1]; a finding's confidence has 3 digits.

A finding: investigation_id, rule, title, severity, confidence, entity_ids, evidence_ids, relationship_ids (sorted arrays).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from . import graph as g
from . import investigations

INV = "investigation_id"
#: Titles by rule.
TITLES = {
    1: "Repeated relationship detected", 2: "High-confidence relationship", 3: "Highly connected entity", 4: "Relationship supported by evidence", 5: "Evidence-supported entity activity",
    6: "Entity activity concentration", 7: "Multiple relationship indicators", 8: "Multiple high-confidence indicators", 9: "Evidence reinforcement detected", 10: "Graph central entity detected",
    11: "Connected intelligence cluster", 12: "Dense relationship network", 13: "Indirect relationship path detected", 14: "Central entity with reinforced indicators", 15: "Compound graph intelligence pattern",
    16: "Hub-and-spoke graph pattern", 17: "Reinforced multi-hop relationship path", 18: "Relationship type convergence", 19: "Centralized intelligence cluster", 20: "Reciprocal relationship pattern",
    21: "Repeated relationship pattern", 22: "Closed triadic graph pattern", 23: "Bridge entity detected", 24: "Typed multi-hop graph pattern", 25: "Independent intelligence signal convergence",
}
NONE = "cast(array() as array<bigint>)"


def valid(relationships: DataFrame) -> DataFrame:
    """Usable rows; confidence clamped, null as 0; r_type in lower case."""
    ok = relationships.where("id is not null and source_entity_id is not null and target_entity_id is not null and trim(relationship_type) <> ''")
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))
    return ok.select(INV, "id", F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t"), F.lower(F.trim("relationship_type")).alias("kind"), clamp.alias("c"), F.col("evidence_id").alias("e"))


def ends(r: DataFrame) -> DataFrame:
    """Both ends of each relationship; a loop counts twice."""
    return r.select("*", F.explode(F.array("s", "t")).alias("x"))


def _ids(c: str) -> Column:
    """Distinct ids, sorted."""
    return F.sort_array(F.collect_set(c))


def _finding(df: DataFrame, rule: int, confidence: Column, high: Column | None, entity: Column | None = None, evidence: Column | None = None, relationship: Column | None = None) -> DataFrame:
    none = F.expr(NONE)
    arrays = [(none if c is None else F.coalesce(c, none)).alias(n) for n, c in (("entity_ids", entity), ("evidence_ids", evidence), ("relationship_ids", relationship))]
    severity = F.lit("medium") if high is None else F.when(high, "high").otherwise("medium")
    return df.select(INV, F.lit(rule).alias("rule"), F.lit(TITLES[rule]).alias("title"), severity.alias("severity"), F.bround(confidence, 3).alias("confidence"), *arrays)


def _up(base: float, step: float, n: str | Column, cap: float) -> Column:
    return F.least(F.lit(cap), base + step * (F.col(n) if isinstance(n, str) else n))


def _one(c: str) -> Column:
    return F.array(F.col(c))


def b1(r: DataFrame) -> DataFrame:
    d = r.repartition(INV, "s", "t", "kind").groupBy(INV, "s", "t", "kind").agg(F.count("*").alias("n"), _ids("e").alias("ev"), _ids("id").alias("rel")).where("n >= 2")
    c = F.least(F.lit(0.95), _up(0.6, 0.08, "n", 0.95) + F.when(F.size("ev") > 0, 0.03).otherwise(0.0))
    return _finding(d, 1, c, F.col("n") >= 5, F.array_sort(F.array_distinct(F.array("s", "t"))), F.col("ev"), F.col("rel"))


def b2(r: DataFrame) -> DataFrame:
    d = r.where("c >= 0.8")
    return _finding(d, 2, F.col("c"), F.col("c") >= 0.9, F.array_sort(F.array_distinct(F.array("s", "t"))), F.filter(_one("e"), lambda x: x.isNotNull()), _one("id"))


def b3(r: DataFrame) -> DataFrame:
    d = ends(r).groupBy(INV, "x").agg(F.count("*").alias("n"), _ids("e").alias("ev"), _ids("id").alias("rel")).where("n >= 3")
    return _finding(d, 3, _up(0.55, 0.05, "n", 0.9), F.col("n") >= 5, _one("x"), F.col("ev"), F.col("rel"))


def b4(r: DataFrame) -> DataFrame:
    d = r.where("e is not null")
    c = F.least(F.lit(0.9), F.greatest(F.lit(0.75), F.col("c")))
    return _finding(d, 4, c, c >= 0.9, F.array_sort(F.array_distinct(F.array("s", "t"))), _one("e"), _one("id"))


def b5(r: DataFrame) -> DataFrame:
    d = ends(r).where("e is not null").groupBy(INV, "x").agg(_ids("e").alias("ev"), _ids("id").alias("rel"))
    c = F.least(F.lit(0.9), 0.68 + 0.05 * F.least(F.size("ev"), F.lit(4)) + 0.03 * F.least(F.size("rel"), F.lit(4)))
    return _finding(d, 5, c, F.bround(c, 3) >= 0.85, _one("x"), F.col("ev"), F.col("rel"))


def b3_b5(r: DataFrame) -> DataFrame:
    """B3 and B5 from one grouping."""
    d = ends(r).select(INV, "x", "id", "e").repartition(INV, "x").groupBy(INV, "x")
    d = d.agg(F.count("*").alias("n"), _ids("e").alias("ev"), _ids("id").alias("rel"), F.sort_array(F.collect_set(F.when(F.col("e").isNotNull(), F.col("id")))).alias("rel_e"))
    c = F.least(F.lit(0.9), 0.68 + 0.05 * F.least(F.size("ev"), F.lit(4)) + 0.03 * F.least(F.size("rel_e"), F.lit(4)))
    rules = [(3, F.col("n") >= 3, _up(0.55, 0.05, "n", 0.9), F.col("n") >= 5, "rel"), (5, F.size("ev") > 0, c, F.bround(c, 3) >= 0.85, "rel_e")]
    both = F.array(*(F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(TITLES[rule]).alias("title"), F.when(high, "high").otherwise("medium").alias("severity"), F.bround(value, 3).alias("confidence"), F.col(rel).alias("relationship_ids"))) for rule, holds, value, high, rel in rules))
    f = d.select(INV, "x", "ev", F.explode(both).alias("f")).where("f is not null")
    return f.select(INV, "f.rule", "f.title", "f.severity", "f.confidence", _one("x").alias("entity_ids"), F.col("ev").alias("evidence_ids"), "f.relationship_ids")


def base_findings(relationships: DataFrame) -> DataFrame:
    """B1-B5. The relationships are written once, as all rules read them."""
    return base_of(g.checkpointed(valid(relationships)))


def base_of(r: DataFrame) -> DataFrame:
    """B1-B5 of valid relationships."""
    return reduce(DataFrame.union, (f(r) for f in (b1, b2, b3_b5, b4)))


def b6(r: DataFrame) -> DataFrame:
    d = ends(r).groupBy(INV, "x").agg(F.count("*").alias("n"), _ids("e").alias("ev"), _ids("id").alias("rel")).where("n >= 2")
    return _finding(d, 6, _up(0.6, 0.05, "n", 0.9), F.col("n") >= 5, _one("x"), F.col("ev"), F.col("rel"))


def _pairs(r: DataFrame) -> DataFrame:
    return r.where("s <> t").select("*", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))


def b7(r: DataFrame) -> DataFrame:
    d = _pairs(r).groupBy(INV, "a", "b").agg(F.count_distinct("kind").alias("k"), _ids("e").alias("ev"), _ids("id").alias("rel")).where("k >= 2")
    return _finding(d, 7, _up(0.65, 0.08, "k", 0.92), F.col("k") >= 3, F.array("a", "b"), F.col("ev"), F.col("rel"))


def high_counts(base: DataFrame) -> DataFrame:
    """(investigation_id, x, h, k, titles, rel, ev): base findings that name an entity, those of confidence >= .80 as h, all as k."""
    named = base.select(INV, "title", "confidence", "relationship_ids", "evidence_ids", F.explode("entity_ids").alias("x"))
    ids = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    high = F.col("confidence") >= 0.8
    return named.groupBy(INV, "x").agg(F.count_if(high).alias("h"), F.count("*").alias("k"), F.count_distinct("title").alias("titles"), ids(F.when(high, F.col("relationship_ids"))).alias("rel"), ids(F.when(high, F.col("evidence_ids"))).alias("ev"))


def high_counts_of(r: DataFrame) -> DataFrame:
    """high_counts(base_of(r)) from one grouping of the relationships' ends. A relationship comes once for each end, however many findings it is in,
    and with its ids only; B3 and B5 follow from what an entity has in all.

    Rows (x, id, e, n, k, h, rules): n ends, k findings, h of them high, and a bit for each rule.
    """
    bit = lambda rule, holds: F.when(holds, F.lit(1 << rule)).otherwise(0)
    none, four = F.lit(0), F.col("e").isNotNull()
    two, first = F.col("c") >= 0.8, F.col("i") == 0
    high_four = four & (F.bround(F.least(F.lit(0.9), F.greatest(F.lit(0.75), F.col("c"))), 3) >= 0.8)
    one = lambda c: c.cast("int")
    # A loop's findings name its entity once; its second end counts for n only.
    own = r.select(INV, "id", "e", "c", F.posexplode(F.array("s", "t")).alias("i", "x"), (F.col("s") == F.col("t")).alias("loop"))
    once = first | ~F.col("loop")
    own = own.select(INV, "x", "id", "e", F.lit(1).alias("n"), F.when(once, one(two) + one(four)).otherwise(none).alias("k"), F.when(once, one(two) + one(high_four)).otherwise(none).alias("h"), (bit(2, two) + bit(4, four)).alias("rules"))
    repeated = b1(r).select(INV, F.explode("entity_ids").alias("x"), "relationship_ids", "evidence_ids", one(F.col("confidence") >= 0.8).alias("high"))
    repeated = repeated.select(INV, "x", "high", F.posexplode(F.concat(F.transform("relationship_ids", lambda v: F.struct(v.alias("id"), F.lit(None).cast("long").alias("e"))), F.transform("evidence_ids", lambda v: F.struct(F.lit(None).cast("long").alias("id"), v.alias("e"))))).alias("i", "v"))
    # All rows of a finding that is high are marked as high; only the first counts.
    repeated = repeated.select(INV, "x", "v.id", "v.e", none.alias("n"), one(first).alias("k"), F.when(first, F.col("high")).otherwise(-F.col("high")).alias("h"), F.lit(2).alias("rules"))
    ids = lambda c, when: F.collect_set(F.when(when, F.col(c)))
    mine, marked = F.col("n") > 0, F.col("h") != 0
    d = own.union(repeated).repartition(INV, "x").groupBy(INV, "x").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.greatest("h", none)).alias("h"), F.bit_or("rules").alias("rules"), ids("id", marked).alias("rel_h"), ids("e", marked).alias("ev_h"),
        ids("id", mine).alias("rel"), ids("e", mine).alias("ev"), ids("id", mine & four).alias("rel_e"),
    )
    c5 = F.bround(F.least(F.lit(0.9), 0.68 + 0.05 * F.least(F.size("ev"), F.lit(4)) + 0.03 * F.least(F.size("rel_e"), F.lit(4))), 3)
    three, five = F.col("n") >= 3, F.size("ev") > 0
    high_three, high_five = three & (F.bround(_up(0.55, 0.05, "n", 0.9), 3) >= 0.8), five & (c5 >= 0.8)
    rules = F.col("rules").bitwiseOR(bit(3, three)).bitwiseOR(bit(5, five))
    rel = F.when(high_three, F.array_union("rel_h", "rel")).when(high_five, F.array_union("rel_h", "rel_e")).otherwise(F.col("rel_h"))
    ev = F.when(high_three | high_five, F.array_union("ev_h", "ev")).otherwise(F.col("ev_h"))
    d = d.select(INV, "x", (F.col("h") + one(high_three) + one(high_five)).alias("h"), (F.col("k") + one(three) + one(five)).alias("k"), F.bit_count(rules).cast("long").alias("titles"), F.sort_array(rel).alias("rel"), F.sort_array(ev).alias("ev"))
    return d.where("k > 0")


def b8(high: DataFrame) -> DataFrame:
    return _finding(high.where("h >= 2"), 8, _up(0.7, 0.05, "h", 0.95), F.col("h") >= 3, _one("x"), F.col("ev"), F.col("rel"))


def b9(base: DataFrame) -> DataFrame:
    # Rows that repeat an entity's ids are dealt by parts of an investigation, so that equal ids lie side by side and compress.
    named = base.select(INV, "entity_ids", "relationship_ids", F.explode("evidence_ids").alias("e")).withColumn("part", F.pmod(F.xxhash64("e"), F.lit(8)).cast("int")).repartition(INV, "part")
    ids = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    d = named.groupBy(INV, "part", "e").agg(F.count("*").alias("n"), ids("entity_ids").alias("ent"), ids("relationship_ids").alias("rel")).where("n >= 2")
    return _finding(d, 9, _up(0.7, 0.06, "n", 0.95), F.col("n") >= 3, F.col("ent"), _one("e"), F.col("rel"))


def central_entities(r: DataFrame) -> DataFrame:
    """(investigation_id, x): G22, in investigations of two nodes at least."""
    n = ends(r).groupBy(INV, "x").agg(F.count("*").alias("n"))
    most = n.groupBy(INV).agg(F.max("n").alias("m"), F.count("*").alias("nodes")).where("nodes >= 2")
    return n.join(most, INV).where("n = m").select(INV, "x")


def _neighbours(r: DataFrame) -> DataFrame:
    """(investigation_id, x, y) distinct, both ways, no loops."""
    p = _pairs(r).select(INV, "a", "b").distinct()
    return p.select(INV, F.col("a").alias("x"), F.col("b").alias("y")).union(p.select(INV, "b", "a"))


def b10(central: DataFrame, high: DataFrame) -> DataFrame:
    d = central.join(high.select(INV, "x", "k"), [INV, "x"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return _finding(d, 10, _up(0.72, 0.04, "k", 0.92), F.col("k") >= 3, _one("x"))


#: Investigations of up to this many pairs of neighbours have their components and blocks found from one row, larger ones by joins.
LINEAR = 20_000


def components(r: DataFrame, local: int | None = None) -> DataFrame:
    """(investigation_id, x, component, size)"""
    pairs = r.where(F.col(INV).isNotNull()).select(INV, F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    small, large = _by_size(pairs := g.checkpointed(pairs), LINEAR if local is None else local)
    found = investigations.components(small)
    return found if large is None else found.unionByName(_components_by_joins(pairs.join(F.broadcast(large), INV, "left_semi")))


def _components_by_joins(pairs: DataFrame) -> DataFrame:
    nodes = pairs.select(INV, F.explode(F.array("a", "b")).alias("node_id")).distinct()
    found = g.components(nodes, pairs, by=[INV], src="a", dst="b").withColumnRenamed("node_id", "x")
    return found.join(found.groupBy(INV, "component").agg(F.count("*").alias("size")), [INV, "component"]).select(INV, "x", "component", "size")


def b11(comp: DataFrame) -> DataFrame:
    d = comp.where("size >= 3").groupBy(INV, "component").agg(_ids("x").alias("ent"), F.first("size").alias("n"))
    return _finding(d, 11, _up(0.65, 0.04, "n", 0.9), F.col("n") >= 5, F.col("ent"))


def density(r: DataFrame) -> DataFrame:
    """(investigation_id, nodes, edges, d): d is the average degree 2E / N; ent are the nodes."""
    nodes = ends(r).groupBy(INV).agg(_ids("x").alias("ent"))
    return nodes.join(r.groupBy(INV).agg(F.count("*").alias("edges")), INV).select(INV, F.size("ent").alias("nodes"), "edges", (2 * F.col("edges") / F.size("ent")).alias("d"), "ent")


def b12(dens: DataFrame) -> DataFrame:
    d = dens.where("nodes >= 3 and edges >= 2 and d >= 1.5")
    return _finding(d, 12, _up(0.68, 0.05, "d", 0.92), F.col("d") >= 3, F.col("ent"))


#: Investigations of up to this many pairs of neighbours have their paths found from one row, larger ones by joins.
LOCAL = 2000


def _by_size(pairs: DataFrame, local: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of the investigations that have up to `local` rows, and the ids of the others, if there are any."""
    large = g.checkpointed(pairs.groupBy(INV).agg(F.count("*").alias("n")).where(F.col("n") > local).select(INV))
    return (pairs, None) if large.isEmpty() else (pairs.join(F.broadcast(large), INV, "left_anti"), large)


def indirect_paths(r: DataFrame, longest: int = 4, local: int = LOCAL) -> DataFrame:
    """(investigation_id, a, b, distance, path): pairs a < b 2 to `longest` edges apart, with the smallest of their shortest paths."""
    pairs = g.checkpointed(_pairs(r).where(F.col(INV).isNotNull()).select(INV, "a", "b").distinct().withColumn("n", F.lit(0).cast("long")))
    small, large = _by_size(pairs, local)
    found = investigations.paths(small, longest).drop("n")
    return found if large is None else found.unionByName(_paths_by_joins(r.join(F.broadcast(large), INV, "left_semi"), longest))


def _paths_by_joins(r: DataFrame, longest: int) -> DataFrame:
    near = _neighbours(r)
    front = near.select(INV, F.col("x").alias("a"), F.col("y").alias("b"), F.array("x", "y").alias("path"))
    reached = front.select(INV, "a", "b").union(near.select(INV, "x", "x").distinct())
    found = None
    for d in range(2, longest + 1):
        step = front.join(near.select(INV, F.col("x").alias("b"), "y"), [INV, "b"]).select(INV, "a", F.col("y").alias("b"), F.concat("path", F.array("y")).alias("path"))
        front = g.checkpointed(step.groupBy(INV, "a", "b").agg(F.min("path").alias("path")).join(reached, [INV, "a", "b"], "left_anti"))
        reached = reached.union(front.select(INV, "a", "b"))
        part = front.where("a < b").withColumn("distance", F.lit(d))
        found = part if found is None else found.union(part)
    return found.select(INV, "a", "b", "distance", "path")


def reinforced_paths(r: DataFrame, base: DataFrame, longest: int = 4, local: int = LOCAL) -> DataFrame:
    """indirect_paths() with h: the findings of base of confidence >= .80 that name a node of the path; paths with any.

    A base finding names one entity or two neighbours. On a shortest path neighbours follow each other, so h is the sum over the path's nodes less
    the findings that name two nodes in a row.
    """
    high = base.where("confidence >= 0.8 and size(entity_ids) > 0").where(F.col(INV).isNotNull()).select(INV, F.xxhash64("title", "entity_ids", "evidence_ids", "relationship_ids").alias("f"), F.col("entity_ids")[0].alias("a"), F.element_at("entity_ids", -1).alias("b")).distinct()
    one = F.lit(1).cast("long")
    named = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b")))
    counts = high.select(INV, F.explode(named).alias("v")).select(INV, "v.a", "v.b", one.alias("n"))
    edges = _pairs(r).where(F.col(INV).isNotNull()).select(INV, "a", "b", F.lit(0).cast("long").alias("n"))
    small, large = _by_size(g.checkpointed(edges.union(counts).groupBy(INV, "a", "b").agg(F.sum("n").alias("n"))), local)
    found = investigations.paths(small, longest).where("n > 0").withColumnRenamed("n", "h")
    return found if large is None else found.unionByName(_reinforced_by_joins(_paths_by_joins(r.join(F.broadcast(large), INV, "left_semi"), longest), base))


def _reinforced_by_joins(paths: DataFrame, base: DataFrame) -> DataFrame:
    high = base.where("confidence >= 0.8").select(INV, F.xxhash64("title", "entity_ids", "evidence_ids", "relationship_ids").alias("f"), F.explode("entity_ids").alias("x"))
    on = paths.select(INV, "a", "b", "distance", "path", F.explode("path").alias("x")).join(high, [INV, "x"])
    return on.groupBy(INV, "a", "b", "distance", "path").agg(F.count_distinct("f").alias("h"))


def b13(paths: DataFrame) -> DataFrame:
    return _finding(paths, 13, _up(0.6, 0.05, F.col("distance") - 1, 0.85), F.col("distance") - 1 >= 3, F.sort_array("path"))


def _central_high(central: DataFrame, high: DataFrame) -> DataFrame:
    return central.join(high, [INV, "x"]).where("h >= 2")


def b14(central: DataFrame, high: DataFrame) -> DataFrame:
    return _finding(_central_high(central, high), 14, _up(0.76, 0.04, "h", 0.94), F.col("h") >= 3, _one("x"), F.col("ev"), F.col("rel"))


def b15(central: DataFrame, high: DataFrame, r: DataFrame, comp: DataFrame) -> DataFrame:
    n = ends(r).groupBy(INV, "x").agg(F.count_distinct("id").alias("r"))
    d = _central_high(central, high).join(n, [INV, "x"]).join(comp.select(INV, "x", "size"), [INV, "x"]).where("r >= 2 and size >= 3")
    c = F.least(F.lit(0.95), 0.76 + 0.03 * F.col("h") + 0.02 * F.col("r") + 0.01 * F.col("size"))
    return _finding(d, 15, c, F.bround(c, 3) >= 0.9, _one("x"), F.col("ev"), F.col("rel"))


def b16(central: DataFrame, r: DataFrame) -> DataFrame:
    d = _neighbours(r).groupBy(INV, "x").agg(F.count("*").alias("d"), _ids("y").alias("spokes")).where("d >= 3").join(central, [INV, "x"])
    return _finding(d, 16, _up(0.72, 0.04, "d", 0.93), F.col("d") >= 5, F.array_sort(F.concat(_one("x"), "spokes")))


def b17(reinforced: DataFrame) -> DataFrame:
    return _finding(reinforced, 17, F.least(F.lit(0.92), 0.68 + 0.04 * F.col("distance") + 0.04 * F.col("h")), F.col("h") >= 2, F.sort_array("path"))


def b18(r: DataFrame) -> DataFrame:
    d = ends(r).groupBy(INV, "x").agg(F.count_distinct("kind").alias("k"), _ids("e").alias("ev"), _ids("id").alias("rel")).where("k >= 2")
    return _finding(d, 18, _up(0.7, 0.05, "k", 0.91), F.col("k") >= 4, _one("x"), F.col("ev"), F.col("rel"))


def b19(comp: DataFrame, central: DataFrame, base: DataFrame) -> DataFrame:
    with_central = comp.where("size >= 3").join(central, [INV, "x"], "left_semi").select(INV, "component").distinct()
    members = comp.join(with_central, [INV, "component"], "left_semi")
    # The entities of a finding are in one component: it is counted at the first of them.
    high = base.where("confidence >= 0.8").select(INV, F.col("entity_ids")[0].alias("x"), F.xxhash64("title", "entity_ids", "evidence_ids", "relationship_ids").alias("f"))
    high = high.distinct().groupBy(INV, "x").agg(F.count("*").alias("h"))
    d = members.join(high, [INV, "x"], "left").groupBy(INV, "component").agg(_ids("x").alias("ent"), F.first("size").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"))
    return _finding(d, 19, F.least(F.lit(0.94), 0.72 + 0.025 * F.col("n") + 0.03 * F.col("h")), F.col("h") >= 3, F.col("ent"))


def b20(r: DataFrame) -> DataFrame:
    d = _pairs(r).groupBy(INV, "a", "b").agg(F.count_distinct("s").alias("ways"), _ids("e").alias("ev"), _ids("id").alias("rel")).where("ways = 2")
    return _finding(d, 20, F.lit(0.82), None, F.array("a", "b"), F.col("ev"), F.col("rel"))


def b21(r: DataFrame) -> DataFrame:
    d = _pairs(r).groupBy(INV, "a", "b", "kind").agg(F.count("*").alias("n"), _ids("e").alias("ev"), _ids("id").alias("rel")).where("n >= 2")
    return _finding(d, 21, _up(0.72, 0.04, "n", 0.92), F.col("n") >= 4, F.array("a", "b"), F.col("ev"), F.col("rel"))


def triangles(r: DataFrame, local: int = LOCAL) -> DataFrame:
    """(investigation_id, p, q, w) with p < q < w."""
    pairs = g.checkpointed(_pairs(r).where(F.col(INV).isNotNull()).select(INV, "a", "b").distinct())
    small, large = _by_size(pairs, local)
    found = investigations.triangles(small)
    return found if large is None else found.unionByName(_triangles_by_joins(pairs.join(F.broadcast(large), INV, "left_semi")))


def _triangles_by_joins(pairs: DataFrame) -> DataFrame:
    """The same of investigations of any size. Edges run from lower to higher degree, so a hub opens few wedges."""
    near = pairs.select(INV, F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(INV, "b", "a"))
    degree = near.groupBy(INV, "x").agg(F.count("*").alias("d"))
    ranked = near.join(degree, [INV, "x"]).join(degree.select(INV, F.col("x").alias("y"), F.col("d").alias("dy")), [INV, "y"])
    up = ranked.where("d < dy or (d = dy and x < y)").select(INV, "x", "y")
    wedge = up.join(up.select(INV, "x", F.col("y").alias("z")), [INV, "x"]).where("y < z")
    closed = wedge.join(near.select(INV, F.col("x").alias("y"), F.col("y").alias("z")), [INV, "y", "z"], "left_semi")
    three = F.array_sort(F.array("x", "y", "z"))
    return closed.select(INV, three.alias("three")).select(INV, F.col("three")[0].alias("p"), F.col("three")[1].alias("q"), F.col("three")[2].alias("w"))


def b22(r: DataFrame) -> DataFrame:
    return _finding(triangles(r), 22, F.lit(0.84), None, F.array("p", "q", "w"))


#: Graphs of up to this many levels have their blocks found from breadth-first ways to the root, deeper ones by doubling.
LEVELS = 30


def articulation_points(r: DataFrame, comp: DataFrame, levels: int = LEVELS, local: int | None = None) -> DataFrame:
    """(investigation_id, x): nodes that lie in more than one block (biconnected component) of their investigation's graph."""
    pairs = g.checkpointed(_pairs(r).where(F.col(INV).isNotNull()).select(INV, "a", "b").distinct())
    small, large = _by_size(pairs, LINEAR if local is None else local)
    found = investigations.articulation_points(small)
    return found if large is None else found.unionByName(_articulation_by_joins(pairs.join(F.broadcast(large), INV, "left_semi"), comp, levels))


def _articulation_by_joins(pairs: DataFrame, comp: DataFrame, levels: int) -> DataFrame:
    """The same of investigations of any size.

    A breadth-first tree from each component's smallest node, a round a level, with every node's way up to the root. Any other
    edge closes a cycle with the two ways up to where they meet, so all tree edges on these are in one block; blocks are the
    components of tree edges that such cycles connect (an edge goes by its lower node). A graph of over `levels` levels goes to blocks.blocks,
    whose rounds are the logarithm of its size, with the same result; ways to the root have at most `levels` nodes.
    """
    near = g.checkpointed(pairs.select(INV, F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(INV, "b", "a")))
    comp = comp.join(pairs.select(INV).distinct(), INV, "left_semi")
    front = g.checkpointed(comp.where("x = component").join(near.select(INV, "x").distinct(), [INV, "x"], "left_semi").select(INV, "x", F.array("x").alias("up")))
    tree, deep = front, True
    for _ in range(levels):
        step = front.join(near, [INV, "x"]).select(INV, F.col("y").alias("x"), F.concat(F.array("y"), "up").alias("up")).groupBy(INV, "x").agg(F.min("up").alias("up"))
        front = g.checkpointed(step.join(tree.select(INV, "x"), [INV, "x"], "left_anti"))
        if front.isEmpty():
            deep = False
            break
        tree = tree.unionByName(front)
    block = blocks.blocks(near, comp, [INV]) if deep else _shallow_blocks(near, tree)
    of = block.select(INV, F.explode(F.array("node", "parent")).alias("x"), "block").distinct()
    return of.groupBy(INV, "x").agg(F.count("*").alias("blocks")).where("blocks > 1").select(INV, "x")


def _shallow_blocks(near: DataFrame, tree: DataFrame) -> DataFrame:
    """(investigation_id, node, parent, block) from each node's way up."""
    edges = near.where("x < y").join(tree.select(INV, "x", F.col("up").alias("a")), [INV, "x"]).join(tree.select(INV, F.col("x").alias("y"), F.col("up").alias("b")), [INV, "y"])
    others = edges.where("not (get(a, 1) <=> y) and not (get(b, 1) <=> x)")
    cycle = others.select(INV, F.concat(F.array_except("a", "b"), F.array_except("b", "a")).alias("c"))
    links = cycle.select(INV, F.col("c")[0].alias("s"), F.explode(F.slice("c", F.lit(2), F.size("c"))).alias("t")).distinct()
    child = g.checkpointed(tree.where("size(up) > 1").select(INV, F.col("x").alias("node_id"), F.col("up")[1].alias("parent")))
    found = g.components(child.select(INV, "node_id"), links, by=[INV], src="s", dst="t").join(child, [INV, "node_id"])
    return found.select(INV, F.col("node_id").alias("node"), "parent", F.col("component").alias("block"))


def b23(r: DataFrame, comp: DataFrame) -> DataFrame:
    n = _neighbours(r).groupBy(INV, "x").agg(F.count("*").alias("n")).where("n >= 2")
    return _finding(articulation_points(r, comp).join(n, [INV, "x"]), 23, _up(0.78, 0.03, "n", 0.93), F.col("n") >= 4, _one("x"))


def typed_legs(r: DataFrame) -> DataFrame:
    """(investigation_id, m, o, kinds): the neighbours o of each m, with the sorted types of their relationships. A row for each end of a pair: what
    typed_wedges stands for, in a form that grows with the edges."""
    legs = _pairs(r).groupBy(INV, "a", "b").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return legs.select(INV, F.col("a").alias("m"), F.col("b").alias("o"), "kinds").union(legs.select(INV, "b", "a", "kinds"))


def typed_middles(legs: DataFrame) -> DataFrame:
    """(investigation_id, m, legs, kind_sets, wedges): how many typed wedges each middle has, without forming one: all pairs of its legs but
    those that have the same single type."""
    sets = legs.groupBy(INV, "m", "kinds").agg(F.count("*").alias("n"))
    alike = F.when(F.size("kinds") == 1, F.col("n") * (F.col("n") - 1)).otherwise(0)
    sums = sets.groupBy(INV, "m").agg(F.sum("n").alias("legs"), F.count("*").alias("kind_sets"), F.sum(alike).alias("alike"))
    return sums.select(INV, "m", "legs", "kind_sets", F.expr("(legs * (legs - 1) - alike) div 2").alias("wedges")).where("wedges > 0")


def typed_wedges(r: DataFrame, middles: DataFrame | None = None) -> DataFrame:
    """(investigation_id, a, m, b, combos): a - m - b with a < b whose legs have different types; the type pairs as sorted texts. `middles`
    (investigation_id, m) limits which ones are written out.

    Types are gathered per pair before the self-join on the middle.
    """
    both = typed_legs(r) if middles is None else typed_legs(r).join(middles.select(INV, "m").distinct(), [INV, "m"], "left_semi")
    other = both.select(INV, "m", F.col("o").alias("b"), F.col("kinds").alias("right"))
    combos = F.flatten(F.transform("kinds", lambda k: F.transform(F.filter("right", lambda q: q != k), lambda q: F.concat_ws("→", F.least(k, q), F.greatest(k, q)))))
    found = both.withColumnRenamed("o", "a").join(other, [INV, "m"]).where("a < b").select(INV, "a", "m", "b", F.array_sort(F.array_distinct(combos)).alias("combos"))
    return found.where("size(combos) > 0")


def b24(r: DataFrame) -> DataFrame:
    """One row for each typed wedge (typed_wedges), without the texts of its type pairs: the legs differ unless both have the same single type."""
    legs = typed_legs(r).select(INV, "m", "o", F.when(F.size("kinds") == 1, F.col("kinds")[0]).alias("kind"))
    other = legs.select(INV, "m", F.col("o").alias("b"), F.col("kind").alias("right"))
    found = legs.withColumnRenamed("o", "a").join(other, [INV, "m"]).where("a < b and (kind is null or right is null or kind <> right)")
    three = F.array(F.least("a", "m"), F.least(F.greatest("a", "m"), "b"), F.greatest("m", "b"))
    return _finding(found, 24, F.lit(0.83), None, three)


def b25(central: DataFrame, high: DataFrame, r: DataFrame) -> DataFrame:
    kinds = ends(r).groupBy(INV, "x").agg(F.count_distinct("kind").alias("types"))
    degree = _neighbours(r).groupBy(INV, "x").agg(F.count("*").alias("d"))
    d = central.join(degree, [INV, "x"], "left").join(kinds, [INV, "x"], "left").join(high, [INV, "x"], "left")
    signals = sum((F.coalesce((F.col(c) >= 2).cast("int"), F.lit(0)) for c in ("d", "h", "types", "titles")), F.lit(0))
    d = d.withColumn("signals", signals).where("signals >= 3")
    return _finding(d, 25, F.least(F.lit(0.96), 0.8 + 0.025 * F.col("signals") + 0.01 * F.coalesce("k", F.lit(0))), F.col("signals") >= 4, _one("x"), F.col("ev"), F.col("rel"))


def typed_triples(r: DataFrame, local: int = LOCAL) -> DataFrame:
    """B24's findings, each once."""
    kind = F.when(F.min("kind") == F.max("kind"), F.min("kind")).alias("kind")
    pairs = g.checkpointed(_pairs(r).where(F.col(INV).isNotNull()).groupBy(INV, "a", "b").agg(kind))
    small, large = _by_size(pairs, local)
    found = _finding(investigations.wedges(small), 24, F.lit(0.83), None, F.array("p", "q", "w"))
    return found if large is None else found.unionByName(deduplicated(b24(r.join(F.broadcast(large), INV, "left_semi"))))


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding for each title and id sets, that of the lowest rule and highest confidence."""
    keys = [INV, "title", "entity_ids", "evidence_ids", "relationship_ids"]
    first = F.min_by(F.struct("rule", "severity", "confidence"), F.struct("rule", -F.col("confidence"))).alias("v")
    return findings.groupBy(*keys).agg(first).select(INV, "v.rule", "title", "v.severity", "v.confidence", "entity_ids", "evidence_ids", "relationship_ids")


#: Rules that may give a finding twice: those on single relationships, and on pairs of which other types, or the other direction, may have the same ids. The others give one for each entity,
#: pair, evidence, component, investigation, triangle or path.
REPEATING = (1, 2, 4, 21)


def all_findings(relationships: DataFrame, local: int = LOCAL) -> DataFrame:
    """B1-B26. Derived rules read base findings only; an investigation without one has none.

    Each rule has a title of its own, so that equal findings are of one rule, and only those of REPEATING rules are compared; B24's are made once each. The nodes of a shortest
    path are the path's alone (they have no other edges among them), so that B13 and B17 have no equal findings.
    """
    r = g.checkpointed(valid(relationships))
    base = g.checkpointed(base_of(r))
    r = g.checkpointed(r.join(base.select(INV).distinct(), r[INV].eqNullSafe(base[INV]), "left_semi"))
    high, central, comp = g.checkpointed(high_counts_of(r)), g.checkpointed(central_entities(r)), g.checkpointed(components(r))
    repeating = base.where(F.col("rule").isin(*REPEATING)).unionByName(b21(r))
    once = [
        base.where(~F.col("rule").isin(*REPEATING)), b6(r), b7(r), b8(high), b9(base), b10(central, high), b11(comp), b12(density(r)), b14(central, high), b15(central, high, r, comp), b16(central, r), b18(r),
        b19(comp, central, base), b20(r), b22(r), b23(r, comp), typed_triples(r, local), b25(central, high, r), b13(indirect_paths(r, local=local)), b17(reinforced_paths(r, base, local=local)),
    ]
    return reduce(DataFrame.unionByName, once, deduplicated(repeating))


def investigation_results(relationships: DataFrame, findings: DataFrame) -> DataFrame:
    """Per investigation: findings, high findings, nodes, edges, average degree, type counts, central ids, components, summary."""
    r = valid(relationships)
    kinds = r.groupBy(INV, "kind").agg(F.count("*").alias("n")).groupBy(INV).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("type_counts"))
    comps = components(r).groupBy(INV).agg(F.count_distinct("component").alias("components"))
    counts = findings.groupBy(INV).agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "high").alias("high"))
    central = central_entities(r).groupBy(INV).agg(_ids("x").alias("central_ids"))
    d = density(r).join(kinds, INV).join(comps, INV).join(counts, INV, "left").join(central, INV, "left")
    n = F.coalesce("findings", F.lit(0))
    text = F.concat(n.cast("string"), F.lit(" findings over "), F.col("nodes").cast("string"), F.lit(" entities and "), F.col("edges").cast("string"), F.lit(" relationships."))
    return d.select(INV, n.alias("findings"), F.coalesce("high", F.lit(0)).alias("high"), F.col("nodes").cast("long").alias("nodes"), "edges", F.bround("d", 3).alias("average_degree"), "type_counts", F.coalesce("central_ids", F.expr(NONE)).alias("central_ids"), "components", text.alias("summary"))
