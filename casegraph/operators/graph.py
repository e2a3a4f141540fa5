"""Graph queries (G1-G23) over nodes (node_id, entity_type, value, ...) and directed edges (src, dst, rel_type, confidence).

All nodes, or a whole table of seeds, at once. Loops are bounded by a depth, or end when a round changes nothing;
only a count a round reaches the driver.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Spark's setting by which the shuffle files of a query are removed as it ends, rather than when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside is read from its table only, so its shuffle files go at once; searches of many rounds would else keep those of all rounds."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a compressed Parquet table in the folder that the cluster shares, read again; spark.checkpoint.dir names it. Only a local master
    may do without."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(shared or os.path.join(tempfile.gettempdir(), 'checkpoints')).rstrip('/')}/written-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by these columns over all cores, and over more tasks the larger it is. Small tables whose rows cost much would otherwise be gathered in one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions()), *by)


#: A key is hot if it has more than one in HOT of all rows; there are HOT such keys at most.
HOT = 2000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with keyed, whose keys are unique and whose `count` is their number of rows, of `total` in all.

    The few hot keys are broadcast, so that no task gets all rows of one; the others meet in a shuffle, or as Spark chooses.
    """
    hot = keyed.where(F.col(count) * HOT > total)
    met = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(count) * HOT <= total), on)
    return met.unionByName(rest)


def symmetric(edges: DataFrame) -> DataFrame:
    """(node, other, rel_type, confidence): every edge from both ends."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel_type", "confidence").union(edges.select("dst", "src", "rel_type", "confidence"))


def typed_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """symmetric() with the neighbour's entity_type and value."""
    other = nodes.select(F.col("node_id").alias("other"), F.col("entity_type").alias("other_type"), F.col("value").alias("other_value"))
    return symmetric(edges).join(other, "other")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: node_id, out_degree, in_degree, total_degree of every node. One grouping: each edge end is summed before the shuffle."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    both = nodes.select("node_id", F.lit(0).alias("o"), F.lit(0).alias("i")).union(ends)
    return both.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), (F.sum("o") + F.sum("i")).alias("total_degree"))


def neighbour_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, entity_type, value, degree (distinct neighbours) of nodes with any."""
    counted = symmetric(edges).select("node", "other").distinct().groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(counted, nodes["node_id"] == counted["node"]).select("node_id", "entity_type", "value", "degree")


def most_connected(nodes: DataFrame, edges: DataFrame, limit: int, entity_type: str | None = None) -> DataFrame:
    """The top by degree, then value and id."""
    found = neighbour_degrees(nodes, edges)
    if entity_type:
        found = found.where(F.lower("entity_type") == entity_type.lower())
    return found.orderBy(F.desc("degree"), "value", "node_id").limit(limit)


def incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, rel_type, confidence, and the other end's id, type and value."""
    return typed_neighbours(nodes, edges).select(F.col("node").alias("node_id"), "rel_type", "confidence", F.col("other").alias("other_id"), "other_type", "other_value")


def numbered(df: DataFrame, *by: str | Column) -> DataFrame:
    """df with n, from 0 in the order of `by`, written. Rows are placed in range partitions, whose sizes alone are added up in one place."""
    placed = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    shifts = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size") - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(shifts), "part").withColumn("n", F.col("at") + F.col("shift")).drop("at", "part", "shift")


#: Where searches meet, a row holds a node and the seeds of one block that reach it, as bits of WORDS whole numbers. A search goes on so once its next step by pairs of
#: seed and node has over DENSE times as many rows.
WORDS, DENSE = 16, 4
_BITS = [f"w{i}" for i in range(WORDS)]


def _as_bits(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, block, the words) of the pairs (seed, node)."""
    own = pairs.join(F.broadcast(places), "seed")
    return own.groupBy("node", "block").agg(*(F.bit_or(F.when(F.col("word") == i, F.col("mask")).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(_BITS)))


def _next_bits(front: DataFrame, before: DataFrame, adjacent: DataFrame) -> DataFrame:
    """The front one edge on: what is next to it, less itself and the one before (a node next to the front is no nearer, as edges go both ways)."""
    step = front.join(adjacent, "node").drop("node").withColumnRenamed("other", "node").groupBy("node", "block").agg(*(F.bit_or(w).alias(w) for w in _BITS))
    for known in (front, before):
        step = step.join(known.select("node", "block", *(F.col(w).alias(f"k{w}") for w in _BITS)), ["node", "block"], "left")
        step = step.select("node", "block", *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"k{w}", F.lit(0).cast("long")))).alias(w) for w in _BITS))
    return step.where(reduce(Column.bitwiseOR, map(F.col, _BITS)) != 0)


def _of_bits(front: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs (seed, node) that the bits stand for."""
    words = front.select("node", "block", F.posexplode(F.array(*_BITS)).alias("word", "bits")).where("bits <> 0")
    return words.join(F.broadcast(places), ["block", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0).select("seed", "node")


def k_hop(seeds: DataFrame, edges: DataFrame, depth: int, include_seed: bool = False, dense: float = DENSE) -> DataFrame:
    """(seed, node, distance) of all nodes within depth of each seed_id, at their least distance.

    Pairs of seed and node are joined with the edges, until so many seeds have reached the same nodes that edges would be met over and over: from then
    on each edge is met once for a block of seeds, whose bits are put together. Pairs are written out from the bits at the end, without a shuffle.
    """
    if not 1 <= depth <= 10:
        raise ValueError("depth goes from 1 to 10")
    adjacent = symmetric(edges).select("node", "other").where("node <> other").distinct()
    adjacent = checkpointed(adjacent) if depth > 1 else adjacent  # every round reads it
    front = seeds.select(F.col("seed_id").alias("seed"), F.col("seed_id").alias("node")).distinct().withColumn("distance", F.lit(0))
    reached, before, places, bits = front, front.limit(0), None, None
    for d in range(1, depth + 1):
        if d > 1 and depth > 2 and bits is None:
            if places is None:
                n, degree = F.col("n"), checkpointed(adjacent.groupBy("node").agg(F.count("*").alias("degree")))
                place = numbered(seeds.select(F.col("seed_id").alias("seed")).distinct(), "seed")
                places = checkpointed(place.select("seed", F.expr(f"n div {64 * WORDS}").alias("block"), F.expr(f"cast(n div 64 % {WORDS} as int)").alias("word"), F.expr("shiftleft(1L, cast(n % 64 as int))").alias("mask")))
            rows = front.join(F.broadcast(places), "seed").groupBy("node", "block").agg(F.count("*").alias("n")).join(degree, "node")
            by_pairs, by_bits = rows.agg(F.sum(n * F.col("degree")), F.sum("degree")).first()
            if by_pairs and by_pairs > dense * by_bits:
                bits, last = checkpointed(_as_bits(front.select("seed", "node"), places)), checkpointed(_as_bits(before.select("seed", "node"), places))
        if bits is not None:
            bits, last = checkpointed(_next_bits(bits, last, adjacent)), bits
            reached = reached.union(_of_bits(bits, places).withColumn("distance", F.lit(d)))
            continue
        step = front.join(adjacent, "node").select("seed", F.col("other").alias("node")).distinct()
        before, front = front, step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(d))
        if d < depth:
            front = checkpointed(front)
        reached = reached.union(front)
    return reached if include_seed else reached.where("distance > 0")


def component_of_seeds(seeds: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """With the seed itself at distance 0."""
    return k_hop(seeds, edges, depth, include_seed=True)


def paths(seeds: DataFrame, edges: DataFrame, depth: int, per_seed: int | None = None) -> DataFrame:
    """(seed, node, path, types): one row per simple path of up to depth edges; per_seed keeps the first in path order."""
    if not 1 <= depth <= 5:
        raise ValueError("depth goes from 1 to 5")
    step = symmetric(edges).select("node", "other", "rel_type").distinct()
    seed = F.col("seed_id")
    front = seeds.select(seed.alias("seed"), seed.alias("node"), F.array(seed).alias("path"), F.array().cast("array<string>").alias("types"))
    found = None
    for _ in range(depth):
        front = front.join(step, "node").where(~F.array_contains("path", F.col("other"))).select("seed", F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"), F.concat("types", F.array("rel_type")).alias("types"))
        found = front if found is None else found.union(front)
    if per_seed is not None:
        order = Window.partitionBy("seed").orderBy(F.size("path"), "path", "types")
        found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_seed).drop("n")
    return found


def shortest_paths(pairs: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(source, target, distance, path) of each pair that a path of at most depth edges joins; of several shortest ones the
    smallest. A pair of one node has distance 0.

    No set of nodes two steps away is formed for the pairs: paths of 2 edges come from common neighbours, those of 3 from edges taken from their end of
    smaller degree (a hub has few neighbours of larger degree), those of 4 by trying the walks from the source in order, few at first and more for the
    pairs that are still open. Pairs left after 4 edges are searched from both ends.
    """
    if not 1 <= depth <= 10:
        raise ValueError("depth goes from 1 to 10")
    adjacent = symmetric(edges).select("node", "other").where("node <> other").distinct()
    if depth > 2:
        degree = (adjacent := checkpointed(adjacent)).groupBy("node").agg(F.count("*").alias("n"))
        adjacent = adjacent.join(degree, "node").join(degree.select(F.col("node").alias("other"), F.col("n").alias("m")), "other")
        adjacent = adjacent.withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("other")) - 1)
    adjacent = checkpointed(adjacent)
    ends = adjacent.select("node").distinct()
    wanted = pairs.select("source", "target").distinct()
    found = wanted.where("source = target").select("source", "target", F.lit(0).alias("distance"), F.array("source").alias("path"))
    open_ = wanted.where("source <> target").join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi")
    open_ = checkpointed(open_.select("source", "target"))
    for d, step in enumerate((_of_one, _of_two, _of_three, _of_four)[:depth], 1):
        met = checkpointed(step(open_, adjacent))
        found = found.union(met.select("source", "target", F.lit(d).alias("distance"), "path"))
        open_ = checkpointed(open_.join(met, ["source", "target"], "left_anti")) if d < depth else open_
    return found.union(_from_both_ends(open_, adjacent.select("node", "other"), depth)) if depth > 4 else found


def _of_one(open_: DataFrame, adjacent: DataFrame) -> DataFrame:
    ends = adjacent.select(F.col("node").alias("source"), F.col("other").alias("target"))
    return open_.join(ends, ["source", "target"], "left_semi").select("source", "target", F.array("source", "target").alias("path"))


def _of_two(open_: DataFrame, adjacent: DataFrame) -> DataFrame:
    """By the smallest common neighbour."""
    met = open_.join(adjacent.select(F.col("node").alias("source"), F.col("other").alias("x")), "source")
    met = met.join(adjacent.select(F.col("node").alias("target"), F.col("other").alias("x")), ["target", "x"], "left_semi")
    return met.groupBy("source", "target").agg(F.min("x").alias("x")).select("source", "target", F.array("source", "x", "target").alias("path"))


def _of_three(open_: DataFrame, adjacent: DataFrame) -> DataFrame:
    """By edges between a neighbour x of the source and y of the target, each met from its end of smaller degree."""
    up = adjacent.where("m > n or (m = n and other > node)")
    near = lambda end, c: adjacent.select(F.col("node").alias(end), F.col("other").alias(c))
    longer = lambda c, to: up.select(F.col("node").alias(c), F.col("other").alias(to))
    before = open_.join(near("source", "x"), "source").join(longer("x", "y"), "x").join(near("target", "y"), ["target", "y"], "left_semi")
    after = open_.join(near("target", "y"), "target").join(longer("y", "x"), "y").join(near("source", "x"), ["source", "x"], "left_semi")
    met = before.select("source", "target", "x", "y").union(after.select("source", "target", "x", "y"))
    met = met.groupBy("source", "target").agg(F.min(F.struct("x", "y")).alias("p"))
    return met.select("source", "target", F.array("source", "p.x", "p.y", "target").alias("path"))


#: Walks of two edges from a source are tried in order: WALKS for each pair at first, MORE times as many in each further round. Lists of neighbours are met in blocks of WALKS.
WALKS, MORE = 16, 32


def _of_four(open_: DataFrame, adjacent: DataFrame) -> DataFrame:
    """By walks (x, z) from the source in order: the first whose z has a common neighbour with the target gives the smallest path."""
    lists = adjacent.select(F.col("node").alias("x"), F.col("other").alias("z"), F.col("m").alias("of_z"), F.expr(f"pos div {WALKS}").alias("block"), "pos")
    order = Window.partitionBy("source").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = adjacent.select(F.col("node").alias("source"), F.col("other").alias("x"), F.col("m").alias("walks")).join(open_.select("source").distinct(), "source", "left_semi")
    own = checkpointed(own.withColumn("begin", F.sum("walks").over(order) - F.col("walks")))
    of_target = adjacent.select(F.col("node").alias("target"), F.col("n").alias("of_target")).distinct()
    open_, found, low, high = checkpointed(open_.join(of_target, "target")), None, 0, WALKS
    while not open_.isEmpty():
        part = own.where((F.col("begin") < high) & (F.col("begin") + F.col("walks") > low))
        first, last = F.greatest(F.lit(low) - F.col("begin"), F.lit(0)), F.least(F.lit(high) - F.col("begin"), "walks") - 1
        part = part.select("source", "x", first.alias("first"), last.alias("last")).withColumn("block", F.explode(F.expr(f"sequence(first div {WALKS}, last div {WALKS})")))
        tried = open_.join(part, "source").join(lists, ["x", "block"]).where("pos between first and last").select("source", "target", "x", "z", "of_z", "of_target")
        tried = checkpointed(tried.where("z <> source and z <> target"))
        by_z = tried.where("of_z <= of_target").join(adjacent.select(F.col("node").alias("z"), F.col("other").alias("y")), "z")
        by_z = by_z.join(adjacent.select(F.col("node").alias("target"), F.col("other").alias("y")), ["target", "y"], "left_semi")
        by_target = tried.where("of_z > of_target").join(adjacent.select(F.col("node").alias("target"), F.col("other").alias("y")), "target")
        by_target = by_target.join(adjacent.select(F.col("node").alias("z"), F.col("other").alias("y")), ["z", "y"], "left_semi")
        met = by_z.select("source", "target", "x", "z", "y").union(by_target.select("source", "target", "x", "z", "y"))
        met = checkpointed(met.groupBy("source", "target").agg(F.min(F.struct("x", "z", "y")).alias("p")))
        found = met if found is None else found.union(met)
        low, high = high, high * MORE
        further = own.groupBy("source").agg(F.sum("walks").alias("walks")).where(F.col("walks") > low).select("source")
        open_ = checkpointed(open_.join(met, ["source", "target"], "left_anti").join(further, "source", "left_semi").select("source", "target", "of_target"))
    if found is None:
        return open_.select("source", "target", F.array("source").alias("path"))
    return found.select("source", "target", F.array("source", "p.x", "p.z", "p.y", "target").alias("path"))


def _from_both_ends(open_: DataFrame, adjacent: DataFrame, depth: int) -> DataFrame:
    """Both ends are searched in turn, for the pairs not yet joined, so that each end goes half the distance only."""
    found = open_.limit(0).select("source", "target", F.lit(0).alias("distance"), F.array("source").alias("path"))
    begin = lambda c, path: open_.select(c).distinct().select(c, F.col(c).alias("node"), path.alias("path"))
    # The way from a source to a node, and from a node on to a target.
    side = {"source": begin("source", F.array("source")), "target": begin("target", F.slice(F.array("target"), 1, 0))}
    reached = dict(side)
    for d in range(1, depth + 1):
        c = "source" if d % 2 else "target"
        longer = F.concat("path", F.array("other")) if d % 2 else F.concat(F.array("node"), "path")
        front = side[c].join(open_.select(c).distinct(), c, "left_semi").join(adjacent, "node").select(c, F.col("other").alias("node"), longer.alias("path"))
        front = front.groupBy(c, "node").agg(F.min("path").alias("path")).join(reached[c].select(c, "node"), [c, "node"], "left_anti")
        side[c] = checkpointed(front)
        reached[c] = reached[c].union(side[c])
        met = open_.join(side["source"].withColumnRenamed("path", "before"), "source").join(side["target"], ["target", "node"])
        met = checkpointed(met.groupBy("source", "target").agg(F.min(F.concat("before", "path")).alias("path")))
        found = found.union(met.select("source", "target", F.lit(d).alias("distance"), "path"))
        open_ = checkpointed(open_.join(met, ["source", "target"], "left_anti")) if d < depth else open_
    return found


def components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), node: str = "node_id", src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(*by, node_id, component): the smallest node of each node's component, over undirected edges within equal `by` columns.

    Star contraction: about log(n) rounds, each written to the shared folder, until every node has one pair, with a node that has none below it.
    """
    by = list(by)
    pairs = checkpointed(edges.select(*by, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct())
    size = pairs.count()
    for _ in range(rounds if size else 0):
        both = pairs.union(pairs.select(*by, "v", "u"))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = checkpointed(join_hot(both, least, [*by, "u"], "n", 2 * size).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        if _stars(large, by):
            pairs = large
            break
        least = large.groupBy(*by, "u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = join_hot(large, least, [*by, "u"], "n", large.count())
        pairs = checkpointed(small.select(*by, F.explode(ends).alias("e")).select(*by, "e.u", "e.v").where("u <> v").distinct())
        size = pairs.count()
        if _stars(pairs, by):
            break
    else:
        if size:
            raise RuntimeError("components did not settle")
    all_nodes = nodes.select(*by, F.col(node).alias("node_id")).distinct()
    return all_nodes.join(pairs.select(*by, F.col("u").alias("node_id"), F.col("v").alias("m")), [*by, "node_id"], "left").select(*by, "node_id", F.coalesce("m", "node_id").alias("component"))


def _stars(pairs: DataFrame, by: list[str]) -> bool:
    """Whether each u of the pairs (u, v) has one v, which is no u itself."""
    roles = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    ends = pairs.select(*by, F.explode(roles).alias("e")).groupBy(*by, "e.x").agg(F.sum("e.low").alias("low"), F.max("e.top").alias("top"))
    return ends.where("low > 1 or (low = 1 and top = 1)").isEmpty()


def subgraph(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, src, dst, rel_type) of edges on a walk of at most depth edges from each seed: those with an end nearer than depth."""
    near = component_of_seeds(seeds, edges, depth).where(F.col("distance") < depth).select("seed", "node")
    ends = edges.select("src", "dst", "rel_type", F.explode(F.array("src", "dst")).alias("node"))
    return near.join(ends, "node").select("seed", "src", "dst", "rel_type").distinct()


def local_density(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, n_nodes, adjacent_count, density): distinct neighbours within the neighbourhood of a seed over n * (n - 1).

    Every node of a neighbourhood is next to another of its nodes, the one that it was reached from or, for the seed, that it
    reaches. So all n nodes are neighbours, unless the seed is alone; no join with the edges is needed to count them.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth goes from 1 to 3")
    return density_of(component_of_seeds(seeds, edges, depth))


def density_of(near: DataFrame) -> DataFrame:
    """local_density() of what component_of_seeds() has found."""
    n = F.col("n_nodes")
    sizes = near.groupBy("seed").agg(F.count("*").alias("n_nodes")).withColumn("adjacent_count", F.when(n > 1, n).otherwise(0))
    return sizes.withColumn("density", F.when(n > 1, F.bround(F.col("adjacent_count") / (n * (n - 1)), 4)).otherwise(0.0))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, neighbours and neighbour_types (distinct)."""
    return typed_neighbours(nodes, edges).groupBy(F.col("node").alias("node_id")).agg(F.count_distinct("other").alias("neighbours"), F.count_distinct("other_type").alias("neighbour_types"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows by type."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G14."""
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("r")).union(edges.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("r"), F.lit(0)).alias("relationships"))


def type_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type) distinct."""
    return nodes.select(F.lit("entity").alias("kind"), F.col("entity_type").alias("type")).distinct().union(edges.select(F.lit("relationship"), "rel_type").distinct())


def case_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, member_id, member_type, member_value, rel_type, confidence) of entities next to a case."""
    case = nodes.where("lower(entity_type) = 'case'").select(F.col("node_id").alias("case_id"))
    found = typed_neighbours(nodes, edges).join(case, F.col("node") == F.col("case_id"))
    return found.select("case_id", F.col("other").alias("member_id"), F.col("other_type").alias("member_type"), F.col("other_value").alias("member_value"), "rel_type", "confidence")


def case_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """case_id, entities (distinct, no cases), relationships."""
    case = nodes.where("lower(entity_type) = 'case'").select(F.col("node_id").alias("case_id"))
    counted = case_members(nodes, edges).where("lower(member_type) <> 'case'").groupBy("case_id").agg(F.count_distinct("member_id").alias("entities"), F.count("*").alias("relationships"))
    return case.join(counted, "case_id", "left").select("case_id", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("relationships", F.lit(0)).alias("relationships"))


def _shared(members: DataFrame, by: Sequence[str], what: str, n: str) -> DataFrame:
    """Groups with more than one distinct member: each member once, before the lists are made."""
    one = members.select(*by, what).distinct().groupBy(*by).agg(F.count("*").alias(n), F.sort_array(F.collect_list(what)).alias(f"{what}s"))
    return one.where(F.col(n) > 1)


def cross_case(nodes: DataFrame, edges: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Entities next to more than one case: entity_id, entity_type, case_ids, case_count."""
    members = case_members(nodes, edges).where("lower(member_type) <> 'case'").select(F.col("member_id").alias("entity_id"), F.col("member_type").alias("entity_type"), "case_id")
    if entity_type:
        members = members.where(F.lower("entity_type") == entity_type)
    return _shared(members, ["entity_id", "entity_type"], "case_id", "case_count")


def shared_by_persons(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """Entities of these types next to more than one person: entity_id, entity_type, person_ids, person_count."""
    of = nodes.where(F.lower("entity_type").isin(list(types))).select(F.col("node_id").alias("entity_id"), "entity_type")
    people = typed_neighbours(nodes, edges).where("lower(other_type) = 'person'").select(F.col("node").alias("entity_id"), F.col("other").alias("person_id"))
    return _shared(people.join(of, "entity_id"), ["entity_id", "entity_type"], "person_id", "person_count")


def neighbours_of_type(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """Distinct neighbours of these types: phone network, location history, transaction network."""
    return typed_neighbours(nodes, edges).where(F.lower("other_type").isin(list(types))).select(F.col("node").alias("node_id"), F.col("other").alias("other_id"), "other_type", "other_value", "rel_type").distinct()


def central(relationships: DataFrame, by: str = "investigation_id") -> DataFrame:
    """(by, entity_id, ends): all entities with the most relationship ends of their investigation."""
    ends = relationships.select(by, F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).groupBy(by, "entity_id").agg(F.count("*").alias("ends"))
    most = ends.groupBy(by).agg(F.max("ends").alias("most"))
    return ends.join(most, by).where("ends = most").select(by, "entity_id", "ends")


def undirected_edges(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(a, b, rel_type, n, confidence): edges once per pair and type, whatever their direction; grouped in this many tasks, if given."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type", "confidence")
    pairs = pairs.repartition(tasks, "a", "b", "rel_type") if tasks else pairs
    return pairs.groupBy("a", "b", "rel_type").agg(F.count("*").alias("n"), F.bround(F.avg("confidence"), 4).alias("confidence"))


def node_removal(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of removed (node_id) and all that touches them."""
    gone = removed.select("node_id").distinct()
    left = edges.join(gone, edges["src"] == gone["node_id"], "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left.join(gone, left["dst"] == gone["node_id"], "left_anti")


def lower_type(c: str = "entity_type") -> Column:
    return F.lower(F.trim(F.col(c)))
