"""Profiles, similarity, patterns (A1-A18) and case indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as g
from . import similar


def entity_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1: degrees, distinct neighbours, relationships of every node."""
    found = g.neighbour_degrees(nodes, edges).select("node_id", F.col("degree").alias("neighbour_count"))
    return g.degrees(nodes, edges).join(found, "node_id", "left").select("node_id", "out_degree", "in_degree", "total_degree", F.coalesce("neighbour_count", F.lit(0)).alias("neighbour_count"), F.col("total_degree").alias("relationship_count"))


def connection_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A2: total degree over the largest distinct-neighbour degree, at most 1, 4 digits; 0 without any edge."""
    most = g.neighbour_degrees(nodes, edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("most"))
    score = F.when(F.col("most") > 0, F.least(F.lit(1.0), F.bround(F.col("total_degree") / F.col("most"), 4))).otherwise(0.0)
    return g.degrees(nodes, edges).join(F.broadcast(most)).select("node_id", "total_degree", score.alias("score"))  # one row


def relationship_diversity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3: node_id, type_count, relationship_count, types (sorted, no nulls)."""
    ends = g.symmetric(edges).groupBy(F.col("node").alias("node_id"), "rel_type").agg(F.count("*").alias("n"))
    by_node = ends.groupBy("node_id").agg(F.sum("n").alias("relationship_count"), F.sort_array(F.collect_list("rel_type")).alias("types"))
    return by_node.select("node_id", F.size("types").cast("long").alias("type_count"), "relationship_count", "types")


def neighbourhood_summary(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """A4: seed, neighbour_count, type_counts (map, no null types), density at depth min(depth, 3)."""
    reached = g.checkpointed(g.component_of_seeds(seeds, edges, depth))  # one search for both
    near = reached.where("distance > 0").select("seed", F.col("node").alias("node_id")).join(nodes.select("node_id", "entity_type"), "node_id", "left")
    kinds = near.groupBy("seed", "entity_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.when(F.col("entity_type").isNotNull(), F.struct("entity_type", "n"))))
    found = kinds.groupBy("seed").agg(F.sum("n").alias("neighbour_count"), F.map_from_entries(entries).alias("type_counts"))
    density = g.density_of(reached.where(F.col("distance") <= min(depth, 3))).select("seed", "density")
    none = F.create_map().cast("map<string,bigint>")
    return density.join(found, "seed", "left").select("seed", F.coalesce("neighbour_count", F.lit(0)).alias("neighbour_count"), F.coalesce("type_counts", none).alias("type_counts"), "density")


def structural_outliers(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """A5: the most connected nodes (neighbour_degrees holds none of degree 0)."""
    return g.most_connected(nodes, edges, limit)


def path_analysis(pairs: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Every pair with connected, distance and path."""
    found = g.shortest_paths(pairs, edges, depth)
    return pairs.select("source", "target").distinct().join(found, ["source", "target"], "left").withColumn("connected", F.col("distance").isNotNull())


def neighbour_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, key): distinct neighbour keys `type:value` of each node."""
    other = nodes.select(F.col("node_id").alias("other"), F.concat_ws(":", F.lower("entity_type"), F.lower(F.trim("value"))).alias("key"))
    return g.symmetric(edges).select("node", "other").distinct().join(other, "other").select("node", "key").distinct()


def key_classes(keys: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, cls) and (cls, keys, n, members): nodes of equal key sets are one class, which goes by its smallest node."""
    own = (keys if entities is None else keys.join(entities.select("node"), "node", "left_semi")).distinct()
    lists = g.checkpointed(own.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys")))
    classes = g.checkpointed(lists.groupBy("keys").agg(F.min("node").alias("cls"), F.count("*").alias("members")).withColumn("n", F.size("keys")))
    return lists.join(classes, "keys").select("node", "cls"), classes.select("cls", "keys", "n", "members")


def _scored(links: DataFrame, threshold: float) -> DataFrame:
    score = F.bround(F.col("shared") / (F.col("n") - F.col("shared")), 4)
    return links.withColumn("score", score).where((F.col("score") >= threshold) & (F.col("shared") > 0))


def similar_classes(classes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(a, b, shared, score) of all pairs of classes a < b that share a key, with score >= threshold; 4 digits. A class and itself have score 1."""
    return _scored(similar.class_links(classes, threshold), threshold).select("a", "b", "shared", "score")


def jaccard(keys: DataFrame, entities: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """(a, b, shared, score) of all pairs a < b that share a neighbour, with score >= threshold; 4 digits.

    `entities` (node) limits which nodes are compared. Classes of equal key sets are compared, then written out as pairs of nodes, which
    are as many as there are: the classes and their links (similar_classes) are the form that grows with the nodes. A class of one node goes by it, so
    that only pairs with a larger class meet their nodes.
    """
    of, classes = key_classes(keys, entities)
    links = _scored(similar.class_links(classes, threshold), threshold)
    if classes.where("members > 1").isEmpty():
        return links.select("a", "b", "shared", "score")
    alone = links.where("members_a = 1 and members_b = 1").select("a", "b", "shared", "score")
    same = classes.where("members > 1").select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.col("n").cast("long").alias("shared"), F.lit(1.0).alias("score"))
    each = links.where("members_a > 1 or members_b > 1").select(F.col("a").alias("x"), F.col("b").alias("y"), "shared", "score").union(same)
    pairs = each.join(of.select(F.col("cls").alias("x"), F.col("node").alias("p")), "x").join(of.select(F.col("cls").alias("y"), F.col("node").alias("q")), "y")
    return alone.union(pairs.where("x <> y or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared", "score"))


def similar_entities(keys: DataFrame, entities: DataFrame | None = None, threshold: float = 0.2, top: int = 10) -> DataFrame:
    """(entity, similar_id, shared, score, rank): the top of each entity by score, then id.

    Nodes of a class have the same candidates, but for themselves: the best of `top` + 1 of each linked class, and of its own. A class goes by its
    smallest node, so the best `top` + 1 linked classes, by score and class, hold the best `top` + 1 nodes. So no pairs of a class are formed,
    and there are top + 1 rows a node.
    """
    of, classes = key_classes(keys, entities)
    links = g.checkpointed(_scored(similar.class_links(classes, threshold, top + 1), threshold))
    same = classes.where("members > 1").select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.col("n").cast("long").alias("shared"), F.lit(1.0).alias("score"))
    each = links.select(F.col("a").alias("x"), F.col("b").alias("y"), "shared", "score").union(same)
    first = of.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy("node"))).where(F.col("place") <= top + 1)
    found = each.join(first.select(F.col("cls").alias("y"), F.col("node").alias("similar_id")), "y")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "similar_id"))).where(F.col("place") <= top + 1)
    rows = of.select(F.col("node").alias("entity"), F.col("cls").alias("x")).join(best.drop("place"), "x").where("entity <> similar_id")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "similar_id"))
    return rows.select("entity", "similar_id", "shared", "score", rank.alias("rank")).where(F.col("rank") <= top)


def shared_neighbours(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b, shared_keys) of the given pairs."""
    first = pairs.select("a", "b").join(keys.select(F.col("node").alias("a"), "key"), "a")
    return first.join(keys.select(F.col("node").alias("b"), "key"), ["b", "key"]).groupBy("a", "b").agg(F.sort_array(F.collect_list("key")).alias("shared_keys"))


def similarity_level(score: Column) -> Column:
    """A10."""
    return F.when(score >= 0.75, "high").when(score >= 0.5, "moderate").when(score >= 0.25, "limited").otherwise("low")


def similarity_text(score: Column, shared: Column) -> Column:
    """A10."""
    return F.when(shared == 0, "No shared neighbours.").otherwise(F.concat(F.initcap(similarity_level(score)), F.lit(" similarity: "), shared.cast("string"), F.lit(" shared neighbours.")))


def _pattern(df: DataFrame, kind: str, title: str, confidence: float, entity: str, value: str) -> DataFrame:
    return df.select(F.lit(kind).alias("pattern_type"), F.lit(title).alias("title"), F.lit(confidence).alias("confidence"), F.col(entity).alias("entity_id"), F.col(value).cast("long").alias("value"))


def high_connectivity(nodes: DataFrame, edges: DataFrame, least: int = 5, limit: int | None = None) -> DataFrame:
    """A11."""
    found = g.neighbour_degrees(nodes, edges).where(F.col("degree") >= least)
    return _pattern(found.orderBy(F.desc("degree"), "node_id").limit(limit) if limit else found, "high_connectivity", "High connectivity entity", 0.9, "node_id", "degree")


def shared_entity(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("phone", "vehicle", "device", "location")) -> DataFrame:
    """A12."""
    return _pattern(g.shared_by_persons(nodes, edges, types), "shared_entity", "Entity shared by persons", 0.95, "entity_id", "person_count")


def diversity_pattern(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """A13."""
    return _pattern(relationship_diversity(nodes, edges).where(F.col("type_count") >= least), "relationship_diversity", "Relationship diversity", 0.85, "node_id", "type_count")


def bridge_pattern(nodes: DataFrame, edges: DataFrame, least: int = 2, limit: int | None = None) -> DataFrame:
    """A14."""
    found = g.bridges(nodes, edges).where(F.col("neighbour_types") >= least)
    return _pattern(found.orderBy(F.desc("neighbour_types"), F.desc("neighbours"), "node_id").limit(limit) if limit else found, "bridge_entity", "Bridge entity", 0.8, "node_id", "neighbour_types")


def short_path_pattern(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs at most two hops apart."""
    return g.shortest_paths(pairs, edges, 2).select(F.lit("short_path").alias("pattern_type"), F.lit(0.95).alias("confidence"), "source", "target", "distance")


def person_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Persons of degree >= 5, and with >= 3 relationship types."""
    person = nodes.where("lower(entity_type) = 'person'").select("node_id")
    many = g.degrees(nodes, edges).where("total_degree >= 5").join(person, "node_id", "left_semi")
    diverse = relationship_diversity(nodes, edges).where("type_count >= 3").join(person, "node_id", "left_semi")
    return _pattern(many, "person_connectivity", "Highly connected person", 0.9, "node_id", "total_degree").union(_pattern(diverse, "person_diversity", "Person with diverse relationships", 0.85, "node_id", "type_count"))


def case_profile_pattern(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """case_id, members, type_counts."""
    kinds = g.case_members(nodes, edges).select("case_id", "member_id", "member_type").distinct().groupBy("case_id", "member_type").agg(F.count("*").alias("n"))
    return kinds.groupBy("case_id").agg(F.sum("n").alias("members"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("member_type", "n")))).alias("type_counts"))


def general_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A11 and A14."""
    return high_connectivity(nodes, edges).unionByName(bridge_pattern(nodes, edges))


def _indicator(df: DataFrame, case: str, entity: str, kind: str, score: Column, priority: Column) -> DataFrame:
    return df.select(F.col(case).alias("case_id"), F.col(entity).alias("entity_id"), F.lit(kind).alias("indicator"), score.alias("score"), priority.alias("level"))


def cross_case_indicators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per case and entity that other cases have, too; phones and vehicles get a row of their own."""
    found = g.cross_case(nodes, edges).withColumn("case_id", F.explode("case_ids"))
    parts = [_indicator(found, "case_id", "entity_id", "cross_case", F.lit(0.75), F.lit("HIGH"))]
    for kind, score, level in (("phone", 0.70, "HIGH"), ("vehicle", 0.65, "MEDIUM")):
        parts.append(_indicator(found.where(F.lower("entity_type") == kind), "case_id", "entity_id", f"shared_{kind}", F.lit(score), F.lit(level)))
    return reduce(DataFrame.union, parts)


def connectivity_indicators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities of a case with degree >= 3; score min(degree / 20, 1)."""
    degree = g.degrees(nodes, edges).where("total_degree >= 3").select(F.col("node_id").alias("member_id"), "total_degree")
    found = g.case_members(nodes, edges).select("case_id", "member_id").distinct().join(degree, "member_id")
    return _indicator(found, "case_id", "member_id", "connectivity", F.least(F.lit(1.0), F.col("total_degree") / 20), F.lit("MEDIUM"))


def _counted(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], kind: str, over: int) -> DataFrame:
    found = g.neighbours_of_type(nodes, edges, types).groupBy("node_id").agg(F.count_distinct("other_id").alias("n"))
    return found.select("node_id", F.lit(kind).alias("indicator"), "n", F.least(F.lit(1.0), F.col("n") / over).alias("score"))


def entity_indicators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Communication (phones / 20), location (places / 10), transaction (organisations and accounts / 20) per entity."""
    return (
        _counted(nodes, edges, ("phone",), "communication", 20)
        .union(_counted(nodes, edges, ("location",), "location", 10))
        .union(_counted(nodes, edges, ("organization", "bank", "account", "bank_account", "transaction"), "transaction", 20))
    )


def case_score(indicators: DataFrame) -> DataFrame:
    """The ten highest scores of a case, weighted by 1 / rank; 4 digits."""
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "indicator", "entity_id"))
    top = indicators.withColumn("rank", rank).where("rank <= 10")
    return top.groupBy("case_id").agg(F.bround(F.sum(F.col("score") / F.col("rank")) / F.sum(1 / F.col("rank")), 4).alias("score"))


def priority(score: Column) -> Column:
    """I8."""
    return F.when(score >= 0.85, "CRITICAL_REVIEW").when(score >= 0.65, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def case_analysis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of every case: score, priority, indicator counts, entities, relationships, and a summary sentence."""
    found = g.checkpointed(cross_case_indicators(nodes, edges).union(connectivity_indicators(nodes, edges)))
    scores = case_score(found)
    counts = found.groupBy("case_id", "indicator").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.sum("n").alias("indicators"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("indicator", "n")))).alias("categories"))
    joined = g.case_statistics(nodes, edges).join(scores, "case_id", "left").join(counts, "case_id", "left")
    score, number = F.coalesce("score", F.lit(0.0)), F.coalesce("indicators", F.lit(0))
    text = F.concat(F.lit("Case has "), number.cast("string"), F.lit(" indicators; review priority "), priority(score), F.lit("."))
    return joined.select("case_id", score.alias("score"), priority(score).alias("priority"), number.alias("indicators"), F.coalesce("categories", F.create_map().cast("map<string,bigint>")).alias("categories"), "entities", "relationships", text.alias("summary"))
