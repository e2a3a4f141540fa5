"""Registered queries of the graph and analytics operators (G, A, I, K1-K6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as a
from ..operators import graph as g
from ..operators import risk as k
from . import adapters as m
from .registry import query

PADJ = "WITH padj AS (SELECT DISTINCT node, other FROM sym WHERE node <> other)"
TYPED = """WITH near AS (
  SELECT s.node, s.other, s.rel_type, s.confidence, n.entity_type AS other_type, n.value AS other_value FROM sym s JOIN nodes n ON n.node_id = s.other
)"""
DEGREES = """WITH deg AS (
  SELECT node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o + i)::BIGINT AS total_degree
  FROM (SELECT node_id, 0 AS o, 0 AS i FROM nodes UNION ALL SELECT src, 1, 0 FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node_id
), ndeg AS (
  SELECT n.node_id, n.entity_type, n.value, count(*) AS degree FROM nodes n JOIN adj ON adj.node = n.node_id GROUP BY ALL
)"""
MEMBERS = TYPED + """, members AS (
  SELECT c.node_id AS case_id, near.other AS member_id, other_type AS member_type, other_value AS member_value, rel_type, confidence FROM near JOIN nodes c ON c.node_id = near.node AND c.entity_type = 'case'
), crossing AS (
  SELECT member_id AS entity_id, member_type AS entity_type, count(DISTINCT case_id) AS case_count, string_agg(DISTINCT case_id, ',' ORDER BY case_id) AS case_ids FROM members WHERE member_type <> 'case' GROUP BY ALL HAVING count(DISTINCT case_id) > 1
)"""


def both(spark, sf_dir):
    return m.nodes(spark, sf_dir), m.edges(spark, sf_dir)


def seeds(spark, sf_dir, kind):
    """The searched nodes: those of a type whose id is divisible by 20. They are searched in the whole graph."""
    return m.nodes(spark, sf_dir).where((F.col("entity_type") == kind) & (F.col("node_id") % 20 == 0)).select(F.col("node_id").alias("seed_id"))


def pairs(spark, sf_dir):
    """Each person and the next one."""
    key = m.OFFSET["person"] * m.BILLION + F.col("c_custkey")
    return m.read(spark, sf_dir, "customer").select(key.alias("source"), (key + 1).alias("target"))


@query("g01_degrees", DEGREES + " SELECT * FROM deg")
def _(s, d):
    return g.degrees(*both(s, d))


@query("g02_neighbour_degrees", DEGREES + " SELECT * FROM ndeg")
def _(s, d):
    return g.neighbour_degrees(*both(s, d))


@query("g02_most_connected", DEGREES + " SELECT * FROM ndeg WHERE entity_type = 'person' ORDER BY degree DESC, value, node_id LIMIT 25")
def _(s, d):
    return g.most_connected(*both(s, d), 25, "person")


@query("g03_incident", TYPED + " SELECT node AS node_id, rel_type, confidence, other AS other_id, other_type, other_value FROM near")
def _(s, d):
    return g.incident(*both(s, d))


def hops(kind, depth):
    steps = [f"h0 AS (SELECT node_id AS seed, node_id AS node FROM nodes WHERE entity_type = '{kind}' AND node_id % 20 = 0)"]
    steps += [f"h{i} AS MATERIALIZED (SELECT DISTINCT seed, other AS node FROM h{i - 1} JOIN padj USING (node))" for i in range(1, depth + 1)]
    every = " UNION ALL ".join(f"SELECT *, {i} AS distance FROM h{i}" for i in range(depth + 1))
    return PADJ + ", " + ", ".join(steps) + f", hops AS (SELECT seed, node, min(distance)::BIGINT AS distance FROM ({every}) GROUP BY seed, node)"


@query("g04_k_hop", hops("person", 3) + " SELECT * FROM hops WHERE distance > 0")
def _(s, d):
    return g.k_hop(seeds(s, d, "person"), m.edges(s, d), 3)


@query(
    "g05_paths",
    PADJ + """, step AS (SELECT DISTINCT node, other, rel_type FROM sym), p1 AS (
  SELECT v.node_id AS seed, other AS node, [v.node_id, other] AS path, [rel_type] AS types FROM nodes v JOIN step ON step.node = v.node_id WHERE v.entity_type = 'vehicle' AND v.node_id % 20 = 0 AND v.node_id <> other
), p2 AS (
  SELECT seed, step.other AS node, list_append(path, step.other) AS path, list_append(types, rel_type) AS types FROM p1 JOIN step USING (node) WHERE NOT list_contains(path, step.other)
) SELECT seed, node, array_to_string(path, ',') AS path, array_to_string(types, ',') AS types FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)""",
)
def _(s, d):
    return g.paths(seeds(s, d, "vehicle"), m.edges(s, d), 2)


SHORT = PADJ + """, pairs AS (SELECT 1000000000 + c_custkey AS source, 1000000000 + c_custkey + 1 AS target FROM customer
), near AS MATERIALIZED (
  SELECT source, target, arg_min(path, (len(path), path)) AS path FROM (
    SELECT source, target, [source, target] AS path FROM pairs SEMI JOIN padj ON padj.node = source AND padj.other = target
    UNION ALL SELECT source, target, [source, x.other, target] FROM pairs JOIN padj x ON x.node = source JOIN padj y ON y.node = target AND y.other = x.other) GROUP BY source, target
), open AS MATERIALIZED (SELECT * FROM pairs ANTI JOIN near USING (source, target)
), s2 AS MATERIALIZED (SELECT source, target, y.other AS node, min([source, x.other, y.other]) AS path FROM open JOIN padj x ON x.node = source JOIN padj y ON y.node = x.other GROUP BY ALL
), t2 AS MATERIALIZED (SELECT source, target, y.other AS node, min([x.other, target]) AS path FROM open JOIN padj x ON x.node = target JOIN padj y ON y.node = x.other GROUP BY ALL
), far AS (
  SELECT source, target, arg_min(path, (len(path), path)) AS path FROM (
    SELECT source, target, list_append(path, target) AS path FROM s2 JOIN padj ON padj.node = s2.node AND padj.other = target
    UNION ALL SELECT source, target, list_concat(s2.path, t2.path) FROM s2 JOIN t2 USING (source, target, node)) GROUP BY source, target
), short AS (SELECT * FROM near UNION ALL SELECT * FROM far)"""


@query("g06_shortest_paths", SHORT + " SELECT source, target, (len(path) - 1)::BIGINT AS distance, array_to_string(path, ',') AS path FROM short")
def _(s, d):
    return g.shortest_paths(pairs(s, d), m.edges(s, d), 4)


@query("g07_component_of_seeds", hops("phone", 4) + " SELECT * FROM hops")
def _(s, d):
    return g.component_of_seeds(seeds(s, d, "phone"), m.edges(s, d), 4)


#: Smallest labels travel one edge a round; the graph's components are at most 12 edges wide.
ROUNDS = ", ".join(f"l{i + 1} AS MATERIALIZED (SELECT node, min(c) AS c FROM (SELECT * FROM l{i} UNION ALL SELECT adj.node, c FROM l{i} JOIN adj ON adj.other = l{i}.node) GROUP BY node)" for i in range(12))


@query("g08_components", f"WITH l0 AS (SELECT node_id AS node, node_id AS c FROM nodes), {ROUNDS} SELECT node AS node_id, c AS component FROM l12")
def _(s, d):
    return g.components(*both(s, d))


@query(
    "g09_subgraph",
    hops("vehicle", 2) + " SELECT DISTINCT seed, src, dst, rel_type FROM hops JOIN edges ON node = src OR node = dst WHERE distance < 2",
)
def _(s, d):
    return g.subgraph(seeds(s, d, "vehicle"), m.edges(s, d), 2)


DENSITY = hops("phone", 2) + """, inside AS (
  SELECT a.seed, count(DISTINCT b.node) AS adjacent_count FROM hops a JOIN padj ON padj.node = a.node JOIN hops b ON b.seed = a.seed AND b.node = padj.other GROUP BY a.seed
), sizes AS (SELECT seed, count(*) AS n_nodes FROM hops GROUP BY seed)"""


@query(
    "g10_local_density",
    DENSITY + " SELECT seed, n_nodes, coalesce(adjacent_count, 0) AS adjacent_count, CASE WHEN n_nodes > 1 THEN round_even(coalesce(adjacent_count, 0) / (n_nodes * (n_nodes - 1)), 4) ELSE 0 END::DOUBLE AS density FROM sizes LEFT JOIN inside USING (seed)",
)
def _(s, d):
    return g.local_density(seeds(s, d, "phone"), m.edges(s, d), 2)


@query("g11_bridges", TYPED + " SELECT node AS node_id, count(DISTINCT other) AS neighbours, count(DISTINCT other_type) AS neighbour_types FROM near GROUP BY node")
def _(s, d):
    return g.bridges(*both(s, d))


@query("g12_relationship_types", "SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type")
def _(s, d):
    return g.distribution(m.edges(s, d), "rel_type")


@query("g13_entity_types", "SELECT entity_type, count(*) AS n FROM nodes GROUP BY entity_type")
def _(s, d):
    return g.distribution(m.nodes(s, d), "entity_type")


@query("g14_totals", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS relationships")
def _(s, d):
    return g.totals(*both(s, d))


@query("g15_type_lists", "SELECT DISTINCT 'entity' AS kind, entity_type AS type FROM nodes UNION ALL SELECT DISTINCT 'relationship', rel_type FROM edges")
def _(s, d):
    return g.type_lists(*both(s, d))


@query("g16_case_members", MEMBERS + " SELECT * FROM members")
def _(s, d):
    return g.case_members(*both(s, d))


CASE_STATS = """, stats AS (
  SELECT n.node_id AS case_id, count(DISTINCT member_id) AS entities, count(member_id) AS relationships FROM nodes n LEFT JOIN (SELECT * FROM members WHERE member_type <> 'case') x ON x.case_id = n.node_id WHERE n.entity_type = 'case' GROUP BY n.node_id
)"""


@query("g17_case_statistics", MEMBERS + CASE_STATS + " SELECT * FROM stats")
def _(s, d):
    return g.case_statistics(*both(s, d))


@query("g18_cross_case", MEMBERS + " SELECT * FROM crossing")
def _(s, d):
    return g.cross_case(*both(s, d))


SHARED = TYPED + """, shared AS (
  SELECT e.node_id AS entity_id, e.entity_type, count(DISTINCT other) AS person_count, string_agg(DISTINCT other, ',' ORDER BY other) AS person_ids
  FROM near JOIN nodes e ON e.node_id = near.node WHERE other_type = 'person' AND e.entity_type IN ({kinds}) GROUP BY ALL HAVING count(DISTINCT other) > 1
)"""


@query("g19_shared_phones_vehicles", SHARED.format(kinds="'phone', 'vehicle'") + " SELECT * FROM shared")
def _(s, d):
    return g.shared_by_persons(*both(s, d), ["phone", "vehicle"])


@query("g20_shared_by_persons", SHARED.format(kinds="'phone', 'vehicle', 'device', 'location'") + " SELECT * FROM shared")
def _(s, d):
    return g.shared_by_persons(*both(s, d), ["phone", "vehicle", "device", "location"])


@query("g21_typed_networks", TYPED + " SELECT DISTINCT node AS node_id, other AS other_id, other_type, other_value, rel_type FROM near WHERE other_type IN ('phone', 'location', 'organization')")
def _(s, d):
    return g.neighbours_of_type(*both(s, d), ["phone", "location", "organization"])


@query(
    "g22_central",
    """WITH ends AS (SELECT investigation_id, x AS entity_id, count(*) AS ends FROM (SELECT investigation_id, unnest([source_entity_id, target_entity_id]) AS x FROM relationships) GROUP BY ALL)
SELECT e.* FROM ends e JOIN (SELECT investigation_id, max(ends) AS m FROM ends GROUP BY ALL) t ON t.investigation_id = e.investigation_id AND e.ends = m""",
)
def _(s, d):
    return g.central(m.relationships(s, d))


@query("g23_undirected", "SELECT least(src, dst) AS a, greatest(src, dst) AS b, rel_type, count(*) AS n, round_even(avg(confidence), 4) AS confidence FROM edges GROUP BY ALL")
def _(s, d):
    return g.undirected_edges(m.edges(s, d), m.tasks(s, d))


@query(
    "a01_entity_profile",
    DEGREES + " SELECT deg.*, coalesce(degree, 0) AS neighbour_count, total_degree AS relationship_count FROM deg LEFT JOIN ndeg USING (node_id)",
)
def _(s, d):
    return a.entity_profile(*both(s, d))


CONNECT = DEGREES + """, connect AS (SELECT node_id, total_degree, least(1.0, round_even(total_degree / (SELECT max(degree) FROM ndeg), 4))::DOUBLE AS score FROM deg)"""


@query("a02_connection_score", CONNECT + " SELECT * FROM connect")
def _(s, d):
    return a.connection_score(*both(s, d))


DIVERSE = "diverse AS (SELECT node AS node_id, count(DISTINCT rel_type) AS type_count, count(*) AS relationship_count, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS types FROM sym GROUP BY node)"


@query("a03_relationship_diversity", f"WITH {DIVERSE} SELECT * FROM diverse")
def _(s, d):
    return a.relationship_diversity(*both(s, d))


@query(
    "a04_neighbourhood_summary",
    DENSITY + """, kinds AS (SELECT seed, entity_type, count(*) AS n FROM hops JOIN nodes ON node_id = node WHERE distance > 0 GROUP BY ALL
), summary AS (SELECT seed, sum(n)::BIGINT AS neighbour_count, string_agg(entity_type || ':' || n, ',' ORDER BY entity_type) AS type_counts FROM kinds GROUP BY seed)
SELECT seed, coalesce(neighbour_count, 0) AS neighbour_count, coalesce(type_counts, '') AS type_counts, CASE WHEN n_nodes > 1 THEN round_even(coalesce(adjacent_count, 0) / (n_nodes * (n_nodes - 1)), 4) ELSE 0 END::DOUBLE AS density
FROM sizes LEFT JOIN inside USING (seed) LEFT JOIN summary USING (seed)""",
)
def _(s, d):
    return a.neighbourhood_summary(seeds(s, d, "phone"), m.nodes(s, d), m.edges(s, d), 2)


@query("a05_structural_outliers", DEGREES + " SELECT * FROM ndeg ORDER BY degree DESC, value, node_id LIMIT 20")
def _(s, d):
    return a.structural_outliers(*both(s, d), 20)


@query("a06_path_analysis", SHORT + " SELECT source, target, (len(path) - 1)::BIGINT AS distance, array_to_string(path, ',') AS path, path IS NOT NULL AS connected FROM pairs LEFT JOIN short USING (source, target)")
def _(s, d):
    return a.path_analysis(pairs(s, d), m.edges(s, d), 4)


KEYS = PADJ + """, keys AS (
  SELECT DISTINCT p.node, n.entity_type || ':' || lower(trim(n.value)) AS key FROM sym p JOIN nodes n ON n.node_id = p.other JOIN nodes o ON o.node_id = p.node AND o.entity_type = 'person'
), sized AS (SELECT node, key, count(*) OVER (PARTITION BY node) AS n FROM keys
), shared AS (SELECT x.node AS a, y.node AS b, count(*) AS shared, any_value(x.n) AS na, any_value(y.n) AS nb FROM sized x JOIN sized y ON x.key = y.key AND x.node < y.node GROUP BY ALL
), jac AS (SELECT * FROM (SELECT a, b, shared, round_even(shared / (na + nb - shared), 4)::DOUBLE AS score FROM shared) WHERE score >= 0.2
)"""


def keys(s, d):
    nodes = m.nodes(s, d)
    return a.neighbour_keys(nodes, m.edges(s, d)).join(nodes.where("entity_type = 'person'").select(F.col("node_id").alias("node")), "node", "left_semi")


@query("a07_jaccard", KEYS + " SELECT * FROM jac")
def _(s, d):
    return a.jaccard(keys(s, d), threshold=0.2)


@query(
    "a08_similar_entities",
    KEYS + """, two AS (SELECT a AS entity, b AS similar_id, shared, score FROM jac UNION ALL SELECT b, a, shared, score FROM jac)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, similar_id) AS rank FROM two) WHERE rank <= 10""",
)
def _(s, d):
    return a.similar_entities(keys(s, d))


@query("a09_shared_neighbours", KEYS + " SELECT x.node AS a, y.node AS b, string_agg(x.key, ',' ORDER BY x.key) AS shared_keys FROM keys x JOIN keys y ON x.key = y.key AND y.node = x.node + 1 GROUP BY ALL")
def _(s, d):
    return a.shared_neighbours(pairs(s, d).select(F.col("source").alias("a"), F.col("target").alias("b")), keys(s, d))


@query(
    "a10_similarity_levels",
    KEYS + """ SELECT a, b, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'moderate' WHEN score >= 0.25 THEN 'limited' ELSE 'low' END AS level,
CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Moderate' WHEN score >= 0.25 THEN 'Limited' ELSE 'Low' END || ' similarity: ' || shared || ' shared neighbours.' AS explanation FROM jac""",
)
def _(s, d):
    return a.jaccard(keys(s, d), threshold=0.2).select("a", "b", a.similarity_level(F.col("score")).alias("level"), a.similarity_text(F.col("score"), F.col("shared")).alias("explanation"))


def _pattern(kind, title, confidence, rows):
    return f"SELECT '{kind}' AS pattern_type, '{title}' AS title, {confidence}::DOUBLE AS confidence, {rows}"


HIGH = _pattern("high_connectivity", "High connectivity entity", 0.9, "node_id AS entity_id, degree AS value FROM ndeg WHERE degree >= 5")
BRIDGE = _pattern("bridge_entity", "Bridge entity", 0.8, "node AS entity_id, count(DISTINCT other_type) AS value FROM near GROUP BY node HAVING count(DISTINCT other_type) >= 2")


@query("a11_high_connectivity", f"{DEGREES} {HIGH}")
def _(s, d):
    return a.high_connectivity(*both(s, d))


@query("a12_shared_entity", SHARED.format(kinds="'phone', 'vehicle', 'device', 'location'") + _pattern(" shared_entity", "Entity shared by persons", 0.95, "entity_id, person_count AS value FROM shared").replace("' shared", "'shared"))
def _(s, d):
    return a.shared_entity(*both(s, d))


@query("a13_diversity", f"WITH {DIVERSE} " + _pattern("relationship_diversity", "Relationship diversity", 0.85, "node_id AS entity_id, type_count AS value FROM diverse WHERE type_count >= 3"))
def _(s, d):
    return a.diversity_pattern(*both(s, d))


@query("a14_bridge", f"{TYPED} {BRIDGE}")
def _(s, d):
    return a.bridge_pattern(*both(s, d))


@query("a15_short_paths", SHORT + " SELECT 'short_path' AS pattern_type, 0.95::DOUBLE AS confidence, source, target, (len(path) - 1)::BIGINT AS distance FROM near")
def _(s, d):
    return a.short_path_pattern(pairs(s, d), m.edges(s, d))


PERSONS = (
    _pattern("person_connectivity", "Highly connected person", 0.9, "node_id AS entity_id, total_degree AS value FROM deg JOIN nodes USING (node_id) WHERE entity_type = 'person' AND total_degree >= 5")
    + " UNION ALL "
    + _pattern("person_diversity", "Person with diverse relationships", 0.85, "node_id, type_count FROM diverse JOIN nodes USING (node_id) WHERE entity_type = 'person' AND type_count >= 3")
)


@query("a16_person_patterns", f"{DEGREES}, {DIVERSE} {PERSONS}")
def _(s, d):
    return a.person_patterns(*both(s, d))


@query(
    "a17_case_profiles",
    MEMBERS + """, kinds AS (SELECT case_id, member_type, count(DISTINCT member_id) AS n FROM members GROUP BY ALL)
SELECT case_id, sum(n)::BIGINT AS members, string_agg(member_type || ':' || n, ',' ORDER BY member_type) AS type_counts FROM kinds GROUP BY case_id""",
)
def _(s, d):
    return a.case_profile_pattern(*both(s, d))


@query("a18_general_patterns", f"{DEGREES}, {TYPED[5:]} {HIGH} UNION ALL {BRIDGE}")
def _(s, d):
    return a.general_patterns(*both(s, d))


CROSS = """, one AS (SELECT DISTINCT c.entity_id, c.entity_type, x.case_id FROM crossing c JOIN members x ON x.member_id = c.entity_id
), crossed AS (
  SELECT case_id, entity_id, 'cross_case' AS indicator, 0.75::DOUBLE AS score, 'HIGH' AS level FROM one
  UNION ALL SELECT case_id, entity_id, 'shared_phone', 0.70, 'HIGH' FROM one WHERE entity_type = 'phone'
  UNION ALL SELECT case_id, entity_id, 'shared_vehicle', 0.65, 'MEDIUM' FROM one WHERE entity_type = 'vehicle'
)"""
INDICATORS = MEMBERS + CROSS + f""", {DEGREES[5:]}, connected AS (
  SELECT DISTINCT case_id, member_id AS entity_id, 'connectivity' AS indicator, least(1.0, total_degree / 20)::DOUBLE AS score, 'MEDIUM' AS level FROM members JOIN deg ON node_id = member_id WHERE total_degree >= 3
), every AS (SELECT * FROM crossed UNION ALL SELECT * FROM connected
), ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, indicator, entity_id) AS rank FROM every
), scored AS (SELECT case_id, round_even(sum(score / rank) / sum(1 / rank), 4)::DOUBLE AS score FROM ranked WHERE rank <= 10 GROUP BY case_id)"""
BAND = "CASE WHEN {s} >= 0.85 THEN 'CRITICAL_REVIEW' WHEN {s} >= 0.65 THEN 'HIGH' WHEN {s} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


@query("i01_cross_case_indicators", MEMBERS + CROSS + " SELECT * FROM crossed")
def _(s, d):
    return a.cross_case_indicators(*both(s, d))


@query("i03_connectivity_indicators", INDICATORS + " SELECT * FROM connected")
def _(s, d):
    return a.connectivity_indicators(*both(s, d))


@query(
    "i04_entity_indicators",
    TYPED + """, c AS (SELECT node AS node_id, CASE WHEN other_type = 'phone' THEN 'communication' WHEN other_type = 'location' THEN 'location' ELSE 'transaction' END AS indicator, count(DISTINCT other) AS n
  FROM near WHERE other_type IN ('phone', 'location', 'organization') GROUP BY ALL)
SELECT node_id, indicator, n, least(1.0, n / CASE WHEN indicator = 'location' THEN 10 ELSE 20 END)::DOUBLE AS score FROM c""",
)
def _(s, d):
    return a.entity_indicators(*both(s, d))


@query("i07_case_scores", INDICATORS + f" SELECT case_id, score, {BAND.format(s='score')} AS priority FROM scored")
def _(s, d):
    nodes, edges = both(s, d)
    scores = a.case_score(a.cross_case_indicators(nodes, edges).union(a.connectivity_indicators(nodes, edges)))
    return scores.withColumn("priority", a.priority(F.col("score")))


@query(
    "i09_case_analysis",
    INDICATORS + CASE_STATS + f""", kinds AS (SELECT case_id, indicator, count(*) AS n FROM every GROUP BY ALL
), counted AS (SELECT case_id, sum(n)::BIGINT AS indicators, string_agg(indicator || ':' || n, ',' ORDER BY indicator) AS categories FROM kinds GROUP BY case_id)
SELECT case_id, coalesce(score, 0) AS score, {BAND.format(s='coalesce(score, 0)')} AS priority, coalesce(indicators, 0) AS indicators, coalesce(categories, '') AS categories, entities, relationships,
'Case has ' || coalesce(indicators, 0) || ' indicators; review priority ' || {BAND.format(s='coalesce(score, 0)')} || '.' AS summary
FROM stats LEFT JOIN scored USING (case_id) LEFT JOIN counted USING (case_id)""",
)
def _(s, d):
    return a.case_analysis(*both(s, d))


#: The signals over the whole graph, but for density: every node's nodes two steps away are too many for the SQL, and tested on a small graph.
SIGNALS = PADJ + """, pdeg AS (
  SELECT node_id, count(other) AS total_degree FROM nodes LEFT JOIN sym ON sym.node = node_id GROUP BY node_id
), pn AS (SELECT node AS node_id, count(*) AS degree FROM padj GROUP BY node
), pdiv AS (SELECT node AS node_id, count(DISTINCT rel_type) AS types FROM sym GROUP BY node
), people AS (SELECT node AS node_id, count(DISTINCT other) AS p FROM sym JOIN nodes n ON n.node_id = other AND n.entity_type = 'person' GROUP BY node
), pats AS (SELECT node_id, count(*) AS n FROM (
    SELECT node_id FROM pn WHERE degree >= 5 UNION ALL SELECT node_id FROM pdeg JOIN nodes USING (node_id) WHERE entity_type = 'person' AND total_degree >= 5
    UNION ALL SELECT node_id FROM pdiv JOIN nodes USING (node_id) WHERE entity_type = 'person' AND types >= 3) GROUP BY node_id
), two AS (SELECT node, other FROM padj UNION SELECT x.node, y.other FROM padj x JOIN padj y ON y.node = x.other WHERE x.node <> y.other
), dens AS (SELECT node AS node_id, round_even(1 / count(*), 4) AS density FROM two GROUP BY node
), sig AS (
  SELECT node_id, entity_type, least(1.0, round_even(total_degree / (SELECT max(degree) FROM pn), 4))::DOUBLE AS connectivity, least(1.0, coalesce(types, 0) / 6)::DOUBLE AS diversity,
    CASE WHEN p > 1 THEN least(1.0, p / 5) ELSE 0 END::DOUBLE AS shared, 0::DOUBLE AS accomplice, least(1.0, coalesce(n, 0) / 4)::DOUBLE AS patterns, coalesce(density, 0)::DOUBLE AS density
  FROM nodes LEFT JOIN pdeg USING (node_id) LEFT JOIN pdiv USING (node_id) LEFT JOIN people USING (node_id) LEFT JOIN pats USING (node_id) LEFT JOIN dens USING (node_id)
), risk AS (SELECT *, printf('%.4f', (CONTRIBUTIONS) / TOTAL::DOUBLE)::DOUBLE AS score FROM sig)""".replace(
    "CONTRIBUTIONS", " + ".join(f"printf('%.4f', {n} * {w}::DOUBLE)::DOUBLE" for n, w in k.WEIGHTS.items())
).replace("TOTAL", repr(sum(k.WEIGHTS.values())))


def signals(s, d, for_score=False, for_top=False):
    return k.entity_signals(m.nodes(s, d), m.edges(s, d), for_score, for_top)


LEVEL = "CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.25 THEN 'low' ELSE 'minimal' END AS level"


@query("k01_entity_risk", SIGNALS + f" SELECT node_id, entity_type, score, {LEVEL} FROM risk")
def _(s, d):
    return k.entity_risk(signals(s, d, for_score=True)).drop("top_signals", "explanation")


@query("k02_pattern_counts", SIGNALS + " SELECT node_id, n FROM pats")
def _(s, d):
    return k.pattern_counts(m.nodes(s, d), m.edges(s, d))


@query(
    "k03_case_risk",
    MEMBERS + f""", c AS (SELECT node_id AS case_id, count(DISTINCT member_id) AS e, count(DISTINCT rel_type) AS t FROM nodes LEFT JOIN members ON case_id = node_id WHERE entity_type = 'case' GROUP BY node_id
), r AS (SELECT case_id, printf('%.4f', (printf('%.4f', least(1.0, e / 20)::DOUBLE)::DOUBLE + printf('%.4f', least(1.0, t / 6)::DOUBLE)::DOUBLE) / 2)::DOUBLE AS score FROM c) SELECT *, {LEVEL} FROM r""",
)
def _(s, d):
    return k.case_risk(*both(s, d))


WEIGHTED = ", ".join(f"{{place: {i}, signal: '{n}', value: printf('%.4f', {n})::DOUBLE, weight: {w}::DOUBLE, contribution: printf('%.4f', {n} * {w}::DOUBLE)::DOUBLE}}" for i, (n, w) in enumerate(k.WEIGHTS.items()))
LONG = SIGNALS + f", long AS (SELECT node_id, r.place, r.signal, r.value, r.weight, r.contribution FROM (SELECT node_id, unnest([{WEIGHTED}]) AS r FROM sig))"


@query(
    "k05_top_signals",
    LONG + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY contribution DESC, place) AS rank FROM long WHERE value > 0
), top AS (SELECT node_id, string_agg(signal, ',' ORDER BY rank) AS top_signals, string_agg(signal, ', ' ORDER BY rank) AS names FROM ranked WHERE rank <= 3 GROUP BY node_id)
SELECT node_id, coalesce(top_signals, '') AS top_signals, CASE WHEN names IS NULL THEN 'No active signals.' ELSE 'Main signals: ' || names || '.' END AS explanation FROM nodes LEFT JOIN top USING (node_id)""",
)
def _(s, d):
    return k.entity_risk(signals(s, d, for_top=True)).select("node_id", "top_signals", "explanation")


@query("k06_signal_table", LONG + " SELECT * EXCLUDE (place) FROM long")
def _(s, d):
    return k.signal_table(signals(s, d))
