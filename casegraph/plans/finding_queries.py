"""Registered queries of the finding rules, their risk and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as b
from ..operators import graph as g
from ..operators import risk as k
from . import adapters as m
from .registry import query

INV = "investigation_id"


R = """WITH r AS (
  SELECT investigation_id AS inv, id, source_entity_id AS s, target_entity_id AS t, relationship_type AS kind, confidence::DOUBLE AS c, evidence_id AS e FROM finding_relationships
), ends AS (SELECT *, unnest([s, t]) AS x FROM r
), pairs AS (SELECT *, least(s, t) AS a, greatest(s, t) AS b FROM r WHERE s <> t
), nb AS (SELECT DISTINCT inv, a AS x, b AS y FROM pairs UNION SELECT inv, b, a FROM pairs
), central AS (
  SELECT inv, x FROM (SELECT inv, x, count(*) AS n, max(count(*)) OVER (PARTITION BY inv) AS m, count(*) OVER (PARTITION BY inv) AS nodes FROM ends GROUP BY inv, x) WHERE n = m AND nodes >= 2
)"""


def ids(c):
    return f"coalesce(array_to_string(list_sort(list_distinct(list({c}) FILTER ({c} IS NOT NULL))), ','), '')"


def found(rule, confidence, high, entity, evidence="''", relationship="''", source=""):
    severity = f"CASE WHEN {high} THEN 'high' ELSE 'medium' END" if high else "'medium'"
    return f"SELECT inv AS investigation_id, {rule}::BIGINT AS rule, '{b.TITLES[rule]}' AS title, {severity} AS severity, round_even(({confidence})::DOUBLE, 3) AS confidence, {entity} AS entity_ids, {evidence} AS evidence_ids, {relationship} AS relationship_ids {source}"


def up(base, step, n, cap):
    return f"least({cap}::DOUBLE, {base}::DOUBLE + {step}::DOUBLE * ({n}))"


def txt(c):
    return f"coalesce(({c})::VARCHAR, '')"


ENDS_OF = "CASE WHEN s = t THEN s::VARCHAR ELSE least(s, t) || ',' || greatest(s, t) END"
B1 = found(1, f"least(0.95::DOUBLE, {up(0.6, 0.08, 'n', 0.95)} + CASE WHEN ev <> '' THEN 0.03::DOUBLE ELSE 0 END)", "n >= 5", ENDS_OF, "ev", "rel", f"FROM (SELECT inv, s, t, kind, count(*) AS n, {ids('e')} AS ev, {ids('id')} AS rel FROM r GROUP BY inv, s, t, kind HAVING count(*) >= 2)")
B2 = found(2, "c", "c >= 0.9", ENDS_OF, txt("e"), txt("id"), "FROM r WHERE c >= 0.8")
BY_X = f"(SELECT inv, x, count(*) AS n, count(DISTINCT kind) AS k, {ids('e')} AS ev, {ids('id')} AS rel FROM ends GROUP BY inv, x)"
B3 = found(3, up(0.55, 0.05, "n", 0.9), "n >= 5", txt("x"), "ev", "rel", f"FROM {BY_X} WHERE n >= 3")
B4 = found(4, "least(0.9::DOUBLE, greatest(0.75::DOUBLE, c))", "least(0.9::DOUBLE, greatest(0.75::DOUBLE, c)) >= 0.9", ENDS_OF, txt("e"), txt("id"), "FROM r WHERE e IS NOT NULL")
C5 = "least(0.9::DOUBLE, 0.68::DOUBLE + 0.05::DOUBLE * least(ne, 4) + 0.03::DOUBLE * least(nr, 4))"
B5 = found(5, C5, f"round_even({C5}, 3) >= 0.85", txt("x"), "ev", "rel", f"FROM (SELECT inv, x, count(DISTINCT e) AS ne, count(DISTINCT id) AS nr, {ids('e')} AS ev, {ids('id')} AS rel FROM ends WHERE e IS NOT NULL GROUP BY inv, x)")
BASE = R + ", " + ", ".join(f"b{i} AS ({sql})" for i, sql in enumerate((B1, B2, B3, B4, B5), 1)) + ", base AS (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, 6)) + """), named AS (SELECT investigation_id AS inv, title, confidence, relationship_ids, evidence_ids, entity_ids, unnest(string_split(entity_ids, ','))::BIGINT AS x FROM base
), high AS (
  SELECT inv, x, count(*) FILTER (confidence >= 0.8) AS h, count(*) AS k, count(DISTINCT title) AS titles,
    list_sort(list_distinct(list_transform(list_filter(flatten(list(string_split(relationship_ids, ',')) FILTER (confidence >= 0.8)), lambda v : v <> ''), lambda v : v::BIGINT))) AS rel_l,
    list_sort(list_distinct(list_transform(list_filter(flatten(list(string_split(evidence_ids, ',')) FILTER (confidence >= 0.8)), lambda v : v <> ''), lambda v : v::BIGINT))) AS ev_l
  FROM named GROUP BY inv, x
), hi AS (SELECT inv, x, h, k, titles, coalesce(array_to_string(rel_l, ','), '') AS rel, coalesce(array_to_string(ev_l, ','), '') AS ev FROM high)"""

SIMPLE = {
    1: (b.b1, B1), 2: (b.b2, B2), 3: (b.b3, B3), 4: (b.b4, B4), 5: (b.b5, B5),
    6: (b.b6, found(6, up(0.6, 0.05, "n", 0.9), "n >= 5", txt("x"), "ev", "rel", f"FROM {BY_X} WHERE n >= 2")),
    7: (b.b7, found(7, up(0.65, 0.08, "k", 0.92), "k >= 3", "a || ',' || b", "ev", "rel", f"FROM (SELECT inv, a, b, count(DISTINCT kind) AS k, {ids('e')} AS ev, {ids('id')} AS rel FROM pairs GROUP BY inv, a, b) WHERE k >= 2")),
    18: (b.b18, found(18, up(0.7, 0.05, "k", 0.91), "k >= 4", txt("x"), "ev", "rel", f"FROM {BY_X} WHERE k >= 2")),
    20: (b.b20, found(20, "0.82", None, "a || ',' || b", "ev", "rel", f"FROM (SELECT inv, a, b, count(DISTINCT s) AS ways, {ids('e')} AS ev, {ids('id')} AS rel FROM pairs GROUP BY inv, a, b) WHERE ways = 2")),
    21: (b.b21, found(21, up(0.72, 0.04, "n", 0.92), "n >= 4", "a || ',' || b", "ev", "rel", f"FROM (SELECT inv, a, b, kind, count(*) AS n, {ids('e')} AS ev, {ids('id')} AS rel FROM pairs GROUP BY inv, a, b, kind) WHERE n >= 2")),
    22: (
        b.b22,
        found(22, "0.84", None, "x.a || ',' || x.b || ',' || y.b", source="FROM e x JOIN e y ON y.inv = x.inv AND y.a = x.b SEMI JOIN e z ON z.inv = x.inv AND z.a = x.a AND z.b = y.b")
        .replace("SELECT inv AS", ", e AS MATERIALIZED (SELECT DISTINCT inv, a, b FROM pairs) SELECT x.inv AS"),
    ),
    24: (
        b.b24,
        found(24, "0.83", None, "CASE WHEN p.m < p.o THEN p.m || ',' || p.o || ',' || q.o WHEN p.m < q.o THEN p.o || ',' || p.m || ',' || q.o ELSE p.o || ',' || q.o || ',' || p.m END", source="FROM legs p JOIN legs q ON q.inv = p.inv AND q.m = p.m AND p.o < q.o WHERE p.n > 1 OR q.n > 1 OR p.kind <> q.kind")
        .replace("SELECT inv AS", ", legs AS MATERIALIZED (SELECT inv, m, o, count(DISTINCT kind) AS n, min(kind) AS kind FROM (SELECT inv, a AS m, b AS o, kind FROM pairs UNION ALL SELECT inv, b, a, kind FROM pairs) GROUP BY inv, m, o) SELECT p.inv AS"),
    ),
}


def written(s, d):
    """The valid relationships, written once for queries that read them several times."""
    return g.checkpointed(b.valid(m.finding_relationships(s, d)))


def _simple(rule, f, sql):
    @query(f"b{rule:02d}_findings", f"{R} {sql}")
    def _(s, d):
        return f(b.valid(m.finding_relationships(s, d)))


for _rule, (_f, _sql) in SIMPLE.items():
    _simple(_rule, _f, _sql)


@query("b08_findings", BASE + " " + found(8, up(0.7, 0.05, "h", 0.95), "h >= 3", txt("x"), "ev", "rel", "FROM hi WHERE h >= 2"))
def _(s, d):
    return b.b8(b.high_counts_of(written(s, d)))


@query(
    "b09_findings",
    BASE + """, ev AS (SELECT inv, entity_ids, relationship_ids, unnest(string_split(evidence_ids, ','))::BIGINT AS e FROM (SELECT investigation_id AS inv, * FROM base WHERE evidence_ids <> '')
), evs AS (SELECT inv, e, count(*) AS n, array_to_string(list_sort(list_distinct(list_transform(flatten(list(string_split(entity_ids, ','))), lambda v : v::BIGINT))), ',') AS ent,
  array_to_string(list_sort(list_distinct(list_transform(flatten(list(string_split(relationship_ids, ','))), lambda v : v::BIGINT))), ',') AS rel FROM ev GROUP BY inv, e HAVING count(*) >= 2) """
    + found(9, up(0.7, 0.06, "n", 0.95), "n >= 3", "ent", txt("e"), "rel", "FROM evs"),
)
def _(s, d):
    return b.b9(b.base_findings(m.finding_relationships(s, d)))


@query("b10_findings", BASE + " " + found(10, up(0.72, 0.04, "coalesce(k, 0)", 0.92), "coalesce(k, 0) >= 3", txt("x"), source="FROM central LEFT JOIN hi USING (inv, x)"))
def _(s, d):
    r = written(s, d)
    return b.b10(b.central_entities(r), b.high_counts_of(r))


#: Components by rounds of smallest labels: enough rounds for the graphs of these investigations, whose nodes are a few steps apart.
_ROUNDS = 12
COMP = (
    ", l0 AS MATERIALIZED (SELECT DISTINCT inv, x, x AS l FROM ends)"
    + "".join(f", l{k + 1} AS MATERIALIZED (SELECT p.inv, p.x, least(min(p.l), coalesce(min(q.l), min(p.l))) AS l FROM l{k} p LEFT JOIN nb n ON n.inv = p.inv AND n.x = p.x LEFT JOIN l{k} q ON q.inv = n.inv AND q.x = n.y GROUP BY p.inv, p.x)" for k in range(_ROUNDS))
    + f", comp AS MATERIALIZED (SELECT inv, x, l AS component, count(*) OVER (PARTITION BY inv, l) AS size FROM l{_ROUNDS})"
)


@query("b11_findings", R + COMP + " " + found(11, up(0.65, 0.04, "n", 0.9), "n >= 5", "ent", source=f"FROM (SELECT inv, component, count(*) AS n, {ids('x')} AS ent FROM comp WHERE size >= 3 GROUP BY inv, component)"))
def _(s, d):
    return b.b11(b.components(b.valid(m.finding_relationships(s, d))))


DENS = f"(SELECT n.inv, nodes, edges, 2 * edges / nodes AS d, ent FROM (SELECT inv, count(DISTINCT x) AS nodes, {ids('x')} AS ent FROM ends GROUP BY inv) n JOIN (SELECT inv, count(*) AS edges FROM r GROUP BY inv) e USING (inv))"


@query("b12_findings", f"{R} " + found(12, up(0.68, 0.05, "d", 0.92), "d >= 3", "ent", source=f"FROM {DENS} WHERE nodes >= 3 AND edges >= 2 AND d >= 1.5"))
def _(s, d):
    return b.b12(b.density(b.valid(m.finding_relationships(s, d))))


WALK = """, w1 AS (SELECT inv, x AS a, y AS b, [x, y] AS path FROM nb
), w2 AS (SELECT w.inv, a, n.y AS b, min(list_append(path, n.y)) AS path FROM w1 w JOIN nb n ON n.inv = w.inv AND n.x = w.b WHERE n.y <> a AND NOT EXISTS (FROM nb z WHERE z.inv = w.inv AND z.x = w.a AND z.y = n.y) GROUP BY w.inv, a, n.y
), r2 AS (SELECT inv, a, b FROM w1 UNION SELECT inv, a, b FROM w2
), w3 AS (SELECT w.inv, w.a, n.y AS b, min(list_append(path, n.y)) AS path FROM w2 w JOIN nb n ON n.inv = w.inv AND n.x = w.b WHERE n.y <> w.a AND NOT EXISTS (FROM r2 z WHERE z.inv = w.inv AND z.a = w.a AND z.b = n.y) GROUP BY w.inv, w.a, n.y
), r3 AS (SELECT * FROM r2 UNION SELECT inv, a, b FROM w3
), w4 AS (SELECT w.inv, w.a, n.y AS b, min(list_append(path, n.y)) AS path FROM w3 w JOIN nb n ON n.inv = w.inv AND n.x = w.b WHERE n.y <> w.a AND NOT EXISTS (FROM r3 z WHERE z.inv = w.inv AND z.a = w.a AND z.b = n.y) GROUP BY w.inv, w.a, n.y
), far AS (SELECT inv, a, b, path, len(path) - 1 AS distance, array_to_string(list_sort(path), ',') AS ent FROM (SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4) WHERE a < b)"""


@query("b13_findings", R + WALK + " " + found(13, up(0.6, 0.05, "distance - 1", 0.85), "distance - 1 >= 3", "ent", source="FROM far"))
def _(s, d):
    return b.b13(b.indirect_paths(b.valid(m.finding_relationships(s, d))))


@query("b14_findings", BASE + " " + found(14, up(0.76, 0.04, "h", 0.94), "h >= 3", txt("x"), "ev", "rel", "FROM central JOIN hi USING (inv, x) WHERE h >= 2"))
def _(s, d):
    r = written(s, d)
    return b.b14(b.central_entities(r), b.high_counts_of(r))


C15 = "least(0.95::DOUBLE, 0.76::DOUBLE + 0.03::DOUBLE * h + 0.02::DOUBLE * n + 0.01::DOUBLE * size)"


@query(
    "b15_findings",
    BASE + COMP + ", hub AS (SELECT inv, x, count(DISTINCT id) AS n FROM ends GROUP BY inv, x) "
    + found(15, C15, f"round_even({C15}, 3) >= 0.9", txt("x"), "ev", "rel", "FROM central JOIN hi USING (inv, x) JOIN hub USING (inv, x) JOIN comp USING (inv, x) WHERE h >= 2 AND n >= 2 AND size >= 3"),
)
def _(s, d):
    r = written(s, d)
    return b.b15(b.central_entities(r), b.high_counts_of(r), r, b.components(r))


@query(
    "b16_findings",
    R + ", hub AS (SELECT inv, x, count(*) AS d, array_to_string(list_sort(list_append(list(y), x)), ',') AS ent FROM nb JOIN central USING (inv, x) GROUP BY inv, x HAVING count(*) >= 3) "
    + found(16, up(0.72, 0.04, "d", 0.93), "d >= 5", "ent", source="FROM hub"),
)
def _(s, d):
    r = b.valid(m.finding_relationships(s, d))
    return b.b16(b.central_entities(r), r)


@query(
    "b17_findings",
    BASE + WALK + """, hot AS (SELECT DISTINCT inv, x, title, entity_ids, evidence_ids, relationship_ids FROM named WHERE confidence >= 0.8
), steps AS (SELECT inv, a, b, distance, ent, unnest(path) AS x FROM far
), on_path AS (SELECT inv, a, b, distance, ent, count(DISTINCT (title, entity_ids, evidence_ids, relationship_ids)) AS h FROM steps JOIN hot USING (inv, x) GROUP BY ALL) """
    + found(17, "least(0.92::DOUBLE, 0.68::DOUBLE + 0.04::DOUBLE * distance + 0.04::DOUBLE * h)", "h >= 2", "ent", source="FROM on_path"),
)
def _(s, d):
    r = written(s, d)
    return b.b17(b.reinforced_paths(r, b.base_of(r)))


@query(
    "b19_findings",
    BASE + COMP + f""", hot AS (SELECT DISTINCT inv, x, title, entity_ids, evidence_ids, relationship_ids FROM named WHERE confidence >= 0.8
), members AS (SELECT * FROM comp SEMI JOIN (SELECT inv, component FROM comp JOIN central USING (inv, x) WHERE size >= 3) USING (inv, component)
), clusters AS (SELECT inv, component, any_value(size) AS n, {ids('x')} AS ent, count(DISTINCT (title, entity_ids, evidence_ids, relationship_ids)) FILTER (title IS NOT NULL) AS h FROM members LEFT JOIN hot USING (inv, x) GROUP BY inv, component) """
    + found(19, "least(0.94::DOUBLE, 0.72::DOUBLE + 0.025::DOUBLE * n + 0.03::DOUBLE * h)", "h >= 3", "ent", source="FROM clusters"),
)
def _(s, d):
    r = written(s, d)
    return b.b19(b.components(r), b.central_entities(r), b.base_of(r))


@query("b23_findings")
def _(s, d):
    r = written(s, d)
    return b.b23(r, b.components(r))


@query(
    "b24_middles",
    R + """, sets AS (SELECT inv, m, kinds, count(*) AS n FROM (SELECT inv, m, o, list_sort(list(DISTINCT kind)) AS kinds FROM (SELECT inv, a AS m, b AS o, kind FROM pairs UNION ALL SELECT inv, b, a, kind FROM pairs) GROUP BY inv, m, o) GROUP BY inv, m, kinds
) SELECT inv AS investigation_id, m, sum(n)::BIGINT AS legs, count(*) AS kind_sets, ((sum(n) * (sum(n) - 1) - sum(CASE WHEN len(kinds) = 1 THEN n * (n - 1) ELSE 0 END)) // 2)::BIGINT AS wedges FROM sets GROUP BY inv, m HAVING wedges > 0""",
)
def _(s, d):
    return b.typed_middles(b.typed_legs(b.valid(m.finding_relationships(s, d))))


@query(
    "b25_findings",
    BASE + """, sig AS (SELECT c.inv, c.x, coalesce(hi.k, 0) AS k, coalesce(ev, '') AS ev, coalesce(rel, '') AS rel, (coalesce(d.d, 0) >= 2)::INT + (coalesce(h, 0) >= 2)::INT + (coalesce(t.types, 0) >= 2)::INT + (coalesce(titles, 0) >= 2)::INT AS s
  FROM central c LEFT JOIN hi ON hi.inv = c.inv AND hi.x = c.x LEFT JOIN (SELECT inv, x, count(*) AS d FROM nb GROUP BY inv, x) d ON d.inv = c.inv AND d.x = c.x LEFT JOIN (SELECT inv, x, count(DISTINCT kind) AS types FROM ends GROUP BY inv, x) t ON t.inv = c.inv AND t.x = c.x) """
    + found(25, "least(0.96::DOUBLE, 0.8::DOUBLE + 0.025::DOUBLE * s + 0.01::DOUBLE * k)", "s >= 4", txt("x"), "ev", "rel", "FROM sig WHERE s >= 3"),
)
def _(s, d):
    r = written(s, d)
    return b.b25(b.central_entities(r), b.high_counts_of(r), r)


@query("b26_all_findings")
def _(s, d):
    return b.all_findings(m.finding_relationships(s, d))


@query(
    "b27_investigation_results",
    BASE + COMP + f""", t AS (SELECT inv, string_agg(kind || ':' || n, ',' ORDER BY kind) AS type_counts FROM (SELECT inv, kind, count(*) AS n FROM r GROUP BY inv, kind) GROUP BY inv
), c AS (SELECT inv, count(DISTINCT component) AS components FROM comp GROUP BY inv
), f AS (SELECT investigation_id AS inv, count(*) AS findings, count(*) FILTER (severity = 'high') AS high FROM base GROUP BY investigation_id
), o AS (SELECT inv, {ids('x')} AS central_ids FROM central GROUP BY inv)
SELECT inv AS investigation_id, coalesce(findings, 0) AS findings, coalesce(high, 0) AS high, nodes, edges, round_even(d, 3) AS average_degree, type_counts, coalesce(central_ids, '') AS central_ids, components,
  coalesce(findings, 0) || ' findings over ' || nodes || ' entities and ' || edges || ' relationships.' AS summary
FROM {DENS} JOIN t USING (inv) JOIN c USING (inv) LEFT JOIN f USING (inv) LEFT JOIN o USING (inv)""",
)
def _(s, d):
    r = m.finding_relationships(s, d)
    return b.investigation_results(r, g.checkpointed(b.base_findings(r)))


@query("k07_finding_risk")
def _(s, d):
    return k.finding_risk(b.base_findings(m.finding_relationships(s, d)))


FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{'|'.join(w)}') THEN '{n}'" for n, w in k.FAMILIES.items()) + " ELSE 'other' END"


@query("k09_finding_families", BASE + f" SELECT title, {FAMILY} AS family, severity, CASE severity WHEN 'high' THEN 0.75 ELSE 0.5 END::DOUBLE AS weight, count(*) AS n FROM base GROUP BY ALL")
def _(s, d):
    f = b.base_findings(m.finding_relationships(s, d))
    return f.groupBy("title", k.family(F.col("title")).alias("family"), "severity", k.severity_weight(F.col("severity")).alias("weight")).agg(F.count("*").alias("n"))


@query("k10_severity_bands", R + " SELECT inv AS investigation_id, id, CASE WHEN c > 0.9 THEN 'critical' WHEN c >= 0.65 THEN 'high' WHEN c >= 0.35 THEN 'medium' ELSE 'low' END AS severity FROM r")
def _(s, d):
    return b.valid(m.finding_relationships(s, d)).select(INV, "id", k.severity_band(F.col("c")).alias("severity"))


@query(
    "k11_confidence",
    BASE + """, parts AS (
  SELECT inv, 'entity' AS part, avg(c) AS m FROM (SELECT inv, x, max(c) AS c FROM ends GROUP BY inv, x) GROUP BY inv UNION ALL SELECT inv, 'relationship', avg(c) FROM r GROUP BY inv
  UNION ALL SELECT inv, 'evidence', coalesce(avg(CASE WHEN id % 7 > 0 THEN c END), 0.6) FROM r WHERE e IS NOT NULL GROUP BY inv UNION ALL SELECT investigation_id, 'finding', avg(confidence) FROM base GROUP BY investigation_id
), w AS (SELECT inv, coalesce(max(m) FILTER (part = 'entity'), 0) AS entity, coalesce(max(m) FILTER (part = 'relationship'), 0) AS relationship, coalesce(max(m) FILTER (part = 'evidence'), 0) AS evidence, coalesce(max(m) FILTER (part = 'finding'), 0) AS finding FROM parts GROUP BY inv)
SELECT inv AS investigation_id, """ + ", ".join(f"round_even(round({c}, 10) * 1000, 0) / 1000 AS {c}" for c in ("entity", "relationship", "evidence", "finding")) + """,
  round_even(round(0.2::DOUBLE * entity + 0.3::DOUBLE * relationship + 0.2::DOUBLE * evidence + 0.3::DOUBLE * finding, 10) * 1000, 0) / 1000 AS overall FROM w""",
)
def _(s, d):
    own = written(s, d)
    r = own.withColumnRenamed("c", "confidence")
    entities = b.ends(r).groupBy(INV, "x").agg(F.max("confidence").alias("confidence"))
    evidence = r.where("e is not null").select(INV, F.when(F.col("id") % 7 > 0, F.col("confidence").cast("string")).otherwise("unknown").alias("confidence"))
    return k.confidence_components(entities, r, evidence, b.base_of(own))
