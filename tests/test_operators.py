"""Literal cases of the case-data operators, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib
import json
import re

import oracle
import pytest
from pyspark.sql import functions as F

from casegraph.functions import normalize as n
from casegraph.operators import findings as b
from casegraph.operators import graph as g
from casegraph.operators import resolve as r
from casegraph.operators import risk as k
from casegraph.operators import text as t
from casegraph.plans import ORACLE_SQL, QUERIES, adapters
from casegraph.sources import readers, records
from casegraph.streaming import ingest

DIR = "/root/testdata/sf0.001"
LONG = {"b13_findings", "b17_findings"}  # minutes; compared at a larger scale before a release


@pytest.mark.parametrize("name", [q for q in ORACLE_SQL if q not in LONG])
def test_sql(spark, name):
    rows = oracle.same(spark, DIR, QUERIES[name], ORACLE_SQL[name])
    assert rows or name[0] not in "bk"  # every rule finds a case


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (n.normalize_phone, "+91 98765-43210", "+919876543210"), (n.normalize_phone, "n/a", None), (n.normalize_registration, "dl 01-ab 1234", "DL01AB1234"), (n.parse_amount, "Rs 1,250.50", 1250.5),
        (n.parse_amount, "Rs. 1,250.50", None), (n.parse_duration_seconds, "1:02:03", 3723.0), (n.parse_duration_seconds, "2:05", 125.0), (n.parse_duration_seconds, "90 sec", 90.0), (n.normalize_bearing, "-30", 330.0),
        (n.normalize_text, "  a \n b ", "a b"), (n.normalize_text, " ", None), (n.normalize_handle, "@@ann", "ann"), (n.normalize_company_tokens, "Apex Pvt. Ltd", "apex private limited"), (n.sanitize_relation_type, "works-for x", "WORKS_FOR_X"),
        (n.sanitize_relation_type, "1x", None), (n.map_relationship_type, "Travelled_To", "traveled_to"), (n.map_relationship_type, None, "other"), (n.parse_count, "12.7", 12), (n.parse_count, "x", None),
    ],
)
def test_normalisation(spark, f, value, expected):
    assert one(spark, f(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize(("value", "expected"), [("03/04/2024", "2024-04-03 00:00:00"), ("12/25/2024", "2024-12-25 00:00:00"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("5-6-2024 7:08", "2024-06-05 07:08:00"), ("soon", None), (None, None)])
def test_dates(spark, value, expected):
    assert one(spark, n.parse_datetime_multi(F.lit(value).cast("string")).cast("string")) == expected


def test_column_names_and_collisions(spark):
    assert n.canonical_name(" Calling-Number ") == "caller_phone"
    df = spark.createDataFrame([("", "2", "3"), ("1", None, "")], "`Phone` string, mobile string, `tele phone` string")
    assert n.canonical_columns(df.withColumnRenamed("tele phone", "telephone")).collect() == [("2", "3"), ("1", None)]


def rel(spark, rows):
    """rows: (source, target, type[, confidence[, evidence]]) of investigation 1."""
    return spark.createDataFrame([(1, i, *(*x, *(None,) * (5 - len(x)))) for i, x in enumerate(rows, 10)], "investigation_id long, id long, source_entity_id long, target_entity_id long, relationship_type string, confidence double, evidence_id long")


@pytest.mark.parametrize(
    ("rows", "has", "lacks"),
    [
        ([(1, 2, "knows", 0.9), (2, 3, "knows"), (3, 1, "knows")], "Closed triadic graph pattern", "Reciprocal relationship pattern"),
        ([(1, 2, "knows", 0.9), (2, 1, "knows")], "Reciprocal relationship pattern", "Closed triadic graph pattern"),
        ([(1, i, "knows", 0.9) for i in range(2, 6)], "Hub-and-spoke graph pattern", "Typed multi-hop graph pattern"),
        ([(1, 2, "knows", 0.9), (2, 3, "works_for")], "Typed multi-hop graph pattern", "Hub-and-spoke graph pattern"),
        ([(i, i + 1, "knows", 0.9) for i in range(1, 4)], "Bridge entity detected", "Closed triadic graph pattern"),
        ([(1, 2, "knows", 0.5), (1, 2, "knows", 0.5)], "Repeated relationship detected", "High-confidence relationship"),
        ([(1, 1, "knows", 0.9)], "High-confidence relationship", "Bridge entity detected"),
    ],
)
def test_finding_titles(spark, rows, has, lacks):
    titles = {x.title for x in b.all_findings(rel(spark, rows)).collect()}
    assert has in titles and lacks not in titles


def test_findings_of_odd_rows(spark):
    assert b.all_findings(rel(spark, [])).count() == 0
    assert b.all_findings(rel(spark, [(1, 2, None, 0.9), (None, 2, "knows", 0.9), (1, 2, " ", 0.9)])).count() == 0
    far = b.indirect_paths(b.valid(rel(spark, [(i, i + 1, "knows", 0.9) for i in range(1, 7)]))).collect()
    assert max(x.distance for x in far) == 4 and {tuple(x.path) for x in far if x.a == 1} == {(1, 2, 3), (1, 2, 3, 4), (1, 2, 3, 4, 5)}


def test_articulation_points_brute_force(spark):
    import itertools
    import random

    def parts(nodes, edges):
        label = {x: x for x in nodes}
        for _ in nodes:
            for a, c in edges:
                if a in label and c in label:
                    label[a] = label[c] = min(label[a], label[c])
        return len(set(label.values()))

    rand, rows, expected = random.Random(2), [], set()
    for i in range(40):
        edges = rand.sample(list(itertools.combinations(range(9), 2)), 6 + i % 8)
        used = {x for e in edges for x in e}
        rows += [(i, 100 * i + k, a, c, "knows", 0.5, None) for k, (a, c) in enumerate(edges)]
        expected |= {(i, x) for x in used if parts(used - {x}, edges) > parts(used, edges)}
    rows += [(50, 9000 + i, i, i + 1, "knows", 0.5, None) for i in range(30)] + [(51, 9100, 1, 1, "knows", 0.5, None)]
    expected |= {(50, i) for i in range(1, 30)}
    r = b.valid(spark.createDataFrame(rows, "investigation_id long, id long, source_entity_id long, target_entity_id long, relationship_type string, confidence double, evidence_id long"))
    for levels in (30, 5, 0):  # ways to the root, or doubling where the graph is deeper
        assert {(x.investigation_id, x.x) for x in b.articulation_points(r, b.components(r), levels).collect()} == expected


def test_graph_searches_brute_force(spark):
    import random

    from casegraph.operators import analytics as an

    rand = random.Random(4)
    edges = {(rand.randrange(40), rand.randrange(40)) for _ in range(45)}
    near = {i: {b for a, b in edges if a == i and b != i} | {a for a, b in edges if b == i and a != i} for i in range(40)}
    df = spark.createDataFrame([(a, b, "knows", 0.5) for a, b in edges], "src long, dst long, rel_type string, confidence double")
    nodes = spark.createDataFrame([(i, "person", f"v{i}") for i in range(40)], "node_id long, entity_type string, value string")

    def shortest(a, b, depth):
        paths = [[a]]
        for _ in range(depth + 1):
            hit = [p for p in paths if p[-1] == b]
            if hit:
                return min(hit)
            paths = [[*p, y] for p in paths for y in near[p[-1]] if y not in p]
        return None

    pairs = [(a, b) for a in range(12) for b in range(0, 40, 3)]
    found = {(x.source, x.target): x.path for x in g.shortest_paths(spark.createDataFrame(pairs, "source long, target long"), df, 5).collect()}
    assert found == {p: shortest(*p, 5) for p in pairs if shortest(*p, 5)}
    two = {i: len((near[i] | {z for y in near[i] for z in near[y]}) - {i}) for i in range(40)}
    expected = {i: round(1 / n, 4) for i, n in two.items() if n}
    for most in (1, 3, 1000):  # many parts, or one
        assert {x.node_id: x.density for x in k.neighbourhood_density(nodes, df, most).collect()} == expected
    keys = [(i, f"k{j}") for i in range(30) for j in rand.sample(range(12), rand.randint(1, 6))] + [(i, "all") for i in range(30)]
    sets = {i: {key for n, key in keys if n == i} for i in range(30)}
    score = lambda a, b: round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4)
    for threshold in (0.0, 0.25, 0.5, 1.0):
        got = {(x.a, x.b): x.score for x in an.jaccard(spark.createDataFrame(keys, "node long, key string"), threshold=threshold).collect()}
        assert got == {(a, b): score(a, b) for a in range(30) for b in range(a + 1, 30) if score(a, b) >= threshold}


def finding(spark, rows):
    schema = "investigation_id long, rule int, title string, severity string, confidence double, entity_ids array<long>, evidence_ids array<long>, relationship_ids array<long>"
    return spark.createDataFrame([(1, i, *x) for i, x in enumerate(rows)], schema)


@pytest.mark.parametrize(
    ("rows", "score", "severity"),
    [
        ([("A", "medium", 0.8, [1], [], [])], 0.8, "high"), ([("A", "critical", 0.95, [1], [], [])], 0.95, "critical"), ([("A", "low", 0.2, [1], [], [])], 0.2, "low"),
        ([("A", "high", 0.9, [1], [], []), ("B", "low", 0.2, [1], [], [])], 0.725, "high"),
        ([("A", "high", 0.9, [1], [], [7]), ("B", "low", 0.2, [1], [], [7])], 0.9, "high"),  # one relationship, one signal
        ([("A", "high", 0.9, [1], [], [7]), ("B", "high", 0.5, [1], [], [7, 8]), ("C", "high", 0.3, [1], [], [8])], 0.9, "high"),  # group 8 shares B with group 7
        ([("A", "high", 0.9, [1], [5], []), ("B", "high", 0.5, [1], [5, 6], []), ("C", "high", 0.3, [1], [6], [])], 0.68, "high"),  # C stays a signal of its own, two evidence ids
        ([("A", "high", 0.0, [1], [], []), ("B", "low", 0.2, [1], [], [])], 0.2, "low"),
    ],
)
def test_finding_risk(spark, rows, score, severity):
    got = k.finding_risk(finding(spark, rows)).first()
    assert (got.score, got.severity) == (score, severity)


def test_confidence_parts(spark):
    part = lambda *v: spark.createDataFrame([(1, x) for x in v], "investigation_id long, confidence string")
    got = k.confidence_components(part("0.8"), part("0.6"), part("0.7"), part("0.9")).first()
    assert tuple(got)[1:] == (0.8, 0.6, 0.7, 0.9, 0.75)
    got = k.confidence_components(part("x", "1.6"), part("0.6"), part("x"), part("0.9")).first()
    assert (got.entity, got.evidence) == (0.5, 0.6)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Arjun Rao met with representatives from Apex Logistics Pvt Ltd.", {("PERSON", "Arjun Rao"), ("ORGANIZATION", "Apex Logistics Pvt Ltd")}),
        ("primary line at +91 98765 43210 today", {("PHONE", "+91 98765 43210")}),
        ("Referencing Case Number: CASE-2024-009 linked to FIR-402/2024.", {("CASE", "CASE-2024-009")}),
        ("IPC 420, Section 120B IPC and BNS Section 316.", {("PENAL_SECTION", "IPC 420"), ("PENAL_SECTION", "Section 120B IPC"), ("PENAL_SECTION", "BNS Section 316")}),
        ("plate DL 01 AB 1234 and truck MH-12-CD-5678.", {("VEHICLE", "DL 01 AB 1234"), ("VEHICLE", "MH-12-CD-5678")}),
        ("seen near 28.61, 77.20", {("GPS_COORDINATE", "28.61,77.2")}),
    ],
)
def test_mentions(text, expected):
    found = t._spans(text)
    assert expected <= {(x[0], x[1]) for x in found}
    assert t._spans(None) == [] and all(x[2] < x[3] for x in found)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Aarav Sharma is known to Meera Rao.", ("KNOWS", "Aarav Sharma", "Meera Rao")), ("Aarav Sharma works for Vertex Trading Pvt Ltd.", ("WORKS_FOR", "Aarav Sharma", "Vertex Trading Pvt Ltd")),
        ("Aarav Sharma contacted HDFC Bank.", ("CONTACTED", "Aarav Sharma", "HDFC Bank")), ("Vertex Trading Pvt Ltd transferred funds to HDFC Bank.", ("TRANSFERRED_TO", "Vertex Trading Pvt Ltd", "HDFC Bank")),
        ("Vikram Malhotra was identified as an accomplice of Rajesh Verma in the robbery.", ("ACCOMPLICE_OF", "Vikram Malhotra", "Rajesh Verma")),
        ("Arjun Rao conspired with Kabir Khan during the procurement breach.", ("ACCOMPLICE_OF", "Arjun Rao", "Kabir Khan")), ("Suresh Raina was named as a co-conspirator of Dinesh Karthik.", ("ACCOMPLICE_OF", "Suresh Raina", "Dinesh Karthik")),
    ],
)
def test_relations(spark, text, expected):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = t.relations(docs, t.mentions(docs)).collect()
    assert expected in {(x.relation_type, x.source_value, x.target_value) for x in found}


def test_components_and_paths(spark):
    nodes = spark.createDataFrame([(i, "person", f"v{i}") for i in range(8)], "node_id long, entity_type string, value string")
    edges = spark.createDataFrame([(0, 1, "a", 1.0), (1, 2, "b", 1.0), (4, 3, "a", 1.0), (5, 5, "a", 1.0), (1, 2, "c", 1.0)], "src long, dst long, rel_type string, confidence double")
    found = {x.node_id: x.component for x in g.components(nodes, edges).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}
    pairs = spark.createDataFrame([(0, 2), (2, 0), (0, 4), (6, 6)], "source long, target long")
    got = {(x.source, x.target): (x.distance, x.path) for x in g.shortest_paths(pairs, edges, 4).collect()}
    assert got == {(0, 2): (2, [0, 1, 2]), (2, 0): (2, [2, 1, 0]), (6, 6): (0, [6])}
    assert {x.node_id: x.total_degree for x in g.degrees(nodes, edges).collect()}[5] == 2
    assert g.components(nodes, edges.limit(0)).where("component <> node_id").count() == 0


def test_fuzzy_and_gazetteer(spark):
    new = spark.createDataFrame([(1, "organization", "Apex Logistcs Pvt Ltd"), (2, "organization", "Quux Ltd"), (3, "person", "Arjun Roa")], "new_id long, entity_type string, name string")
    old = spark.createDataFrame([(7, "organization", "Apex Logistics Private Limited"), (8, "person", "Arjun Rao"), (9, "organization", "Beta Limited")], "existing_id long, entity_type string, name string")
    assert {x.new_id: x.existing_id for x in r.fuzzy_matches(new, old).collect()} == {1: 7, 3: 8}
    known = spark.createDataFrame([(1, "person", "Arjun Rao", ["A. Rao"]), (2, "person", "Arjun Rau", None)], "entity_id long, entity_type string, value string, aliases array<string>")
    ment = spark.createDataFrame([(1, "person", "arjun rao"), (2, "PERSON", "Arjun  Ra0x"), (3, "person", "a rao")], "mention_id long, entity_type string, value string")
    got = {x.mention_id: (x.entity_id, x.score, x.ambiguous) for x in r.linked(r.gazetteer_matches(ment, known)).collect()}
    assert got[1][:2] == (1, 0.98) and got[3][:2] == (1, 0.96)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ Name ,Phone\n Ann , \n\"x\ny\",1\n", encoding="utf-8")
    assert readers.read_csv_records(spark, str(tmp_path / "a.csv")).collect() == [("Ann", None), ("x\ny", "1")]
    for i, body in enumerate(([{"a": " 1 "}, {"a": ""}], {"records": [{"a": " 1 "}, {"a": ""}]})):
        (tmp_path / f"{i}.json").write_text(json.dumps(body))
        assert [x.a for x in readers.read_json_records(spark, str(tmp_path / f"{i}.json")).collect()] == ["1", None]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert readers.read_text_documents(spark, str(tmp_path / "t.txt")).select("text", "n_chars", "n_lines").first() == ("one\ntwo", 7, 2)
    got = readers.file_registry(spark, str(tmp_path / "t.txt")).first()
    assert (got["size"], got.sha256, got.mime) == (7, hashlib.sha256(b"one\ntwo").hexdigest(), "text/plain")
    readers.write_reports(spark.createDataFrame([(1, ["a"])], "id long, x array<string>"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().x == ["a"]


def test_entity_risk_rounds_contributions_first(spark):
    names = list(k.WEIGHTS)
    values = [[i / 9999 % 1, i % 7 / 6, i % 6 / 5, i % 5 / 4, i % 3 / 2, 1 / (1 + i)] for i in range(400)] + [[0.0] * 5 + [0.0009], [0.0] * 5 + [0.001], [0.0002] * 6, [0.0] * 6]
    rows = spark.createDataFrame([(i, "person", *v) for i, v in enumerate(values)], ", ".join(["node_id long, entity_type string", *(f"{n} double" for n in names)]))
    table = {(r.node_id, r.signal): (r.value, r.contribution) for r in k.signal_table(rows).collect()}
    for r in k.entity_risk(rows).collect():
        parts = {n: round(v * k.WEIGHTS[n], 4) for n, v in zip(names, values[r.node_id])}
        assert {n: table[r.node_id, n] for n in names} == {n: (round(v, 4), parts[n]) for n, v in zip(names, values[r.node_id])}
        assert r.score == round(sum(parts.values()) / sum(k.WEIGHTS.values()), 4)
        active = [n for n, v in zip(names, values[r.node_id]) if round(v, 4) > 0]
        assert r.top_signals == sorted(active, key=lambda n: -parts[n])[:3]


def test_merge_and_empty_records(spark):
    old = spark.createDataFrame([("a", "x", "b", 0.1), ("a", "x", "c", 0.2)], "src string, rel_type string, dst string, confidence double")
    new = spark.createDataFrame([("a", "x", "b", 0.9)], old.schema)
    assert sorted(map(tuple, readers.merge_edges(old, new).collect())) == [("a", "x", "b", 0.9), ("a", "x", "c", 0.2)]
    for source in records.SOURCES:
        empty = records.typed(spark.createDataFrame([], "unknown string"), source)
        assert empty.count() == 0 and set(records.SOURCES[source].fields) <= set(empty.columns)


def test_streamed_calls(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "caller string, callee string, call_date string, call_length string"
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"caller": "+91 1", "callee": f"2{i}", "call_date": "2024-01-01 10:00", "call_length": "1:00"}))
        q = ingest.merge_edges_stream(ingest.read_records(spark, str(tmp_path / "in"), schema), "cdr", str(tmp_path / "edges"), str(tmp_path / "check"))
        q.awaitTermination(120)
    assert {x.dst for x in spark.read.parquet(str(tmp_path / "edges/v1")).collect()} == {"20", "21"}


def plain_relations(text, found):
    """(relation, source, target) -> confidence of one text; found: (start, type, value, normalised value), sorted."""
    out = {}

    def add(relation, s, x, confidence):
        key = (relation, s[3], x[3])
        out[key] = max(confidence, out.get(key, 0))

    def ruled(s, x, context):
        return next(((relation, c) for a, z, family, relation, c in t.PAIR_RULES if (a, z) == (s[1], x[1]) and (family is None or any(w in context for w in t.CUES[family]))), None)

    for s in found:
        for x in found:
            if s is not x and (hit := ruled(s, x, text[max(0, min(s[0], x[0]) - 120) : max(s[0], x[0]) + 120].lower())):
                add(hit[0], s, x, hit[1])
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        low = sentence.lower()
        inside = [(*f, low.index(f[2].lower())) for f in found if f[2].lower() in low]
        family = next((name for name in ("knows", "accomplice", "works_for", "transferred_to", "contacted", "association") if any(w in low for w in t.CUES[name])), None)
        if len(inside) < 2:
            continue
        if family in ("transferred_to", "association"):
            words = r"\b(?:transferred\s+funds?\s+to|transferred\s+to|transfer\s+to|sent\s+funds?\s+to)\b" if family == "transferred_to" else "|".join(sorted(t.CUES["association"], key=len, reverse=True))
            cue = re.search(words, low)
            left = [f for f in inside if cue and f[4] < cue.start()]
            right = [f for f in inside if cue and f[4] >= cue.end()]
            if left and right:
                s, x = max(left, key=lambda f: (f[4], f[:4])), min(right, key=lambda f: (f[4], f[:4]))
                if family == "association":
                    add("ASSOCIATED_WITH", s, x, 0.78)
                elif s[1] in ("PERSON", "ORGANIZATION", "COMPANY") and x[1] in ("PERSON", "ORGANIZATION", "COMPANY", "BANK", "ACCOUNT", "TRANSACTION"):
                    add("TRANSFERRED_TO", s, x, 0.9)
            continue
        for i, s in enumerate(inside):
            for x in inside[i + 1 :]:
                persons = s[1] == x[1] == "PERSON"
                if family == "knows" and persons:
                    add("KNOWS", s, x, 0.9)
                elif family == "accomplice" and persons:
                    add("ACCOMPLICE_OF", s, x, 0.92)
                elif family == "works_for" and s[1] == "PERSON" and x[1] in ("ORGANIZATION", "COMPANY"):
                    add("WORKS_FOR", s, x, 0.9)
                elif family == "contacted":
                    add("KNOWS" if persons else "CONTACTED", s, x, 0.82)
                elif family is None:
                    add(*(hit[0], s, x, hit[1]) if (hit := ruled(s, x, low)) else ("MENTIONED_WITH", s, x, 0.45))
    return out


def test_relations_brute_force(spark):
    odd = [
        "Arjun Rao is linked to Meera Khan and is associated with Apex Logistics Pvt Ltd! HDFC Bank sent funds to Vertex Trading Pvt Ltd", "Kabir Das conspired with Anita Nair. Exhibit EV-17 was seized from Kabir Das under FIR-9/2024 in CASE-7.",
        "linked to Meera Khan, Arjun Rao", "Priya Iyer, Rohan Gupta and DL 01 AB 1234 owned by Priya Iyer near IMEI-99 ... called +91 98765 43210?", "", "   ", "no names here.", None, "Arjun Rao " * 300 + "knows Meera Khan",
        "Transferred to Arjun Rao. Arjun Rao transferred to.", "Suresh Raina phone +91 98765 00001 " + "x " * 80 + "+91 98765 00002 Dinesh Nair",
    ]
    docs = adapters.case_texts(spark, DIR).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, -len(odd))), "doc_id long, text string"))
    found = t.mentions(docs)
    by_doc = {}
    for x in found.collect():
        by_doc.setdefault(x.doc_id, []).append((x.start, x.entity_type, x.value, x.normalized_value))
    texts = dict(docs.collect())
    expected = {(d, *k, c) for d, f in by_doc.items() for k, c in plain_relations(texts[d], sorted(f)).items()}
    got = [(x.doc_id, x.relation_type, x.source_normalized, x.target_normalized, x.confidence) for x in t.relations(docs, found).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {k[1] for k in got} >= {"KNOWS", "ACCOMPLICE_OF", "WORKS_FOR", "TRANSFERRED_TO", "CONTACTED", "ASSOCIATED_WITH", "MENTIONED_WITH", "PERSON_USED_PHONE", "PERSON_OWNS_VEHICLE", "EVIDENCE_RELATED_CASE", "CASE_RELATED_FIR"}
