"""The model tables (cases, entities, relationships, investigations) as views of the order and event tables.

Ids are an offset of the entity type plus the table's key. MODEL_SQL states the same views in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BILLION = 1_000_000_000
OFFSET = {"person": 1, "organization": 2, "location": 3, "case": 4, "device": 5, "phone": 6, "vehicle": 7}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key) -> object:
    return (F.lit(OFFSET[kind] * BILLION) + key).cast("long")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity_type, value, normalized_value)"""
    t = lambda name: read(spark, sf_dir, name)
    person, phone, vehicle = F.col("c_custkey"), F.floor(F.col("c_custkey") / 3), F.floor(F.col("c_custkey") / 2)
    parts = [
        t("customer").select(_id("person", person).alias("id"), F.lit("person").alias("entity_type"), F.col("c_name").alias("value")),
        t("supplier").select(_id("organization", F.col("s_suppkey")), F.lit("organization"), F.col("s_name")),
        t("nation").select(_id("location", F.col("n_nationkey")), F.lit("location"), F.col("n_name")),
        t("orders").select(_id("case", F.col("o_orderkey")), F.lit("case"), F.concat(F.lit("CASE-"), F.col("o_orderkey"))),
        t("part").select(_id("device", F.col("p_partkey")), F.lit("device"), F.col("p_name")),
        t("customer").select(_id("phone", phone), F.lit("phone"), F.concat(F.lit("+91"), F.lpad(phone.cast("string"), 10, "0"))).distinct(),
        t("customer").select(_id("vehicle", vehicle), F.lit("vehicle"), F.concat(F.lit("DL01AB"), F.lpad(vehicle.cast("string"), 8, "0"))).distinct(),
    ]
    return reduce(DataFrame.union, parts).withColumn("normalized_value", F.lower(F.trim("value")))


#: A task groups this many order lines, or their edges.
LINES = 200_000


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """In how many tasks order lines and edges are grouped, so that none holds more the more there are; none where the cores are enough."""
    n = read(spark, sf_dir, "lineitem").count() // LINES + 1  # from the files' footers
    return n if n > spark.sparkContext.defaultParallelism else None


def _dealt(df: DataFrame, n: int | None, *by: str) -> DataFrame:
    return df.repartition(n, *by) if n else df


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ev, l_orderkey, o_custkey, and the smallest l_suppkey, l_discount, ...) of each line number of an order; ev identifies it.

    Lines are dealt by order once, which serves the grouping and the join."""
    names = ["l_suppkey", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    n = tasks(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").repartition(*([n] if n else []), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in names))
    return lines.join(orders, "l_orderkey").withColumn("ev", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


#: A relationship's columns and their types.
RELATIONSHIP = {"investigation_id": "long", "id": "long", "source_entity_id": "long", "target_entity_id": "long", "relationship_type": "string", "confidence": "double", "evidence_id": "long"}


def _row(*values) -> Column:
    return F.struct(*(v.cast(kind).alias(n) for v, (n, kind) in zip(values, RELATIONSHIP.items())))


def _of_lines(lines: DataFrame, returned: bool = False) -> DataFrame:
    """The relationships of each line, from one pass over the lines; with `returned`, two more of each returned line."""
    own, ev, none = F.col("o_custkey"), F.col("ev"), F.lit(None)
    person, case, organization = _id("person", own), _id("case", F.col("l_orderkey")), _id("organization", F.col("l_suppkey"))
    rows = [
        _row(own, BILLION + ev, case, organization, F.lit("associated_with"), F.round(1 - F.col("l_discount"), 2), ev),
        _row(own, 100 * BILLION + ev, person, organization, F.lit("transferred_to"), F.lit(0.7), ev),
    ]
    every = F.array(*rows)
    if returned:
        back = _row(own, 700 * BILLION + ev, organization, person, F.lit("transferred_to"), F.lit(0.7), ev)
        contact = _row(own, 800 * BILLION + ev, person, organization, F.lit("contacted"), F.lit(0.6), none)
        every = F.when(F.col("l_returnflag") == "R", F.array(*rows, back, contact)).otherwise(every)
    return lines.select(F.explode(every).alias("r")).select("r.*")


def relationships(spark: SparkSession, sf_dir: str, returned: bool = False) -> DataFrame:
    """(investigation_id, id, source_entity_id, target_entity_id, relationship_type, confidence, evidence_id); one investigation a customer."""
    t = lambda name: read(spark, sf_dir, name)
    none, key, order = F.lit(None), F.col("c_custkey"), F.col("o_orderkey")
    owner = F.array(
        _row(key, 200 * BILLION + key, _id("person", key), _id("location", F.col("c_nationkey")), F.lit("located_at"), F.lit(0.9), none),
        _row(key, 400 * BILLION + key, _id("person", key), _id("phone", F.floor(key / 3)), F.lit("uses"), F.lit(0.95), none),
        _row(key, 500 * BILLION + key, _id("person", key), _id("vehicle", F.floor(key / 2)), F.lit("owns"), F.lit(0.85), none),
    )
    place = _row(none, 300 * BILLION + F.col("s_suppkey"), _id("organization", F.col("s_suppkey")), _id("location", F.col("s_nationkey")), F.lit("located_at"), F.lit(0.8), none)
    parts = [
        t("orders").select(_row(F.col("o_custkey"), order, _id("person", F.col("o_custkey")), _id("case", order), F.lit("person_in_case"), (F.lit(5) + order % 5) / 10, none).alias("r")).select("r.*"),
        _of_lines(order_lines(spark, sf_dir), returned),
        t("customer").select(F.explode(owner).alias("r")).select("r.*"),
        t("supplier").select(place.alias("r")).select("r.*"),
    ]
    return reduce(DataFrame.union, parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, entity_type, value, normalized_value)"""
    return entities(spark, sf_dir).withColumnRenamed("id", "node_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, rel_type, confidence): one per (src, rel_type, dst), the most confident."""
    every = relationships(spark, sf_dir).select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), F.col("relationship_type").alias("rel_type"), "confidence")
    return _dealt(every, tasks(spark, sf_dir), "src", "dst", "rel_type").groupBy("src", "dst", "rel_type").agg(F.max("confidence").alias("confidence"))


def finding_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of the investigations, and two more for each returned line: the money back, and a contact of the person about it."""
    return relationships(spark, sf_dir, returned=True).where("investigation_id is not null")


FIRST = ["Arjun", "Meera", "Kabir", "Vikram", "Rajesh", "Suresh", "Dinesh", "Anita", "Priya", "Rohan"]
LAST = ["Rao", "Sharma", "Khan", "Verma", "Malhotra", "Raina", "Gupta", "Iyer", "Nair", "Das"]
ORGS = ["Apex Logistics Pvt Ltd", "Vertex Trading Pvt Ltd", "Orion Supplies", "Delta Holdings"]
CUES = ["works for", "contacted", "transferred funds to", "is associated with"]


def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, case_id, text): a report on each order, with the names, numbers and cues that the extractors look for."""
    def pick(words: list[str], key):
        return F.get(F.array(*(F.lit(w) for w in words)), (key % len(words)).cast("int"))

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    person = F.concat_ws(" ", pick(FIRST, cust), pick(LAST, F.floor(cust / 10)))
    other = F.concat_ws(" ", pick(FIRST, key), pick(LAST, F.floor(key / 10)))
    digits = lambda c, n: F.lpad((c % 10**n).cast("string"), n, "0")
    text = F.concat(
        F.lit("Case Number: CASE-2024-"), key.cast("string"), F.lit(". "), person, F.lit(" "), pick(CUES, key), F.lit(" "), pick(ORGS, cust), F.lit(". "), person, F.lit(" is known to "), other,
        F.lit(". "), other, F.lit(" used phone +91 98765 "), digits(cust, 5), F.lit(" near vehicle DL 01 AB "), digits(key, 4), F.lit(". Charges under IPC 420 on "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(". Write to user"), cust.cast("string"), F.lit("@mail.example.com."),
    )
    return read(spark, sf_dir, "orders").select(key.alias("doc_id"), key.alias("case_id"), text.alias("text"))


MODEL_SQL = """
entities AS (
  SELECT id::BIGINT AS id, entity_type, value, lower(trim(value)) AS normalized_value FROM (
    SELECT 1000000000 + c_custkey AS id, 'person' AS entity_type, c_name AS value FROM customer
    UNION ALL SELECT 2000000000 + s_suppkey, 'organization', s_name FROM supplier
    UNION ALL SELECT 3000000000 + n_nationkey, 'location', n_name FROM nation
    UNION ALL SELECT 4000000000 + o_orderkey, 'case', 'CASE-' || o_orderkey FROM orders
    UNION ALL SELECT 5000000000 + p_partkey, 'device', p_name FROM part
    UNION ALL SELECT DISTINCT 6000000000 + c_custkey // 3, 'phone', '+91' || lpad((c_custkey // 3)::VARCHAR, 10, '0') FROM customer
    UNION ALL SELECT DISTINCT 7000000000 + c_custkey // 2, 'vehicle', 'DL01AB' || lpad((c_custkey // 2)::VARCHAR, 8, '0') FROM customer)
), lines AS (
  SELECT o_custkey, l.*, l_orderkey * 10 + l_linenumber AS ev FROM (
    SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL) l
  JOIN orders ON l_orderkey = o_orderkey
), relationships AS (
  SELECT o_custkey::BIGINT AS investigation_id, o_orderkey::BIGINT AS id, 1000000000 + o_custkey AS source_entity_id, 4000000000 + o_orderkey AS target_entity_id,
         'person_in_case' AS relationship_type, (5 + o_orderkey % 5) / 10 AS confidence, NULL::BIGINT AS evidence_id FROM orders
  UNION ALL SELECT o_custkey, 1000000000 + ev, 4000000000 + l_orderkey, 2000000000 + l_suppkey, 'associated_with', round(1 - l_discount, 2), ev FROM lines
  UNION ALL SELECT o_custkey, 100000000000 + ev, 1000000000 + o_custkey, 2000000000 + l_suppkey, 'transferred_to', 0.7, ev FROM lines
  UNION ALL SELECT c_custkey, 200000000000 + c_custkey, 1000000000 + c_custkey, 3000000000 + c_nationkey, 'located_at', 0.9, NULL FROM customer
  UNION ALL SELECT NULL, 300000000000 + s_suppkey, 2000000000 + s_suppkey, 3000000000 + s_nationkey, 'located_at', 0.8, NULL FROM supplier
  UNION ALL SELECT c_custkey, 400000000000 + c_custkey, 1000000000 + c_custkey, 6000000000 + c_custkey // 3, 'uses', 0.95, NULL FROM customer
  UNION ALL SELECT c_custkey, 500000000000 + c_custkey, 1000000000 + c_custkey, 7000000000 + c_custkey // 2, 'owns', 0.85, NULL FROM customer
), finding_relationships AS (
  SELECT * FROM relationships WHERE investigation_id IS NOT NULL
  UNION ALL SELECT o_custkey, 700000000000 + ev, 2000000000 + l_suppkey, 1000000000 + o_custkey, 'transferred_to', 0.7, ev FROM lines WHERE l_returnflag = 'R'
  UNION ALL SELECT o_custkey, 800000000000 + ev, 1000000000 + o_custkey, 2000000000 + l_suppkey, 'contacted', 0.6, NULL FROM lines WHERE l_returnflag = 'R'
), nodes AS (
  SELECT id AS node_id, entity_type, value, normalized_value FROM entities
), edges AS (
  SELECT source_entity_id AS src, target_entity_id AS dst, relationship_type AS rel_type, max(confidence)::DOUBLE AS confidence FROM relationships GROUP BY ALL
), sym AS (
  SELECT src AS node, dst AS other, rel_type, confidence FROM edges UNION ALL SELECT dst, src, rel_type, confidence FROM edges
), adj AS (
  SELECT DISTINCT node, other FROM sym
)
"""
