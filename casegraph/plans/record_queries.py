"""Registered queries of normalisation, validation, source records, text mining, resolution, search and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as n
from ..functions import validate as v
from ..operators import findings as b
from ..operators import graph as g
from ..operators import reports as rp
from ..operators import resolve as r
from ..operators import risk as k
from ..operators import search as se
from ..operators import text as t
from ..sources import readers, records
from . import adapters as m
from . import graph_queries
from .registry import query

INV = "investigation_id"


# Raw columns with messy spellings, made of the order and event tables.

RAW = """WITH raw AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN '+91 ' || user_id || '-' || event_id WHEN 1 THEN ' (0' || user_id || ') 555 ' || event_id WHEN 2 THEN 'n/a' ELSE '' END AS phone,
    '  User ' || user_id || ' @Mail.Example.COM ' AS mail, ' dl ' || lpad((user_id % 100)::VARCHAR, 2, '0') || ' ab-' || event_id AS plate,
    CASE event_id % 6 WHEN 0 THEN strftime(ts, '%d/%m/%Y %H:%M') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%d-%m-%Y') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 4 THEN '12/25/2024' ELSE 'soon' END AS stamp,
    CASE event_id % 3 WHEN 0 THEN 'Rs ' || value WHEN 1 THEN '$' || value || ' paid' ELSE 'none' END AS paid,
    CASE event_id % 4 WHEN 0 THEN (user_id % 12) || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || ':05' WHEN 1 THEN (event_id % 60) || ':30' WHEN 2 THEN event_id || ' sec' ELSE 'x' END AS lasted,
    CASE WHEN event_id % 5 = 0 THEN 'abc' ELSE ((event_id % 400) - 200)::VARCHAR END AS coord, ' ' || event_type || '  of   user ' AS words, ' @' || event_type || ', #tag, @' || event_type || ' ,, x' AS tags,
    'Hi @' || event_type || ' and @ann_1 #' || event_type || ' #x' AS post, event_type, user_id, value, ts
  FROM events)"""


def raw(s, d):
    e, u, x = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.col("ts")
    form = lambda f: F.date_format(at, f)
    cat = lambda *p: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in p))
    return m.read(s, d, "events").select(
        "event_id", F.when(e % 4 == 0, cat("+91 ", u, "-", x)).when(e % 4 == 1, cat(" (0", u, ") 555 ", x)).when(e % 4 == 2, "n/a").otherwise("").alias("phone"), cat("  User ", u, " @Mail.Example.COM ").alias("mail"),
        cat(" dl ", pad(F.col("user_id") % 100), " ab-", x).alias("plate"),
        F.when(e % 6 == 0, form("dd/MM/yyyy HH:mm")).when(e % 6 == 1, form("yyyy-MM-dd HH:mm:ss")).when(e % 6 == 2, form("dd-MM-yyyy")).when(e % 6 == 3, form("yyyy-MM-dd'T'HH:mm:ss")).when(e % 6 == 4, "12/25/2024").otherwise("soon").alias("stamp"),
        F.when(e % 3 == 0, cat("Rs ", F.col("value"))).when(e % 3 == 1, cat("$", F.col("value"), " paid")).otherwise("none").alias("paid"),
        F.when(e % 4 == 0, cat(F.col("user_id") % 12, ":", pad(e % 60), ":05")).when(e % 4 == 1, cat(e % 60, ":30")).when(e % 4 == 2, cat(x, " sec")).otherwise("x").alias("lasted"),
        F.when(e % 5 == 0, "abc").otherwise((e % 400 - 200).cast("string")).alias("coord"), cat(" ", F.col("event_type"), "  of   user ").alias("words"), cat(" @", F.col("event_type"), ", #tag, @", F.col("event_type"), " ,, x").alias("tags"),
        cat("Hi @", F.col("event_type"), " and @ann_1 #", F.col("event_type"), " #x").alias("post"), "event_type", "user_id", "value", "ts",
    )


DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"
PHONE = f"CASE WHEN {DIGITS.format(c='phone')} = '' THEN NULL WHEN starts_with(trim(phone), '+') THEN '+' || {DIGITS.format(c='phone')} ELSE {DIGITS.format(c='phone')} END"


@query(
    "n03_identifiers",
    RAW + f""" SELECT event_id, {PHONE} AS phone, lower(trim(mail)) AS email, regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g') AS registration, trim(regexp_replace(words, '\\s+', ' ', 'g')) AS words,
upper(trim(event_type)) AS code, 'tag' AS handle FROM raw""",
)
def _(s, d):
    c = F.col
    return raw(s, d).select("event_id", n.normalize_phone(c("phone")).alias("phone"), n.normalize_email(c("mail")).alias("email"), n.normalize_registration(c("plate")).alias("registration"), n.normalize_text(c("words")).alias("words"), n.upper_code(c("event_type")).alias("code"), n.normalize_handle(F.lit(" @@tag ")).alias("handle"))


@query(
    "n07_values",
    RAW + """ SELECT event_id, coalesce(try_strptime(stamp, '%Y-%m-%dT%H:%M:%S'), try_strptime(stamp, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%d-%m-%Y', '%d-%m-%Y %H:%M:%S', '%d-%m-%Y %H:%M', '%d/%m/%Y', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%m/%d/%Y', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M']))::VARCHAR AS stamp,
try_cast(coord AS DOUBLE) AS coordinate, try_cast(regexp_replace(paid, '[^0-9.-]', '', 'g') AS DOUBLE) AS amount,
CASE WHEN len(string_split(lasted, ':')) = 3 THEN split_part(lasted, ':', 1)::DOUBLE * 3600 + split_part(lasted, ':', 2)::DOUBLE * 60 + split_part(lasted, ':', 3)::DOUBLE
  WHEN len(string_split(lasted, ':')) = 2 THEN split_part(lasted, ':', 1)::DOUBLE * 60 + split_part(lasted, ':', 2)::DOUBLE ELSE try_cast(regexp_replace(lasted, '[^0-9.]', '', 'g') AS DOUBLE) END AS seconds,
((try_cast(coord AS DOUBLE) % 360) + 360) % 360 AS bearing, try_cast(coord AS DOUBLE)::BIGINT AS n FROM raw""",
)
def _(s, d):
    c = F.col
    return raw(s, d).select("event_id", n.parse_datetime_multi(c("stamp")).cast("string").alias("stamp"), n.parse_coordinate(c("coord")).alias("coordinate"), n.parse_amount(c("paid")).alias("amount"), n.parse_duration_seconds(c("lasted")).alias("seconds"), n.normalize_bearing(c("coord")).alias("bearing"), n.parse_count(c("coord")).alias("n"))


@query(
    "n14_lists",
    RAW + """ SELECT event_id, event_type || CASE WHEN event_type IN ('tag') THEN '' ELSE ',tag' END || CASE WHEN event_type = 'x' THEN '' ELSE ',x' END AS items, event_type || ',ann_1' AS mentions, 'x,' || event_type AS hashtags,
'event: ' || event_id || chr(10) || 'type: ' || event_type AS text FROM raw""",
)
def _(s, d):
    c = F.col
    return raw(s, d).select("event_id", n.split_list(c("tags")).alias("items"), n.extract_mentions(c("post")).alias("mentions"), n.merge_lists(F.array(F.lit("x")), n.extract_hashtags(c("post"))).alias("hashtags"),  n.nlp_text({"event": "event_id", "type": "event_type"}).alias("text"))


@query(
    "n19_entity_values",
    """SELECT id, CASE WHEN entity_type IN ('case', 'device') THEN regexp_replace(upper(trim(value)), '\\s+', '', 'g') WHEN entity_type = 'person' THEN regexp_replace(lower(trim(value)), '\\s+', ' ', 'g')
  WHEN entity_type = 'phone' THEN '+' || regexp_replace(value, '[^0-9]', '', 'g') ELSE trim(value) END AS value,
CASE WHEN entity_type IN ('case', 'device') THEN regexp_replace(upper(trim(value)), '[\\s\\-_/:]+', '', 'g') WHEN entity_type = 'phone' THEN regexp_replace(value, '[^0-9]', '', 'g')
  WHEN entity_type = 'person' THEN trim(regexp_replace(regexp_replace(lower(value), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) ELSE trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) END AS linking,
CASE entity_type WHEN 'person' THEN 'person_of_interest' WHEN 'vehicle' THEN 'vehicle' WHEN 'location' THEN 'location' WHEN 'organization' THEN 'organization' WHEN 'phone' THEN 'phone' ELSE 'related' END AS case_relation,
trim(regexp_replace(regexp_replace(lower(value), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS tokens FROM entities""",
)
def _(s, d):
    e = m.entities(s, d)
    kind, value = F.col("entity_type"), F.col("value")
    return e.select("id", n.normalize_entity_value(kind, value).alias("value"), n.normalize_for_linking(kind, value).alias("linking"), n.map_case_relation(n.map_entity_type(kind)).alias("case_relation"), n.normalize_company_tokens(value).alias("tokens"))


@query(
    "n22_relation_types",
    """SELECT relationship_type, CASE WHEN relationship_type = 'person_in_case' THEN 'other' ELSE relationship_type END AS stored, upper(relationship_type) AS graph_type, count(*) AS n FROM relationships GROUP BY relationship_type""",
)
def _(s, d):
    c = F.col("relationship_type")
    return m.relationships(s, d).groupBy(c, n.map_relationship_type(c).alias("stored"), n.sanitize_relation_type(c).alias("graph_type")).agg(F.count("*").alias("n"))


@query("n17_resolved_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END AS name FROM customer")
def _(s, d):
    key = F.col("c_custkey")
    full = F.when(key % 3 > 0, F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
    return m.read(s, d, "customer").select("c_custkey", n.resolved_name(full, F.col("c_mktsegment"), F.lit(" "), F.col("c_name")).alias("name"))


@query("n01_canonical_columns", "SELECT event_id, user_id::VARCHAR AS phone_number, CASE WHEN event_type <> '' THEN event_type END AS phone_number_alternate, value AS amount, ts AS timestamp FROM events")
def _(s, d):
    e = m.read(s, d, "events")
    return n.canonical_columns(e.select("event_id", F.col("user_id").alias(" Mobile  Number"), F.col("event_type").alias("Tele-phone").alias("telephone"), F.col("value").alias("Amount/Paid"), F.col("ts").alias("Event Time")))


# Validation


def checked(s, d):
    return raw(s, d).withColumn("issues", v.issues(["phone", "stamp", "coord"], required=["phone"], phones=["phone"], emails=["mail"], dates=["stamp"], latitude="coord"))


ISSUES = RAW + """, i AS (
  SELECT event_id AS record_index, 'phone' AS field, 'required field is missing' AS message, 'error' AS severity FROM raw WHERE trim(phone) = ''
  UNION ALL SELECT event_id, 'phone', 'unusual phone format', 'warning' FROM raw WHERE trim(phone) <> '' AND NOT regexp_full_match(trim(phone), '\\+?[0-9][0-9\\s\\-().]{5,20}')
  UNION ALL SELECT event_id, 'mail', 'unusual email format', 'warning' FROM raw WHERE NOT regexp_full_match(trim(mail), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')
  UNION ALL SELECT event_id, 'stamp', 'unrecognised date', 'warning' FROM raw WHERE stamp = 'soon'
  UNION ALL SELECT event_id, 'coord', 'coordinate out of range', 'error' FROM raw WHERE NOT coalesce(try_cast(coord AS DOUBLE) BETWEEN -90 AND 90, false))"""


@query("v08_issues", ISSUES + " SELECT * FROM i")
def _(s, d):
    return v.issue_table(checked(s, d), "event_id")


@query(
    "v09_totals",
    ISSUES + """, bad AS (SELECT DISTINCT record_index FROM i WHERE severity = 'error')
SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM bad) AS valid, (SELECT count(*) FROM bad) AS invalid, (SELECT count(*) FROM i WHERE severity = 'error') AS errors, (SELECT count(*) FROM i WHERE severity = 'warning') AS warnings""",
)
def _(s, d):
    return v.totals(checked(s, d))


@query(
    "v11_ingestion_summary",
    ISSUES + """ SELECT event_type, count(*) AS received, count(*) FILTER (b.record_index IS NULL) AS processed, count(*) FILTER (b.record_index IS NOT NULL) AS rejected
FROM raw LEFT JOIN (SELECT DISTINCT record_index FROM i WHERE severity = 'error') b ON b.record_index = event_id GROUP BY event_type""",
)
def _(s, d):
    return v.ingestion_summary(checked(s, d), "event_type")


@query("v10_missing_fields", RAW + " SELECT event_id, concat_ws(',', CASE WHEN trim(phone) = '' THEN 'phone' END, CASE WHEN trim(phone) = '' THEN 'phone|none' END) AS missing FROM raw")
def _(s, d):
    return raw(s, d).withColumn("none", F.lit(None).cast("string")).select("event_id", v.missing_fields(["phone", "stamp"], [["phone", "none"], ["stamp", "coord"]]).alias("missing"))


@query("v07_gps_pairs", RAW + " SELECT event_id, coalesce(try_cast(coord AS DOUBLE) BETWEEN -90 AND 90 AND value BETWEEN -180 AND 180, false) AS usable FROM raw")
def _(s, d):
    return raw(s, d).select("event_id", v.valid_gps_pair(F.col("coord"), F.col("value")).alias("usable"))


# Source records


@query(
    "p01_calls",
    RAW + f""" SELECT {PHONE} AS src, user_id::VARCHAR AS dst, 'COMMUNICATED_WITH' AS rel_type, 1.0::DOUBLE AS confidence FROM raw WHERE {PHONE} IS NOT NULL""",
)
def _(s, d):
    r_ = raw(s, d).select(F.col("phone").alias("Calling Number"), F.col("user_id").cast("string").alias("called-party"), F.col("stamp").alias("Call Date"), F.col("lasted").alias("call_length"), F.col("coord").alias("LAT"))
    return records.edges(records.typed(r_, "cdr"), "cdr")


@query(
    "p02_transactions",
    """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'C' || o_custkey ELSE 'A' || l_orderkey END AS src, 'S' || l_suppkey AS dst, 'TRANSFERRED_TO' AS rel_type, 1.0::DOUBLE AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    model=False,
)
def _(s, d):
    lines = m.read(s, d, "lineitem").join(m.read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r_ = lines.select(
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("C"), "o_custkey")).otherwise(" ").alias("Sender ID"), F.concat(F.lit("A"), "l_orderkey").alias("From Account"),
        F.concat(F.lit("S"), "l_suppkey").alias("beneficiary account"), F.concat(F.lit("Rs "), "l_extendedprice").alias("amount paid"), F.lit("inr ").alias("curr"),
    )
    return records.edges(records.typed(r_, "transactions"), "transactions")


def gps(s, d):
    r_ = raw(s, d).select(F.concat(F.lit("E"), "event_id").alias("Event ID"), F.col("phone").alias("MSISDN"), F.col("coord").alias("GPS Latitude"), F.col("value").cast("string").alias("lng"), F.col("stamp").alias("recorded at"), F.col("coord").alias("heading"))
    return records.typed(r_, "gps")


@query("p03_gps_links", RAW + f" SELECT 'E' || event_id AS node, 'phone' AS entity_type, {PHONE} AS value FROM raw WHERE {PHONE} IS NOT NULL")
def _(s, d):
    return records.link_candidates(gps(s, d), "gps")


@query("p03_gps_records", RAW + f" SELECT 'E' || event_id AS record_id, {PHONE} AS phone_number, try_cast(coord AS DOUBLE) AS latitude, value AS longitude, ((try_cast(coord AS DOUBLE) % 360) + 360) % 360 AS bearing FROM raw")
def _(s, d):
    return gps(s, d).select("record_id", "phone_number", "latitude", "longitude", "bearing")


@query("p04_vehicles", "SELECT 'DL01AB' || p_partkey AS node, 'person' AS entity_type, p_brand AS value FROM part", model=False)
def _(s, d):
    r_ = m.read(s, d, "part").select(F.concat(F.lit("dl 01-ab "), "p_partkey").alias("Number Plate"), F.col("p_brand").alias("Owner"), F.col("p_type").alias("vehicle class"))
    return records.link_candidates(records.typed(r_, "vehicles"), "vehicles")


@query("p05_fir_texts", "SELECT 'F' || o_orderkey AS fir_number, 'FIR: F' || o_orderkey || chr(10) || 'Offence: ' || o_orderpriority AS text, CASE WHEN true THEN 'narrative' END AS missing FROM orders", model=False)
def _(s, d):
    r_ = m.read(s, d, "orders").select(F.concat(F.lit("F"), "o_orderkey").alias("FIR No"), F.col("o_orderpriority").alias("Crime Type"), F.col("o_orderdate").cast("date").cast("string").alias("Date of incident"))
    return records.typed(r_, "fir").select("fir_number", records.texts("fir").alias("text"), "missing")


@query("p06_posts", RAW + " SELECT 'P' || event_id AS post_id, 'forum' AS platform, event_type AS account_handle, event_type || ',ann_1' AS mentions, 'x' || CASE WHEN event_type = 'x' THEN '' ELSE ',' || event_type END AS hashtags FROM raw")
def _(s, d):
    r_ = raw(s, d).select(F.concat(F.lit("P"), "event_id").alias("Message ID"), F.lit(" Forum").alias("site"), F.concat(F.lit("@"), "event_type").alias("Screen Name"), F.col("post").alias("Post Text"), F.lit("#x").alias("tags"))
    return records.typed(r_, "social_media").select("post_id", "platform", "account_handle", "mentions", "hashtags")


@query("p07_custody", "SELECT 'custody_record' AS entity_type, 'I' || c_custkey AS normalized_value FROM customer", model=False)
def _(s, d):
    r_ = m.read(s, d, "customer").select(F.concat(F.lit("I"), "c_custkey").alias("Prisoner Number"), F.col("c_name").alias("Inmate Name"), F.concat(F.lit("theft, "), "c_mktsegment").alias("Charge"))
    return records.nodes(records.typed(r_, "jail_records"), "jail_records")


@query("p08_forensic", "SELECT 'X' || p_partkey AS evidence_id, 'Evidence: X' || p_partkey || chr(10) || 'Type: ' || p_type || chr(10) || 'Description: ' || p_name AS text, 'case_reference' AS missing FROM part", model=False)
def _(s, d):
    r_ = m.read(s, d, "part").select(F.concat(F.lit("X"), "p_partkey").alias("Exhibit Number"), F.col("p_type").alias("Item Type"), F.col("p_name").alias("Exhibit Description"))
    return records.typed(r_, "forensic").select("evidence_id", records.texts("forensic").alias("text"), "missing")


@query("p09_postmortem", "SELECT 'M' || s_suppkey AS record_id, s_name || ' Doe' AS deceased_name, 'CLOSED' AS status, 'case_reference,person_id|deceased_name' AS missing FROM supplier", model=False)
def _(s, d):
    r_ = m.read(s, d, "supplier").select(F.concat(F.lit("M"), "s_suppkey").alias("PM No"), F.col("s_name").alias("First Name"), F.lit("Doe").alias("surname"), F.lit(" closed").alias("Report Status"))
    return records.typed(r_, "postmortem").select("record_id", "deceased_name", "status", "missing")


@query("s06_merged_edges", """SELECT src, rel_type, dst, CASE WHEN rel_type = 'uses' THEN 0.5 ELSE confidence END::DOUBLE AS confidence FROM edges""")
def _(s, d):
    e = m.edges(s, d)
    return readers.merge_edges(e, e.where("rel_type = 'uses'").withColumn("confidence", F.lit(0.5)))


# Text mining


@query("t01_mentions")
def _(s, d):
    return t.mentions(m.case_texts(s, d))


@query("t01_document_mentions")
def _(s, d):
    return t.mentions(m.read(s, d, "documents"))


@query("t09_record_mentions", "SELECT c_custkey AS doc_id, 'name' AS source_field, 'PERSON' AS entity_type, c_name AS value, lower(c_name) AS normalized_value, 0.9::DOUBLE AS confidence FROM customer UNION ALL SELECT c_custkey, 'company', 'ORGANIZATION', c_mktsegment, c_mktsegment, 0.88 FROM customer", model=False)
def _(s, d):
    return t.record_mentions(m.read(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company")), "c_custkey")


@query(
    "t10_compact_entities",
    r"""WITH found AS (
  SELECT doc_id, 'EMAIL' AS entity_type, 0.99 AS confidence, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS value FROM documents
  UNION ALL SELECT doc_id, 'DATE', 0.95, unnest(regexp_extract_all(text, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b') || regexp_extract_all(text, '\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b') || regexp_extract_all(text, '(?i)\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\b')) FROM documents
  UNION ALL SELECT doc_id, 'PHONE', 0.98, regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '([^0-9+])', '\1\1', 'g'), '(?:^|[^0-9])((?:\+91[\s-]{0,2})?[6-9][0-9]{9})(?:$|[^0-9])', 1)), '[\s-]', '', 'g') FROM documents
  UNION ALL SELECT doc_id, 'ACCOUNT', 0.85, unnest(regexp_extract_all(text, '(?i)\b(?:account|acct)[\s#:.-]*[A-Za-z0-9_-]{4,30}\b') || regexp_extract_all(text, '(?i)\b(?:upi|wallet)[\s#:.-]*[A-Za-z0-9._@-]{4,50}\b')) FROM documents
  UNION ALL SELECT doc_id, 'VEHICLE', 0.92, unnest(regexp_extract_all(text, '(?i)\b[A-Z]{2}[-\s]?\d{1,2}[-\s]?[A-Z]{1,3}[-\s]?\d{1,4}\b')) FROM documents
) SELECT doc_id, entity_type, min(value) AS value, max(confidence)::DOUBLE AS confidence FROM found GROUP BY doc_id, entity_type, lower(value)""",
    model=False,
)
def _(s, d):
    return t.compact_entities(m.read(s, d, "documents"))


@query("t11_relations")
def _(s, d):
    docs = m.case_texts(s, d)
    return t.relations(docs, t.mentions(docs))


@query(
    "t13_record_relations",
    """SELECT ev AS doc_id, 'CASE_RELATED_FIR' AS relation_type, 'CASE-' || l_orderkey AS source_value, 'FIR-' || o_custkey AS target_value, 0.9::DOUBLE AS confidence FROM lines
UNION ALL SELECT ev, 'EVIDENCE_RELATED_CASE', 'EV-' || ev, 'CASE-' || l_orderkey, 0.85 FROM lines""",
)
def _(s, d):
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    records = m.order_lines(s, d).select(F.col("ev").alias("doc_id"), name("CASE-", "l_orderkey").alias("case_number"), name("FIR-", "o_custkey").alias("fir_number"), name("EV-", "ev").alias("evidence_id"))
    return t.record_relations(t.record_mentions(records, "doc_id"))


@query("t15_document_confidence")
def _(s, d):
    docs = m.case_texts(s, d)
    found = g.checkpointed(t.mentions(docs))
    return t.document_confidence(docs, found, t.relations(docs, found))


@query("t16_document_statistics")
def _(s, d):
    docs = m.read(s, d, "documents").select("doc_id", "text")
    found = g.checkpointed(t.mentions(docs))
    return t.document_statistics(docs, found, t.relations(docs, found))


INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{"|".join(w)}') THEN '{i}'" for i, w in t.INTENTS.items()) + " ELSE 'general' END"


@query("t17_intents", f"SELECT conv_id, turn, {INTENT} AS intent FROM conversations", model=False)
def _(s, d):
    return m.read(s, d, "conversations").select("conv_id", "turn", t.question_intent(F.col("text")).alias("intent"))


@query("t18_repeated_entities")
def _(s, d):
    return t.repeated_entities(t.mentions(m.case_texts(s, d)))


@query("t19_recurring_relations")
def _(s, d):
    docs = m.case_texts(s, d)
    return t.recurring_relations(t.relations(docs, t.mentions(docs)))


@query("t20_persons_sharing")
def _(s, d):
    docs = m.case_texts(s, d)
    return t.persons_sharing(t.relations(docs, t.mentions(docs)))


@query("t21_case_groups")
def _(s, d):
    docs = m.case_texts(s, d)
    return t.case_groups(t.relations(docs, t.mentions(docs)))


@query("t22_distinct_patterns", "SELECT DISTINCT 'pair' AS pattern_type, least(src, dst) || ',' || greatest(src, dst) AS entities FROM edges")
def _(s, d):
    e = m.edges(s, d)
    both = e.select(F.lit("pair").alias("pattern_type"), F.array("src", "dst").alias("entities")).union(e.select(F.lit("pair"), F.array("dst", "src")))
    return t.distinct_patterns(both)


@query("t23_focus_entities")
def _(s, d):
    e = m.entities(s, d).where("entity_type in ('case', 'location')").select("entity_type", "value")
    texts = m.case_texts(s, d).select(F.col("doc_id").alias("question_id"), F.concat(F.lit("what about CASE-"), F.col("doc_id").cast("string"), F.lit(" and FRANCE?")).alias("question"))
    return t.focus_entity(texts, e)


# Resolution and context


def entity_mentions(s, d):
    """Mentions of every relationship end, as evidence ingestion gives them."""
    e = m.entities(s, d)
    ends = m.relationships(s, d).where("evidence_id is not null").select("evidence_id", "confidence", F.explode(F.array("source_entity_id", "target_entity_id")).alias("id"))
    joined = ends.join(e, "id")
    return joined.select(F.col("evidence_id").alias("source_reference"), F.upper("entity_type").alias("entity_type"), F.upper("value").alias("value"), "normalized_value", F.lit(0).alias("start"), "confidence")


MENTIONS = """WITH ment AS (
  SELECT evidence_id AS source_reference, entity_type, upper(value) AS value, normalized_value, confidence FROM (SELECT evidence_id, confidence, unnest([source_entity_id, target_entity_id]) AS eid FROM relationships WHERE evidence_id IS NOT NULL) JOIN entities ON id = eid)"""


@query(
    "r01_resolved_entities",
    MENTIONS + """ SELECT entity_type, normalized_value AS key, arg_min(value, source_reference) AS value, min(source_reference) AS source_reference, max(confidence)::DOUBLE AS confidence, count(*) AS mentions, entity_type = 'organization' AS reused FROM ment GROUP BY ALL""",
)
def _(s, d):
    return r.resolved_entities(entity_mentions(s, d), m.entities(s, d).where("entity_type = 'organization'"))


@query("r02_fuzzy_matches")
def _(s, d):
    p = m.read(s, d, "part").select("p_partkey", "p_name")
    new = p.select(F.col("p_partkey").alias("new_id"), F.lit("device").alias("entity_type"), F.concat(F.regexp_replace("p_name", "e", "3"), F.lit(" ltd")).alias("name"))
    return r.fuzzy_matches(new, p.select(F.col("p_partkey").alias("existing_id"), F.lit("device").alias("entity_type"), F.concat("p_name", F.lit(" limited")).alias("name")))


@query("r02_merged_names")
def _(s, d):
    p = m.read(s, d, "part").select("p_partkey", "p_name", "p_brand")
    spelled = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.regexp_replace("p_name", "e", "3")).otherwise(F.regexp_replace("p_name", "l", ""))
    return r.merged_names(p.select(F.col("p_partkey").alias("new_id"), F.lit("device").alias("entity_type"), F.concat(spelled, F.lit(" "), F.col("p_brand"), F.lit(" ltd")).alias("name")))


@query("r03_gazetteer")
def _(s, d):
    e = m.entities(s, d).where("entity_type in ('person', 'organization', 'location')")
    known = e.select(F.col("id").alias("entity_id"), "entity_type", "value", F.array(F.concat(F.lit("Old "), "value")).alias("aliases"))
    spelled = F.when(F.col("id") % 3 == 0, F.col("value")).when(F.col("id") % 3 == 1, F.lower("value")).otherwise(F.concat(F.lit(" old  "), "value"))
    return r.linked(r.gazetteer_matches(e.select(F.col("id").alias("mention_id"), "entity_type", spelled.alias("value")), known))


@query(
    "r05_relationships",
    """SELECT source_entity_id, target_entity_id, CASE WHEN relationship_type = 'person_in_case' THEN 'other' ELSE relationship_type END AS relationship_type, max(confidence)::DOUBLE AS confidence, min(evidence_id) AS evidence_id, min(relationship_type) AS raw_relation_type FROM relationships GROUP BY ALL""",
)
def _(s, d):
    return r.resolved_relationships(m.relationships(s, d).withColumnRenamed("relationship_type", "relation_type"))


@query("r06_case_links", """SELECT DISTINCT source_entity_id AS case_id, target_entity_id AS entity_id, 'organization' AS relation FROM relationships WHERE relationship_type = 'associated_with' AND target_entity_id % 2 = 0""")
def _(s, d):
    rel = m.relationships(s, d).where("relationship_type = 'associated_with'").select(F.col("source_entity_id").alias("case_id"), F.col("target_entity_id").alias("entity_id"), F.lit("Organization").alias("entity_type"))
    old = rel.where("entity_id % 2 = 1").select("case_id", "entity_id", F.lit("organization").alias("relation"))
    return r.case_links(rel, old)


@query("r07_ingestion_summary", "SELECT evidence_id, relationship_type AS kind, count(*) FILTER (id % 2 = 0) AS created, count(*) FILTER (id % 2 = 1) AS reused FROM relationships WHERE evidence_id IS NOT NULL GROUP BY ALL")
def _(s, d):
    return r.ingestion_summary(m.relationships(s, d).where("evidence_id is not null").select("evidence_id", F.col("relationship_type").alias("kind"), (F.col("id") % 2 == 1).alias("reused")))


def _case_rows(s, d):
    return m.read(s, d, "orders").select((F.lit(m.OFFSET["case"] * m.BILLION) + F.col("o_orderkey")).alias("case_id"), F.concat(F.lit("CASE-"), "o_orderkey").alias("case_number"))


@query(
    "r08_graph_projection",
    """WITH k AS (SELECT id, entity_type || '|' || normalized_value AS key FROM entities), e AS (
  SELECT s.key AS src, t.key AS dst, upper(relationship_type) AS rel_type, max(confidence)::DOUBLE AS confidence FROM relationships JOIN k s ON s.id = source_entity_id JOIN k t ON t.id = target_entity_id GROUP BY ALL
  UNION ALL SELECT DISTINCT 'case|case-' || o_orderkey, 'person|' || lower(c_name), 'PERSON_OF_INTEREST', 1.0 FROM orders JOIN customer ON c_custkey = o_custkey) SELECT * FROM e""",
)
def _(s, d):
    own = m.relationships(s, d)
    links = own.where("relationship_type = 'person_in_case'").select(F.col("target_entity_id").alias("case_id"), F.col("source_entity_id").alias("entity_id"), F.lit("person_of_interest").alias("relation"))
    return r.graph_projection(_case_rows(s, d), m.entities(s, d), links, own)[1]


@query("r09_acceptable", "SELECT min(id) AS id FROM relationships WHERE id % 10 > 0 GROUP BY source_entity_id, target_entity_id, relationship_type")
def _(s, d):
    rel = m.relationships(s, d).withColumn("deleted_at", F.when(F.col("id") % 10 == 0, F.current_timestamp()))
    return r.acceptable_relationships(rel, m.entities(s, d).withColumn("deleted_at", F.lit(None).cast("timestamp"))).select("id")


@query("r10_node_removal", "SELECT src, dst, rel_type FROM edges WHERE src % 7 > 0 AND dst % 7 > 0")
def _(s, d):
    nodes = m.nodes(s, d)
    return r.node_removal(nodes, m.edges(s, d), nodes.where("node_id % 7 = 0"))[1].select("src", "dst", "rel_type")


# Evidence: one record per order line. An investigation is linked with the evidence of its customer's orders.


def evidence(s, d):
    return m.order_lines(s, d).select(
        F.col("ev").alias("evidence_id"), F.col("l_orderkey").alias("case_id"), F.col("o_custkey").alias(INV), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("description"),
        F.when(F.col("l_returnflag") == "R", "processed").otherwise("pending").alias("status"), F.when(F.col("l_linestatus") == "O", "document").otherwise("image").alias("kind"), F.col("l_shipdate").alias("collected_at"),
    )


EVIDENCE = """WITH ev AS (
  SELECT ev AS evidence_id, l_orderkey AS case_id, o_custkey AS investigation_id, 'Line ' || l_linenumber AS description,
    CASE WHEN l_returnflag = 'R' THEN 'processed' ELSE 'pending' END AS status, CASE WHEN l_linestatus = 'O' THEN 'document' ELSE 'image' END AS kind, l_shipdate AS collected_at FROM lines)"""


def links(s, d):
    return evidence(s, d).select(INV, "evidence_id")


@query("j01_evidence_in_scope", EVIDENCE + " SELECT investigation_id, evidence_id, case_id FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY evidence_id DESC) AS n FROM ev) WHERE n <= 500")
def _(s, d):
    return r.evidence_in_scope(links(s, d), evidence(s, d).drop(INV)).select(INV, "evidence_id", "case_id")


@query(
    "j02_entities_in_scope",
    EVIDENCE + """, own AS (SELECT investigation_id, source_entity_id AS a, target_entity_id AS b FROM relationships WHERE evidence_id IS NOT NULL)
SELECT DISTINCT investigation_id, unnest([a, b, 4000000000 + a]) AS entity_id FROM own WHERE false UNION SELECT investigation_id, unnest([a, b]) FROM own UNION SELECT investigation_id, 4000000000 + case_id FROM ev""",
)
def _(s, d):
    first = evidence(s, d).groupBy("case_id").agg(F.min("evidence_id").alias("e"))
    e = m.entities(s, d).join(first.withColumn("id", F.lit(m.OFFSET["case"] * m.BILLION) + F.col("case_id")), "id", "left").withColumn("source_reference", F.concat(F.lit("evidence:"), F.col("e").cast("string")))
    return r.entities_in_scope(links(s, d), e, m.relationships(s, d))


@query("j03_relationships_in_scope", "SELECT investigation_id, id, relationship_type FROM relationships WHERE evidence_id IS NOT NULL")
def _(s, d):
    return r.relationships_in_scope(links(s, d), m.relationships(s, d)).select(INV, "id", "relationship_type")


@query(
    "j04_serialized",
    EVIDENCE + " SELECT r.id, r.relationship_type, a.value AS source_name, b.value AS target_name, ev.description AS evidence_description FROM relationships r LEFT JOIN entities a ON a.id = source_entity_id LEFT JOIN entities b ON b.id = target_entity_id LEFT JOIN ev USING (evidence_id)",
)
def _(s, d):
    return r.serialized_relationships(m.relationships(s, d), m.entities(s, d), evidence(s, d)).select("id", "relationship_type", "source_name", "target_name", "evidence_description")


def investigations(s, d):
    """One investigation a case, those of every fifth case twice."""
    key = F.col("o_orderkey")
    own = m.read(s, d, "orders").select(key.alias(INV), key.alias("case_id"), F.col("o_orderstatus").alias("s"))
    both = own.union(own.where("case_id % 5 = 0").withColumn(INV, F.col(INV) + m.BILLION))
    return both.select(INV, "case_id", F.when(F.col("s") == "F", "closed").otherwise("open").alias("status"))


INVESTIGATIONS = EVIDENCE + """, invs AS (SELECT investigation_id, case_id, CASE WHEN s = 'F' THEN 'closed' ELSE 'open' END AS status FROM (
  SELECT o_orderkey AS investigation_id, o_orderkey AS case_id, o_orderstatus AS s FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0))"""


def old_links(s, d):
    return evidence(s, d).where("case_id % 3 = 0").select(F.col("case_id").alias(INV), "evidence_id")


@query("j05_inherited", INVESTIGATIONS + " SELECT i.investigation_id, evidence_id, 'relevant' AS relevance FROM invs i JOIN ev USING (case_id) WHERE NOT (case_id % 3 = 0 AND i.investigation_id = case_id)")
def _(s, d):
    return r.inherited_evidence(investigations(s, d), evidence(s, d), old_links(s, d))


@query("j06_report_evidence", INVESTIGATIONS + " SELECT case_id AS investigation_id, evidence_id, CASE WHEN case_id % 3 = 0 THEN 'link' ELSE 'case' END AS via FROM ev WHERE case_id % 3 = 0 OR case_id % 5 > 0")
def _(s, d):
    return r.report_evidence(investigations(s, d), evidence(s, d), old_links(s, d))


@query("j07_touching", "SELECT DISTINCT e.id AS entity_id, r.id, relationship_type FROM entities e JOIN relationships r ON e.id = source_entity_id OR e.id = target_entity_id")
def _(s, d):
    return r.touching(m.relationships(s, d), m.entities(s, d))


@query("j08_canonical_ids", "SELECT e.id, c.canonical_id FROM entities e LEFT JOIN (SELECT normalized_value, min(id) AS canonical_id FROM entities GROUP BY ALL) c USING (normalized_value)")
def _(s, d):
    e = m.entities(s, d)
    return r.canonical_ids(e, e.select("id", "value")).select("id", "canonical_id")


@query(
    "j09_evidence_detail",
    EVIDENCE + """ SELECT evidence_id, coalesce(e.n, 0) AS entities, coalesce(x.n, 0) AS relationships FROM ev LEFT JOIN (SELECT evidence_id, count(*) AS n FROM relationships GROUP BY ALL) x USING (evidence_id)
LEFT JOIN (SELECT o_orderkey * 10 + 1 AS evidence_id, 1 AS n FROM orders) e USING (evidence_id)""",
)
def _(s, d):
    e = m.entities(s, d).withColumn("source_reference", F.when(F.col("entity_type") == "case", F.concat(F.lit("evidence:"), ((F.col("id") - m.OFFSET["case"] * m.BILLION) * 10 + 1).cast("string"))))
    return r.evidence_detail(evidence(s, d).select("evidence_id"), e, m.relationships(s, d))


# Search


@query("f01_entity_search", "SELECT id, entity_type, value FROM entities WHERE contains(lower(value), '00012') AND entity_type = 'person' ORDER BY id DESC LIMIT 50")
def _(s, d):
    return se.search(m.entities(s, d), ["value", "normalized_value", "entity_type"], "00012", limit=50, entity_type="person").select("id", "entity_type", "value")


@query("f02_evidence_search", EVIDENCE + " SELECT evidence_id, description, status FROM ev WHERE contains(lower(description), 'line 3') OR contains(status, 'line 3')")
def _(s, d):
    return se.search(evidence(s, d), ["description", "status", "kind"], "LINE 3", order="evidence_id").select("evidence_id", "description", "status")


@query("f03_page", EVIDENCE + " SELECT evidence_id, kind FROM ev WHERE status = 'processed' ORDER BY evidence_id DESC LIMIT 100 OFFSET 50")
def _(s, d):
    return se.page(evidence(s, d).where("status = 'processed'"), [F.desc("evidence_id")], 50, 100).select("evidence_id", "kind")


@query("f04_node_search", "SELECT node_id, value FROM nodes WHERE contains(normalized_value, 'case-1') AND entity_type = 'case'")
def _(s, d):
    return se.search(m.nodes(s, d), ["value", "normalized_value"], "case-1", order="node_id", entity_type="CASE").select("node_id", "value")


def memory(s, d):
    """Turns of conversations as memory entries."""
    kinds = F.array(*(F.lit(x) for x in rp.MEMORY_STATUS))
    c = m.read(s, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn") * 7 % 31)
    return c.select((F.col("conv_id") % 50).alias(INV), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.get(kinds, ((F.col("conv_id") + F.col("turn")) % 7).cast("int")).alias("type"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("title"), F.col("text").alias("content"), F.lit("chat").alias("source"), at.alias("created_at"))


MEMORY = "WITH mem AS (SELECT conv_id % 50 AS investigation_id, conv_id * 1000 + turn AS id, [" + ", ".join(f"'{x}'" for x in rp.MEMORY_STATUS) + "][(conv_id + turn) % 7 + 1] AS type, role || ' ' || turn AS title, text AS content, 'chat' AS source, 1700000000 + conv_id * 100 + turn * 7 % 31 AS secs FROM conversations)"


@query(
    "f05_memory_search",
    MEMORY + """, hit AS (SELECT *, CASE WHEN contains(lower(title), 'user 1') THEN 2 WHEN contains(lower(content), 'user 1') THEN 1 ELSE 0 END AS relevance FROM mem)
SELECT investigation_id, id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY relevance DESC, secs DESC, id DESC) AS n FROM hit WHERE relevance > 0) WHERE n <= 10""",
)
def _(s, d):
    return se.memory_search(memory(s, d), "User 1").select(INV, "id", "relevance")


@query("f06_memory_list", MEMORY + " SELECT investigation_id, id FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY secs DESC, id DESC) AS n FROM mem WHERE type IN ('finding', 'note')) WHERE n <= 50")
def _(s, d):
    return se.memory_list(memory(s, d), ["finding", "note"]).select(INV, "id")


def actions(s, d):
    """Events as actions."""
    e = F.col("event_id")
    pick = lambda words, key: F.get(F.array(*(F.lit(x) for x in words)), (key % len(words)).cast("int"))
    later = lambda days: F.col("ts") + F.make_interval(days=F.lit(days))
    return m.read(s, d, "events").select(
        (F.col("user_id") % 500).alias(INV), e.alias("id"), F.concat(F.lit("Check "), "event_type").alias("title"), pick(rp.ACTION_STATUSES, e).alias("status"), pick([*rp.PRIORITIES, "other"], F.floor(e / 3)).alias("priority"),
        F.col("ts").alias("created_at"), F.when(e % 2 == 0, later(1)).alias("started_at"), F.when(e % 5 == 3, later(2)).alias("completed_at"),
    )


def _pick(words, key):
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({key}) % {len(words)} + 1]"


ACTIONS = f"""act AS (SELECT user_id % 500 AS investigation_id, event_id AS id, 'Check ' || event_type AS title, {_pick(rp.ACTION_STATUSES, 'event_id')} AS status, {_pick([*rp.PRIORITIES, 'other'], 'event_id // 3')} AS priority,
  ts AS created_at, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 DAY END AS started_at, CASE WHEN event_id % 5 = 3 THEN ts + INTERVAL 2 DAY END AS completed_at FROM events)"""


@query("f07_action_list", f"WITH {ACTIONS} SELECT investigation_id, id, title, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END::BIGINT AS priority_rank FROM act")
def _(s, d):
    return se.action_list(actions(s, d)).select(INV, "id", "title", "priority_rank")


@query("f08_lookup", "SELECT node_id FROM nodes WHERE entity_type = 'location'")
def _(s, d):
    nodes = m.nodes(s, d)
    return se.lookup(nodes, nodes.where("entity_type = 'location'").select(F.upper("entity_type").alias("entity_type"), F.upper("normalized_value").alias("normalized_value"))).select("node_id")


UNIFIED = EVIDENCE + """, hits AS (SELECT 'entity' AS kind, id::VARCHAR AS id, value AS label FROM entities WHERE contains(lower(concat_ws(' ', id, value, entity_type)), '77')
  UNION ALL SELECT 'evidence', evidence_id::VARCHAR, description FROM ev WHERE contains(lower(concat_ws(' ', evidence_id, description)), '77'))"""


def _unified(s, d):
    e = m.entities(s, d).select("id", F.col("value").alias("label"), "entity_type")
    return se.unified({"entity": e, "evidence": evidence(s, d).select(F.col("evidence_id").alias("id"), F.col("description").alias("label"))}, "77")


@query("f09_unified", UNIFIED + " SELECT * FROM hits ORDER BY kind, id LIMIT 20")
def _(s, d):
    return se.unified_page(_unified(s, d))


@query("f09_unified_counts", UNIFIED + " SELECT kind, count(*) AS n FROM hits GROUP BY kind")
def _(s, d):
    return se.unified_counts(_unified(s, d))


# Reports

EVENTS = EVIDENCE + ", " + MEMORY[5:] + ", " + ACTIONS + """, evts AS (
  SELECT investigation_id, make_timestamp(secs * 1000000) AS event_at, 'memory:' || type AS kind, title, id::VARCHAR AS ref FROM mem
  UNION ALL SELECT investigation_id, coalesce(completed_at, started_at, created_at), 'action:' || status, title, id::VARCHAR FROM act
  UNION ALL SELECT investigation_id, collected_at, 'evidence', description, evidence_id::VARCHAR FROM ev)"""


def _events(s, d):
    return rp.timeline(memory(s, d), actions(s, d), evidence(s, d))


@query("d01_timeline", EVENTS + " SELECT investigation_id, floor(epoch(event_at))::BIGINT AS event_at, kind, title, ref FROM evts")
def _(s, d):
    return _events(s, d).withColumn("event_at", F.unix_timestamp("event_at"))


@query("d02_timeline_without_notes", EVENTS + " SELECT kind, count(*) AS n FROM evts WHERE kind NOT IN ('memory:note', 'memory:observation') GROUP BY kind")
def _(s, d):
    return rp.timeline_without_notes(_events(s, d)).groupBy("kind").agg(F.count("*").alias("n"))


FINDINGS = EVENTS + ", fnd AS (SELECT investigation_id, 'memory' AS origin, id::VARCHAR AS ref, content AS text FROM mem WHERE type = 'finding' UNION ALL SELECT investigation_id, 'evidence', evidence_id::VARCHAR, description FROM ev)"


@query("d03_findings", FINDINGS + " SELECT * FROM fnd")
def _(s, d):
    return rp.findings_table(memory(s, d), evidence(s, d))


OBSERVATIONS = "SELECT r.investigation_id, r.id, a.value || ' — ' || replace(relationship_type, '_', ' ') || ' — ' || b.value || '.' AS sentence FROM relationships r JOIN entities a ON a.id = source_entity_id JOIN entities b ON b.id = target_entity_id"


@query("d04_observations", OBSERVATIONS)
def _(s, d):
    return rp.relationship_observations(m.relationships(s, d), m.entities(s, d))


QUESTIONS = FINDINGS + """, qst AS (SELECT DISTINCT * FROM (SELECT investigation_id, 'Action ' || status || ': ' || title AS question FROM act WHERE status IN ('blocked', 'pending')
  UNION ALL SELECT investigation_id, rtrim(content) FROM mem WHERE rtrim(content) LIKE '%?' UNION ALL SELECT investigation_id, 'Evidence ' || evidence_id || ' is ' || status FROM ev WHERE status <> 'processed'))"""


@query("d05_unresolved", QUESTIONS + " SELECT * FROM qst")
def _(s, d):
    return rp.unresolved(actions(s, d), memory(s, d), evidence(s, d))


@query("d06_statuses", MEMORY + " SELECT id, CASE type " + " ".join(f"WHEN '{a}' THEN '{b_}'" for a, b_ in rp.MEMORY_STATUS.items()) + " END AS status FROM mem")
def _(s, d):
    return memory(s, d).select("id", rp.evidentiary_status(F.col("type")).alias("status"))


@query("d07_memory_counts", MEMORY + " SELECT investigation_id, " + ", ".join(f"count(*) FILTER (type = '{x}') AS {x}" for x in rp.MEMORY_STATUS) + " FROM mem GROUP BY investigation_id")
def _(s, d):
    return rp.memory_counts(memory(s, d))


@query(
    "d08_action_counts",
    f"WITH {ACTIONS} SELECT investigation_id, count(*) AS actions, " + ", ".join(f"count(*) FILTER ({c} = '{x}') AS {c}_{x}" for c, vs in (("status", rp.ACTION_STATUSES), ("priority", rp.PRIORITIES)) for x in vs) + " FROM act GROUP BY investigation_id",
)
def _(s, d):
    return rp.action_counts(actions(s, d))


@query("d09_intelligence_report")
def _(s, d):
    own = m.relationships(s, d)
    scope = own.where(f"{INV} is not null").select(INV, F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).distinct()
    risk = k.risk_rollup(scope, k.case_risk(m.nodes(s, d), m.edges(s, d)).withColumnRenamed("case_id", "node_id"))
    inv = m.read(s, d, "customer").select(F.col("c_custkey").alias(INV))
    return rp.intelligence_report(inv, evidence(s, d), scope, own.where("evidence_id is not null"), risk)


@query(
    "d10_documentary_report",
    QUESTIONS + f""", obs AS ({OBSERVATIONS}), n AS (SELECT c_custkey AS investigation_id, (SELECT count(*) FROM evts e WHERE e.investigation_id = c_custkey) AS events, (SELECT count(*) FROM fnd e WHERE e.investigation_id = c_custkey) AS findings,
  (SELECT count(*) FROM obs e WHERE e.investigation_id = c_custkey) AS observations, (SELECT count(*) FROM qst e WHERE e.investigation_id = c_custkey) AS questions FROM customer)
SELECT *, 'Record of investigation ' || investigation_id || ' with ' || events || ' events.' AS introduction, findings || ' findings, ' || observations || ' observed relationships, ' || questions || ' open questions.' AS conclusion FROM n""",
)
def _(s, d):
    inv = m.read(s, d, "customer").select(F.col("c_custkey").alias(INV))
    mem, act, ev = memory(s, d), actions(s, d), evidence(s, d)
    obs = rp.relationship_observations(m.relationships(s, d), m.entities(s, d))
    return rp.documentary_report(inv, _events(s, d), rp.findings_table(mem, ev), obs, rp.unresolved(act, mem, ev)).drop("first_event", "last_event")


@query(
    "d11_kpis",
    INVESTIGATIONS + """ SELECT 'cases_active' AS kpi, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders UNION ALL SELECT 'cases_completed', count(*) FILTER (o_orderstatus = 'F') FROM orders
UNION ALL SELECT 'evidence_documents', count(*) FILTER (kind = 'document') FROM ev UNION ALL SELECT 'evidence_images', count(*) FILTER (kind = 'image') FROM ev UNION ALL SELECT 'evidence_communications', 0 FROM (SELECT 1)
UNION ALL SELECT 'evidence_processed', count(*) FILTER (status = 'processed') FROM ev UNION ALL SELECT 'investigations_active', count(*) FILTER (status = 'open') FROM invs UNION ALL SELECT 'investigations_closed', count(*) FILTER (status = 'closed') FROM invs""",
)
def _(s, d):
    cases = m.read(s, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "F", "Closed").otherwise("held").alias("status"))
    return rp.kpis(cases, evidence(s, d), investigations(s, d))


@query("d12_investigation_counts", INVESTIGATIONS + " SELECT status, count(*) AS n FROM invs GROUP BY status")
def _(s, d):
    return rp.investigation_counts(investigations(s, d), "status")


@query("d13_mined_network")
def _(s, d):
    docs = m.case_texts(s, d)
    found = g.checkpointed(t.mentions(docs))
    return rp.mined_network(found, t.relations(docs, found))


def _pack(s, d):
    inv = m.read(s, d, "customer").select(F.col("c_custkey").alias(INV))
    rel = m.relationships(s, d)
    return rp.context_pack(inv, evidence(s, d).select(INV, F.col("evidence_id").alias("id")), memory(s, d).select(INV, "id"), actions(s, d).select(INV, "id"), rel.where(f"{INV} is not null").select(INV, "id"))


PACK = EVENTS + """, packed AS (SELECT c_custkey AS investigation_id, (SELECT count(*) FROM ev x WHERE x.investigation_id = c_custkey) AS evidence_count, (SELECT count(*) FROM mem x WHERE x.investigation_id = c_custkey) AS memory_count,
  (SELECT count(*) FROM act x WHERE x.investigation_id = c_custkey) AS actions_count, (SELECT count(*) FROM relationships x WHERE x.investigation_id = c_custkey) AS graph_count FROM customer)"""


@query(
    "d14_context_pack",
    PACK + """, cut AS (SELECT investigation_id, string_agg(id, ',' ORDER BY id) AS evidence_ids FROM (SELECT investigation_id, evidence_id::VARCHAR AS id, row_number() OVER (PARTITION BY investigation_id ORDER BY evidence_id::VARCHAR) AS n FROM ev) WHERE n <= 20 GROUP BY ALL)
SELECT packed.*, coalesce(evidence_ids, '') AS evidence_ids FROM packed LEFT JOIN cut USING (investigation_id)""",
)
def _(s, d):
    return _pack(s, d).drop("memory_ids", "actions_ids", "graph_ids")


@query("d15_context_gaps", PACK + " SELECT investigation_id, concat_ws(',', CASE WHEN evidence_count = 0 THEN 'no evidence' END, CASE WHEN graph_count = 0 THEN 'no graph' END, CASE WHEN memory_count = 0 THEN 'no memory' END, CASE WHEN actions_count = 0 THEN 'no actions' END) AS gaps FROM packed")
def _(s, d):
    return rp.context_gaps(_pack(s, d))


@query("k14_coverage_bands", PACK + " SELECT investigation_id, CASE WHEN evidence_count + memory_count + graph_count >= 10 THEN 'high' WHEN evidence_count + memory_count + graph_count >= 3 THEN 'moderate' ELSE 'low' END AS band FROM packed")
def _(s, d):
    return _pack(s, d).select(INV, k.coverage_band(F.col("evidence_count"), F.col("memory_count"), F.col("graph_count")).alias("band"))


@query(
    "k13_risk_rollup",
    graph_queries.SIGNALS + """, own AS (SELECT DISTINCT investigation_id, unnest([source_entity_id, target_entity_id]) AS entity_id FROM relationships WHERE investigation_id IS NOT NULL)
, sums AS (SELECT investigation_id, count(*) AS entities, coalesce(max(score), 0) AS max_score, sum(round(coalesce(score, 0) * 10000)::BIGINT)::BIGINT AS total FROM own LEFT JOIN risk ON node_id = entity_id GROUP BY investigation_id)
SELECT investigation_id, entities, max_score, (total // entities + CASE WHEN 2 * (total % entities) > entities OR (2 * (total % entities) = entities AND (total // entities) % 2 = 1) THEN 1 ELSE 0 END) / 10000 AS mean_score FROM sums""",
)
def _(s, d):
    own = b.ends(b.valid(m.relationships(s, d))).where(f"{INV} is not null").select(INV, F.col("x").alias("entity_id"))
    return k.risk_rollup(own, k.entity_risk(graph_queries.signals(s, d, for_score=True)))
