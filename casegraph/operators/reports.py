"""Reports, roll-ups and timelines (D1-D15), per investigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as g
from .resolve import serialized_relationships, top_per

INV = "investigation_id"
#: Kinds of memory entries, and what each may be taken for.
MEMORY_STATUS = {
    "finding": "reported finding", "observation": "observation", "hypothesis": "unverified hypothesis", "note": "investigator note", "decision": "decision", "question": "open question", "conversation": "conversation record",
}
ACTION_STATUSES = ["pending", "in_progress", "blocked", "completed", "cancelled"]
PRIORITIES = ["critical", "high", "medium", "low"]


def timeline(memory: DataFrame, actions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(investigation_id, event_at, kind, title, ref): one row per event. Sort by (investigation_id, event_at nulls last, kind, ref) to show it.

    An action's time is when it ended, else began, else was made.
    """
    parts = [
        memory.select(INV, F.col("created_at").alias("event_at"), F.concat(F.lit("memory:"), "type").alias("kind"), "title", F.col("id").cast("string").alias("ref")),
        actions.select(INV, F.coalesce("completed_at", "started_at", "created_at"), F.concat(F.lit("action:"), "status"), "title", F.col("id").cast("string")),
        evidence.select(INV, "collected_at", F.lit("evidence"), F.col("description"), F.col("evidence_id").cast("string")),
    ]
    return reduce(DataFrame.union, parts)


def timeline_without_notes(events: DataFrame) -> DataFrame:
    """D2."""
    return events.where("kind not in ('memory:note', 'memory:observation')")


def findings_table(memory: DataFrame, evidence: DataFrame) -> DataFrame:
    """D3: (investigation_id, origin, ref, text): memory findings and evidence descriptions."""
    of_memory = memory.where("type = 'finding'").select(INV, F.lit("memory").alias("origin"), F.col("id").cast("string").alias("ref"), F.coalesce("content", "title").alias("text"))
    return of_memory.union(evidence.select(INV, F.lit("evidence"), F.col("evidence_id").cast("string"), F.coalesce("description", F.lit("Evidence without a description"))))


def relationship_observations(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(investigation_id, id, sentence)."""
    kind = F.replace(F.lower("relationship_type"), F.lit("_"), F.lit(" "))
    name = lambda c: F.coalesce(c, F.lit("Unknown entity"))
    text = F.concat(name(F.col("source_name")), F.lit(" — "), kind, F.lit(" — "), name(F.col("target_name")), F.lit("."))
    return serialized_relationships(relationships, entities).select(INV, "id", text.alias("sentence"))


def unresolved(actions: DataFrame, memory: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct (investigation_id, question): blocked and pending actions, entries that end in "?", evidence that is not processed."""
    parts = [
        actions.where("status in ('blocked', 'pending')").select(INV, F.concat(F.lit("Action "), "status", F.lit(": "), "title").alias("question")),
        memory.where("rtrim(content) like '%?'").select(INV, F.rtrim("content")),
        evidence.where("status <> 'processed'").select(INV, F.concat(F.lit("Evidence "), F.col("evidence_id").cast("string"), F.lit(" is "), "status")),
    ]
    return reduce(DataFrame.union, parts).distinct()


def evidentiary_status(kind: Column) -> Column:
    """D6."""
    pairs = F.create_map(*(F.lit(x) for p in MEMORY_STATUS.items() for x in p))
    return F.coalesce(F.try_element_at(pairs, F.lower(kind)), F.lit("unclassified record"))


def _zero_filled(df: DataFrame, by: str, column: str, values: list[str], prefix: str = "") -> DataFrame:
    return df.groupBy(by).agg(*(F.count_if(F.lower(column) == v).alias(prefix + v) for v in values))


def memory_counts(memory: DataFrame) -> DataFrame:
    """D7."""
    return _zero_filled(memory, INV, "type", list(MEMORY_STATUS))


def action_counts(actions: DataFrame) -> DataFrame:
    """D8."""
    of = [F.count_if(F.lower(c) == v).alias(f"{c}_{v}") for c, vs in (("status", ACTION_STATUSES), ("priority", PRIORITIES)) for v in vs]
    return actions.groupBy(INV).agg(F.count("*").alias("actions"), *of)


def intelligence_report(investigations: DataFrame, evidence: DataFrame, scope: DataFrame, relationships: DataFrame, risk: DataFrame) -> DataFrame:
    """A row per investigation: counts, the scope's ids (sorted), the risk roll-up (entities, max_score, mean_score) and a summary.

    scope: (investigation_id, entity_id); relationships: (investigation_id, id).
    """
    ids = lambda df, c, name: df.select(INV, c).distinct().groupBy(INV).agg(F.sort_array(F.collect_list(c)).alias(name))
    none = F.expr("cast(array() as array<bigint>)")
    out = investigations.select(INV).distinct()
    names = ("evidence_ids", "entity_ids", "relationship_ids")
    for df, c, name in ((evidence, "evidence_id", names[0]), (scope, "entity_id", names[1]), (relationships, "id", names[2])):
        out = out.join(ids(df, c, name), INV, "left")
    out = out.join(risk.select(INV, "max_score", "mean_score"), INV, "left").withColumns({n: F.coalesce(n, none) for n in names})
    count = {n.replace("_ids", "_count"): F.size(n).cast("long") for n in names}
    text = F.concat(F.lit("The investigation holds "), F.size(names[0]).cast("string"), F.lit(" evidence records, "), F.size(names[1]).cast("string"), F.lit(" entities and "), F.size(names[2]).cast("string"), F.lit(" relationships."))
    limits = F.lit("Scores order work for review; they prove nothing about a person.")
    return out.withColumns(count).withColumns({"summary": text, "limitations": limits}).na.fill(0.0, ["max_score", "mean_score"])


def documentary_report(investigations: DataFrame, events: DataFrame, found: DataFrame, observations: DataFrame, open_questions: DataFrame) -> DataFrame:
    """A row per investigation: counts of events, findings, observations and open questions, an introduction and a conclusion."""
    out = investigations.select(INV).distinct()
    for df, name in ((events, "events"), (found, "findings"), (observations, "observations"), (open_questions, "questions")):
        out = out.join(df.groupBy(INV).agg(F.count("*").alias(name)), INV, "left")
    span = events.groupBy(INV).agg(F.min("event_at").alias("first_event"), F.max("event_at").alias("last_event"))
    out = out.join(span, INV, "left").na.fill(0, ["events", "findings", "observations", "questions"])
    n = lambda c: F.col(c).cast("string")
    intro = F.concat(F.lit("Record of investigation "), n(INV), F.lit(" with "), n("events"), F.lit(" events."))
    end = F.concat(n("findings"), F.lit(" findings, "), n("observations"), F.lit(" observed relationships, "), n("questions"), F.lit(" open questions."))
    return out.withColumns({"introduction": intro, "conclusion": end})


def kpis(cases: DataFrame, evidence: DataFrame, investigations: DataFrame) -> DataFrame:
    """(kpi, n): cases by state, evidence by kind, investigations by state."""
    rules = [
        (cases, {"cases_active": "lower(status) in ('open', 'active', 'in_progress')", "cases_completed": "lower(status) in ('closed', 'completed')"}),
        (evidence, {"evidence_documents": "lower(kind) = 'document'", "evidence_images": "lower(kind) = 'image'", "evidence_communications": "lower(kind) = 'communication'", "evidence_processed": "lower(status) = 'processed'"}),
        (investigations, {"investigations_active": "lower(status) in ('open', 'active', 'in_progress')", "investigations_closed": "lower(status) in ('closed', 'completed')"}),
    ]
    parts = []
    for df, of in rules:
        one = df.agg(*(F.count_if(F.expr(cond)).alias(name) for name, cond in of.items()))
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("kpi"), F.col(name).alias("n")) for name in of))).alias("r")).select("r.*"))
    return reduce(DataFrame.union, parts)


def investigation_counts(investigations: DataFrame, by: str) -> DataFrame:
    """By status, or by case."""
    return investigations.groupBy(by).agg(F.count("*").alias("n"))


def mined_network(found: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity_type, normalized_value, mentions, degree, rank, flag) of a text-mined network; HIGH-DEGREE from 2 distinct neighbours.

    The network's nodes are ranked by degree, then value; an entity without relations is in the inventory only and has no rank.
    """
    ends = relations.select(F.col("source_normalized").alias("src"), F.col("target_normalized").alias("dst"), F.col("relation_type").alias("rel_type"), "confidence")
    degree = g.symmetric(ends).select("node", "other").where("node <> other").distinct().groupBy("node").agg(F.count("*").alias("degree"))
    degree = g.numbered(degree, F.desc("degree"), "node").select("node", "degree", (F.col("n") + 1).alias("rank"))
    inventory = found.groupBy("entity_type", "normalized_value").agg(F.count("*").alias("mentions"))
    out = inventory.join(degree, F.col("normalized_value") == F.col("node"), "left").select("entity_type", "normalized_value", "mentions", F.coalesce("degree", F.lit(0)).alias("degree"), "rank")
    return out.withColumn("flag", F.when(F.col("degree") >= 2, "HIGH-DEGREE"))


def context_pack(investigations: DataFrame, evidence: DataFrame, memory: DataFrame, actions: DataFrame, graph_rows: DataFrame, cap: int = 20) -> DataFrame:
    """A row per investigation with up to `cap` ids of each part, and each part's whole count. Parts: (investigation_id, id)."""
    out = investigations.select(INV).distinct()
    for name, df in (("evidence", evidence), ("memory", memory), ("actions", actions), ("graph", graph_rows)):
        counts = df.groupBy(INV).agg(F.count("*").alias(f"{name}_count"))
        first = top_per(df.select(INV, F.col("id").cast("string").alias("id")).distinct(), INV, [F.col("id")], cap).groupBy(INV).agg(F.sort_array(F.collect_list("id")).alias(f"{name}_ids"))
        out = out.join(counts, INV, "left").join(first, INV, "left").na.fill(0, [f"{name}_count"]).withColumn(f"{name}_ids", F.coalesce(f"{name}_ids", F.array().cast("array<string>")))
    return out


def context_gaps(pack: DataFrame) -> DataFrame:
    """(investigation_id, gaps): which parts of a context pack are empty."""
    gaps = [F.when(F.col(f"{part}_count") == 0, F.lit(text)) for part, text in (("evidence", "no evidence"), ("graph", "no graph"), ("memory", "no memory"), ("actions", "no actions"))]
    return pack.select(INV, F.filter(F.array(*gaps), lambda x: x.isNotNull()).alias("gaps"))
