"""Entity resolution (R1-R10) and context joins."""

from __future__ import annotations

import functools
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as n
from . import graph as g


def _ratios(a: list[str], b: list[str]) -> list[float]:
    return [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """H2: the matching-blocks ratio of two texts; the order of the two matters."""
    return pd.Series(_ratios(a.tolist(), b.tolist()), dtype="float64")


@functools.lru_cache(maxsize=200_000)
def _token_ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@functools.lru_cache(maxsize=20_000)
def _matcher(y: str) -> SequenceMatcher:
    """A matcher that has read y; what it knows of y serves every x."""
    return SequenceMatcher(None, "", y)


def _similarity(x: str, y: str, threshold: float) -> float:
    """.6 * whole ratio + .4 * mean best token ratio of two normalised names; 0 if below the threshold or not safe.

    Safe: the least best token ratio is .65 or more, their mean .80 or more. Token ratios come first, as few names
    pass them; the whole ratio is only worked out where its upper bound can still reach the threshold.
    """
    if x == y:
        return 1.0
    best = [max(_token_ratio(s, t) for t in y.split()) for s in x.split()]
    mean = sum(best) / len(best)
    if min(best) < 0.65 or mean < 0.80:
        return 0.0
    whole = _matcher(y)
    whole.set_seq1(x)
    if 0.6 * whole.quick_ratio() + 0.4 * mean < threshold:
        return 0.0
    score = 0.6 * whole.ratio() + 0.4 * mean
    return score if score >= threshold else 0.0


@F.pandas_udf(T.DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two tokens, remembered."""
    return pd.Series([_token_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def name_similarity(threshold: float):
    """H2: _similarity of two columns, a batch at a time."""

    @F.pandas_udf(T.DoubleType())
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_similarity(a, b, threshold) for a, b in zip(x, y)], dtype="float64")

    return scored


def resolved_entities(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per (entity_type, key): value and source of the first mention (source, start), largest confidence, mentions, reused.

    mentions: source_reference, entity_type, value, normalized_value, start, confidence.
    """
    kind, key = n.map_entity_type(F.col("entity_type")), F.lower(F.trim("normalized_value"))
    first = F.min_by(F.struct("value", "source_reference"), F.struct("source_reference", "start", "value")).alias("f")
    found = mentions.select("*", kind.alias("k"), key.alias("key")).where("key <> ''").groupBy(F.col("k").alias("entity_type"), "key").agg(first, F.max("confidence").alias("confidence"), F.count("*").alias("mentions"))
    found = found.select("entity_type", "key", "f.value", "f.source_reference", "confidence", "mentions")
    if existing is None:
        return found.withColumn("reused", F.lit(False))
    known = existing.select(F.col("entity_type").alias("et"), F.lower(F.trim("normalized_value")).alias("ek")).distinct()
    return found.join(known, (F.col("entity_type") == F.col("et")) & (F.col("key") == F.col("ek")), "left").withColumn("reused", F.col("ek").isNotNull()).drop("et", "ek")


#: Least ratio of a token with its best partner. Tokens whose block has over BLOCK_PAIRS pairs of names bring names together only with a
#: partner of another token.
LEAST_TOKEN, BLOCK_PAIRS = 0.65, 10_000


def _names(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Distinct normalised names of a type with their tokens and smallest id: equal names are compared once."""
    found = df.select(F.col("entity_type").alias("kind"), n.normalize_company_tokens(F.col("name")).alias(text), id_).where(F.col(text) != "")
    return found.groupBy("kind", text).agg(F.min(id_).alias(id_)).withColumn("words", F.split(text, " ")).withColumn("tokens", F.size("words"))


def _needed(a: Column, b: Column) -> tuple[Column, Column]:
    """Of two tokens' lengths: the characters that must match for a ratio of LEAST_TOKEN, and the gapped pairs that they must share.

    A ratio counts characters in equal order. Of two matched neighbours with at most one character skipped on either side both
    tokens hold the same gapped pair; each two skipped characters of a token spoil one such pair at most.
    """
    chars = F.ceil((a + b) * LEAST_TOKEN / 2 - 1e-9)
    spoilt = lambda length: F.floor((length - chars) / 2)
    return chars, chars - 1 - spoilt(a) - spoilt(b)


def _grams(df: DataFrame, token: str) -> DataFrame:
    """Of each token its length, and each gapped pair (2..) and character (1..) with the number of times that it is there."""
    at = lambda i, k: F.substring(F.col(token), i, k)
    places = F.sequence(F.lit(1), F.length(token))
    near = F.transform(F.filter(places, lambda i: i < F.length(token)), lambda i: F.concat(F.lit("2"), at(i, F.lit(2))))
    far = F.transform(F.filter(places, lambda i: i + 1 < F.length(token)), lambda i: F.concat(F.lit("2"), at(i, F.lit(1)), at(i + 2, F.lit(1))))
    alone = F.transform(places, lambda i: F.concat(F.lit("1"), at(i, F.lit(1))))
    return df.select(token, F.length(token).alias(f"{token}_len"), F.explode(F.concat(near, far, alone)).alias("gram")).groupBy(token, f"{token}_len", "gram").agg(F.count("*").alias(f"{token}_n"))


def similar_tokens(some: DataFrame, others: DataFrame) -> DataFrame:
    """(s, t, ratio): tokens of `some` and `others` with a matching-blocks ratio of LEAST_TOKEN or more; none is lost.

    Tokens meet in what they must share: gapped pairs, or characters where a pair so short need share none. Only counted
    candidates are compared. The candidates grow with the square of the distinct tokens of like letters, not with that of the names.
    """
    chars, pairs = _needed(F.col("s_len"), F.col("t_len"))
    met = _grams(some, "s").join(_grams(others, "t"), "gram").where(F.least("s_len", "t_len") >= chars)
    met = met.where(F.substring("gram", 1, 1) == F.when(pairs >= 1, "2").otherwise("1"))
    found = met.groupBy("s", "t", "s_len", "t_len").agg(F.sum(F.least("s_n", "t_n")).alias("shared"))
    found = found.where(F.col("shared") >= F.when(pairs >= 1, pairs).otherwise(chars))
    return found.select("s", "t", token_ratio("s", "t").alias("ratio")).where(F.col("ratio") >= LEAST_TOKEN)


def name_pairs(new: DataFrame, existing: DataFrame, threshold: float = 0.84, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(kind, x, y, score): distinct normalised names of new (kind, x, words, tokens) and of existing (y) of one type that match.

    A match needs equal token counts, an exact token in common and a partner of ratio .65 or more for each of x's tokens. Names meet in
    (type, token count, exact token). A common token, such as a legal form, doesn't bring all its names together: there they
    meet in (token, partner of x's rarest other token). That token needs a partner, so no match is lost.
    """
    side = lambda df, text: df.select("kind", "tokens", text, "words", F.explode(F.array_distinct("words")).alias("token"))
    left, right = side(new, "x"), side(existing, "y")
    by = ["kind", "tokens", "token"]
    sizes = left.groupBy(by).agg(F.count("*").alias("nx")).join(right.groupBy(by).agg(F.count("*").alias("ny")), by)
    common = sizes.where(F.col("nx") * F.col("ny") > block_pairs).select(by)
    few = left.join(common, by, "left_anti").join(right, by).select("kind", "x", "y")
    # x's other tokens: its words without one place of the common token. The one that the fewest of y's names have, and of these the longest.
    at = F.array_position("words", F.col("token"))
    others = F.filter("words", lambda w, i: i + 1 != at)
    times = left.join(sizes, by).groupBy("kind", "x").agg(F.map_from_entries(F.collect_list(F.struct("token", "ny"))).alias("times"))
    weight = lambda w: F.struct(F.coalesce(F.try_element_at("times", w), F.lit(0)).alias("ny"), (-F.length(w)).alias("n"), w.alias("w"))
    chosen = F.array_min(F.transform(others, weight))["w"]
    hard = left.join(common, by).join(times, ["kind", "x"]).select(*by, "x", chosen.alias("s")).where("s is not null")
    behind = right.join(common, by).select(*by, "y", F.explode(F.array_distinct("words")).alias("t"))
    partners = similar_tokens(hard.select("s").distinct(), behind.select("t").distinct())
    many = hard.join(partners, "s").join(behind, [*by, "t"]).select("kind", "x", "y")
    same = new.join(existing.select("kind", F.col("y").alias("x")), ["kind", "x"]).select("kind", "x", F.col("x").alias("y"))
    near = few.union(many).distinct().where("x <> y").where(2 * F.least(F.length("x"), F.length("y")) * 0.6 >= (threshold - 0.4) * (F.length("x") + F.length("y")))
    # A pair is a few bytes and much work: partitions by number, as their bytes would have a few tasks do all.
    session = new.sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    scored = near.repartition(tasks, "kind", "x", "y").withColumn("score", name_similarity(threshold)("x", "y")).where(F.col("score") >= threshold)
    return scored.union(same.withColumn("score", F.lit(1.0)))


def fuzzy_matches(new: DataFrame, existing: DataFrame, threshold: float = 0.84, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """R2: (new_id, existing_id, score): the best match of each new name within its type; of equal ones the smallest id.

    new: new_id, entity_type, name; existing: existing_id, entity_type, name. Each distinct name is matched once.
    """
    known = _names(existing, "existing_id", "y")
    pairs = name_pairs(_names(new, "new_id", "x"), known, threshold, block_pairs).join(known.select("kind", "y", "existing_id"), ["kind", "y"])
    best = pairs.groupBy("kind", "x").agg(F.max_by("existing_id", F.struct("score", -F.col("existing_id"))).alias("existing_id"), F.max("score").alias("score"))
    rows = new.select("new_id", F.col("entity_type").alias("kind"), n.normalize_company_tokens(F.col("name")).alias("x"))
    return rows.join(best, ["kind", "x"]).select("new_id", "existing_id", F.bround("score", 6).alias("score"))


def merged_names(new: DataFrame, threshold: float = 0.84, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """R1, R2 among new names: (new_id, entity_id, names): entity_id is the smallest new_id of the names that belong together, names their
    number of distinct spellings.

    new: new_id (in the order of arrival), entity_type, name. One-at-a-time upserts compare a name with the entities made so far and
    give it to the best. Here two names are linked if the later one matches the earlier one, and an entity is a connected component of
    links with its earliest name as representative. Differences: a name that matches two earlier entities joins them, and
    a name also joins through a spelling that was itself merged, not only through the representative's. A name that matches one
    entity's first spelling alone gets the same entity in both forms. Names of no letter or digit have no row.
    """
    names = _names(new, "new_id", "x")
    other = names.withColumnRenamed("x", "y")
    of = lambda c, as_: names.select("kind", F.col("x").alias(c), F.col("new_id").alias(as_))
    pairs = name_pairs(names, other, threshold, block_pairs).where("x <> y")
    links = pairs.join(of("x", "b"), ["kind", "x"]).join(of("y", "a"), ["kind", "y"]).where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = g.components(names.select(F.col("new_id").alias("node_id")), links).select(F.col("node_id").alias("new_id"), F.col("component").alias("entity_id"))
    rows = names.select("kind", "x", "new_id").join(found, "new_id").drop("new_id")
    sizes = rows.groupBy("entity_id").agg(F.count("*").alias("names"))
    texts = new.select("new_id", F.col("entity_type").alias("kind"), n.normalize_company_tokens(F.col("name")).alias("x"))
    return texts.join(rows.join(sizes, "entity_id"), ["kind", "x"]).select("new_id", "entity_id", "names")


def gazetteer_matches(mentions: DataFrame, known: DataFrame, accept: float = 0.85) -> DataFrame:
    """(mention_id, entity_id, score): scores of each mention with known entities of its type, best alias each.

    mentions: mention_id, entity_type, value; known: entity_id, entity_type, value, aliases. 1.0 exact, 0.98 but for case, 0.96
    normalised; else the ratio of the normalised forms from `accept` on. A ratio r needs lengths with 2 * min / (a + b)
    >= r, so the fuzzy part meets by type and a band of length; both neighbouring bands are tried.
    """
    names = known.select("entity_id", F.lower("entity_type").alias("kind"), F.explode(F.array_distinct(F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name")).where("name is not null")
    names = names.withColumn("name_norm", n.normalize_for_linking(F.col("kind"), F.col("name")))
    m = mentions.select("mention_id", F.lower("entity_type").alias("kind"), "value").withColumn("norm", n.normalize_for_linking(F.col("kind"), F.col("value")))
    score = F.when(F.col("value") == F.col("name"), 1.0).when(F.lower("value") == F.lower("name"), 0.98).otherwise(0.96)
    same = m.join(names, (m["kind"] == names["kind"]) & (m["norm"] == names["name_norm"]) & (m["norm"] != "")).select("mention_id", "entity_id", score.alias("score"))
    # Bands grow by the factor that the ratio allows, so a pair is at most one band apart.
    band = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / F.log(F.lit((2 - accept) / accept))).cast("int")
    rest = m.join(same.select("mention_id").distinct(), "mention_id", "left_anti").where("norm <> ''").withColumn("band", F.explode(F.array(band("norm") - 1, band("norm"), band("norm") + 1)))
    near = rest.join(names.where("name_norm <> ''").withColumn("band", band("name_norm")), ["kind", "band"]).where(2 * F.least(F.length("norm"), F.length("name_norm")) >= accept * (F.length("norm") + F.length("name_norm")))
    fuzzy = near.select("mention_id", "entity_id", sequence_ratio("norm", "name_norm").alias("score")).where(F.col("score") >= accept)
    return same.union(fuzzy).groupBy("mention_id", "entity_id").agg(F.bround(F.max("score"), 6).alias("score"))


def linked(matches: DataFrame, least: float = 0.90, margin: float = 0.05) -> DataFrame:
    """(mention_id, entity_id, score, ambiguous, linked): the best match; ambiguous if the second is within the margin."""
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    ranked = matches.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("rank = 1")
    ambiguous = (F.col("score") >= least) & (F.coalesce(F.col("score") - F.col("second") <= margin + 1e-9, F.lit(False)))
    return ranked.select("mention_id", "entity_id", "score", ambiguous.alias("ambiguous"), ((F.col("score") >= least) & ~ambiguous).alias("linked"))


def resolved_relationships(relations: DataFrame) -> DataFrame:
    """One row per (source, target, type): largest confidence, first evidence, raw type kept. No loops.

    relations: source_entity_id, target_entity_id, relation_type, confidence, evidence_id.
    """
    kind = n.map_relationship_type(F.col("relation_type"))
    found = relations.where("source_entity_id is not null and target_entity_id is not null and source_entity_id <> target_entity_id")
    return found.groupBy("source_entity_id", "target_entity_id", kind.alias("relationship_type")).agg(F.max("confidence").alias("confidence"), F.min("evidence_id").alias("evidence_id"), F.min("relation_type").alias("raw_relation_type"))


def case_links(pairs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct (case_id, entity_id, relation) from (case_id, entity_id, entity_type), without existing ones."""
    found = pairs.select("case_id", "entity_id", n.map_case_relation(F.col("entity_type")).alias("relation")).distinct()
    return found if existing is None else found.join(existing, ["case_id", "entity_id", "relation"], "left_anti")


def ingestion_summary(rows: DataFrame) -> DataFrame:
    """Created and reused by evidence and kind; rows: evidence_id, kind, reused."""
    return rows.groupBy("evidence_id", "kind").agg(F.count_if(~F.col("reused")).alias("created"), F.count_if("reused").alias("reused"))


def graph_projection(cases: DataFrame, entities: DataFrame, links: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (entity_type, normalized_value, value) and edges (src, dst, rel_type, confidence); keys are type|value in lower case."""
    key = lambda kind, value: F.concat_ws("|", F.lower(kind), F.lower(F.trim(value)))
    own = entities.select("id", F.lower("entity_type").alias("entity_type"), F.lower(F.trim("normalized_value")).alias("normalized_value"), "value")
    of_case = cases.select(F.lit("case").alias("entity_type"), F.lower("case_number").alias("normalized_value"), F.col("case_number").alias("value"))
    nodes = of_case.union(own.select("entity_type", "normalized_value", "value")).groupBy("entity_type", "normalized_value").agg(F.min("value").alias("value"))
    keyed = own.select("id", key("entity_type", "normalized_value").alias("k"))
    left = links.join(cases.select("case_id", key(F.lit("case"), "case_number").alias("src")), "case_id").join(keyed.select(F.col("id").alias("entity_id"), F.col("k").alias("dst")), "entity_id")
    case_edges = left.select("src", "dst", F.upper("relation").alias("rel_type"), F.lit(1.0).alias("confidence"))
    s, t = keyed.select(F.col("id").alias("source_entity_id"), F.col("k").alias("src")), keyed.select(F.col("id").alias("target_entity_id"), F.col("k").alias("dst"))
    rel_edges = relationships.join(s, "source_entity_id").join(t, "target_entity_id").select("src", "dst", n.sanitize_relation_type(F.col("relationship_type")).alias("rel_type"), "confidence")
    edges = case_edges.union(rel_edges).where("rel_type is not null").groupBy("src", "dst", "rel_type").agg(F.max("confidence").alias("confidence"))
    return nodes, edges


def acceptable_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Not deleted, no loop, both ends exist and are not deleted; of equal triples the smallest id."""
    live = entities.where("deleted_at is null").select("id")
    ok = relationships.where("deleted_at is null and source_entity_id <> target_entity_id")
    for end in ("source_entity_id", "target_entity_id"):
        ok = ok.join(live.select(F.col("id").alias(end)), end, "left_semi")
    least = ok.groupBy("source_entity_id", "target_entity_id", "relationship_type").agg(F.min("id").alias("id")).select("id")
    return ok.join(least, "id", "left_semi")


node_removal = g.node_removal  # R10


def top_per(df: DataFrame, by: str | list[str], order: list[Column], top: int) -> DataFrame:
    """The first rows of each group; Spark cuts every task's share to `top` before the shuffle."""
    by = [by] if isinstance(by, str) else by
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top).drop("rank")


def evidence_in_scope(links: DataFrame, evidence: DataFrame, per_investigation: int = 500) -> DataFrame:
    """Evidence of each investigation, newest ids first, at most per_investigation."""
    return top_per(links.select("investigation_id", "evidence_id").distinct().join(evidence, "evidence_id"), "investigation_id", [F.desc("evidence_id")], per_investigation)


def relationships_in_scope(links: DataFrame, relationships: DataFrame) -> DataFrame:
    """(investigation_id, relationship columns) whose evidence is linked to the investigation."""
    return links.select("investigation_id", "evidence_id").distinct().join(relationships.drop("investigation_id"), "evidence_id")


def entities_in_scope(links: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Distinct (investigation_id, entity_id): entities whose source is linked evidence, and ends of relationships in scope."""
    source = entities.select(F.col("id").alias("entity_id"), F.regexp_extract("source_reference", r"^evidence:(\d+)$", 1).try_cast("long").alias("evidence_id")).where("evidence_id is not null")
    own = links.select("investigation_id", "evidence_id").distinct().join(source, "evidence_id").select("investigation_id", "entity_id")
    ends = relationships_in_scope(links, relationships).select("investigation_id", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
    return own.union(ends).distinct()


def serialized_relationships(relationships: DataFrame, entities: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Relationships with both ends' names (and evidence description)."""
    name = lambda end: entities.select(F.col("id").alias(f"{end}_entity_id"), F.col("value").alias(f"{end}_name"))
    out = relationships.join(name("source"), "source_entity_id", "left").join(name("target"), "target_entity_id", "left")
    return out if evidence is None else out.join(evidence.select("evidence_id", F.col("description").alias("evidence_description")), "evidence_id", "left")


def inherited_evidence(investigations: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """New links (investigation_id, evidence_id, relevance) of each investigation to its case's evidence."""
    found = investigations.select("investigation_id", "case_id").join(evidence.select("case_id", "evidence_id"), "case_id").select("investigation_id", "evidence_id").distinct()
    return found.join(links, ["investigation_id", "evidence_id"], "left_anti").withColumn("relevance", F.lit("relevant"))


def report_evidence(investigations: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Linked evidence; for an investigation that is its case's only one and has no link, the case's evidence."""
    single = investigations.groupBy("case_id").agg(F.count("*").alias("n"), F.min("investigation_id").alias("investigation_id")).where("n = 1")
    bare = single.join(links.select("investigation_id").distinct(), "investigation_id", "left_anti")
    fallback = bare.join(evidence.select("case_id", "evidence_id"), "case_id").select("investigation_id", "evidence_id", F.lit("case").alias("via"))
    return links.select("investigation_id", "evidence_id", F.lit("link").alias("via")).distinct().union(fallback)


def touching(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, id, relationship_type) of relationships with the entity at either end; a loop once."""
    ends = relationships.select("id", "relationship_type", F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("entity_id"))
    return entities.select(F.col("id").alias("entity_id")).join(ends, "entity_id")


def canonical_ids(rows: DataFrame, entities: DataFrame, name: str = "value") -> DataFrame:
    """Rows with the smallest id of the entities of that name."""
    ids = entities.groupBy(F.lower(F.trim("value")).alias("k")).agg(F.min("id").alias("canonical_id"))
    return rows.join(ids, F.lower(F.trim(name)) == F.col("k"), "left").drop("k")


def evidence_detail(evidence: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """evidence_id, entities and relationships (counts)."""
    source = entities.select(F.regexp_extract("source_reference", r"^evidence:(\d+)$", 1).try_cast("long").alias("evidence_id")).groupBy("evidence_id").agg(F.count("*").alias("entities"))
    rel = relationships.groupBy("evidence_id").agg(F.count("*").alias("relationships"))
    out = evidence.select("evidence_id").join(source, "evidence_id", "left").join(rel, "evidence_id", "left")
    return out.na.fill(0, ["entities", "relationships"])
