"""Search, listings and top-n (F1-F9). A limit is the feature here: a page of results, or the first n of each group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import top_per

PRIORITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def contains(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive substring in any of the columns; an empty text is in all rows."""
    out = F.lit(text == "")
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return out


def search(df: DataFrame, columns: Sequence[str], text: str, order: str = "id", limit: int | None = None, **equal: str | None) -> DataFrame:
    """matching rows, newest first; equal filters columns by lower-cased value."""
    found = df.where(contains(columns, text))
    for c, value in equal.items():
        if value is not None:
            found = found.where(F.lower(F.trim(F.col(c).cast("string"))) == value.lower())
    found = found.orderBy(F.desc(order))
    return found.limit(limit) if limit is not None else found


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """F3."""
    return df.orderBy(*order).offset(skip).limit(limit)


def memory_search(memory: DataFrame, text: str, top: int = 10) -> DataFrame:
    """per investigation the best entries: a hit in the title counts 2, elsewhere 1; newer first."""
    relevance = F.when(contains(["title"], text), 2).when(contains(["content", "source"], text), 1).otherwise(0)
    return top_per(memory.withColumn("relevance", relevance).where("relevance > 0"), "investigation_id", [F.desc("relevance"), F.desc("created_at"), F.desc("id")], top)


def memory_list(memory: DataFrame, types: Sequence[str] | None = None, top: int = 50) -> DataFrame:
    """per investigation the newest entries (of the types)."""
    own = memory if types is None else memory.where(F.col("type").isin(list(types)))
    return top_per(own, "investigation_id", [F.desc("created_at"), F.desc("id")], top)


def priority_rank(c: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for name, rank in PRIORITY.items():
        out = F.when(F.lower(c) == name, rank).otherwise(out)
    return out


def action_list(actions: DataFrame) -> DataFrame:
    """by investigation, priority and title."""
    return actions.withColumn("priority_rank", priority_rank(F.col("priority"))).orderBy("investigation_id", "priority_rank", F.lower("title"), "id")


def lookup(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """F8: nodes with one of the keys (entity_type, normalized_value)."""
    k = keys.select(F.lower("entity_type").alias("kt"), F.lower("normalized_value").alias("kv")).distinct()
    return nodes.join(k, (F.lower("entity_type") == F.col("kt")) & (F.lower("normalized_value") == F.col("kv")), "left_semi")


def unified(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """(kind, id, label) of rows whose text, all columns taken together, holds the text; each table has an id and a label."""
    parts = []
    for kind, df in tables.items():
        whole = F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns))
        parts.append(df.where(F.lower(whole).contains(text.lower())).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label")))
    return reduce(DataFrame.union, parts)


def unified_page(found: DataFrame, limit: int = 20) -> DataFrame:
    """the first rows."""
    return found.orderBy("kind", "id").limit(limit)


def unified_counts(found: DataFrame) -> DataFrame:
    """hits by kind."""
    return found.groupBy("kind").agg(F.count("*").alias("n"))
