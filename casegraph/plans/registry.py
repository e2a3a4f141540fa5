"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapters import MODEL_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _plain(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.IntegerType):
        c = c.cast("long")
    elif isinstance(kind, T.ArrayType):
        c = F.array_join(c.cast("array<string>"), ",")
    elif isinstance(kind, T.MapType):
        c = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return c.alias(name)


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, lists and maps as text, so that results can be held against another engine's."""
    return df.select(*(_plain(f.name, f.dataType) for f in df.schema.fields))


def query(name: str, sql: str | None = None, model: bool = True):
    """Registers a query. sql may use the views of MODEL_SQL, or have WITH parts of its own before `SELECT`."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            sql_ = sql.strip()
            ORACLE_SQL[name] = f"WITH RECURSIVE {MODEL_SQL}{', ' + sql_[5:] if sql_.startswith('WITH ') else sql_}" if model else sql_
        return f

    return register
