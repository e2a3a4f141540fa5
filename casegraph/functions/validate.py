"""Validation (V1-V11): issues as an array column, an issues table, and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import parse_datetime_multi

PHONE = r"^\+?[0-9][0-9\s\-().]{5,20}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def _issue(when: Column, field: str, message: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))


def valid_latitude(c: Column) -> Column:
    """V6; null for a missing or unreadable number."""
    return c.try_cast("double").between(-90, 90)


def valid_longitude(c: Column) -> Column:
    """V6."""
    return c.try_cast("double").between(-180, 180)


def valid_gps_pair(latitude: Column, longitude: Column) -> Column:
    """V7: both are set and in range."""
    return F.coalesce(valid_latitude(latitude) & valid_longitude(longitude), F.lit(False))


def issues(columns: Sequence[str], required: Sequence[str] = (), phones: Sequence[str] = (), emails: Sequence[str] = (), dates: Sequence[str] = (), latitude: str | None = None, longitude: str | None = None) -> Column:
    """V1-V7: array of (field, message, severity) of a row; empty if it is fine."""
    found = [_issue(_all_blank(columns), "record", "empty record", "error")]
    found += [_issue(_blank(c), c, "required field is missing", "error") for c in required]
    found += [_issue(~_blank(c) & ~F.trim(F.col(c)).rlike(PHONE), c, "unusual phone format", "warning") for c in phones]
    found += [_issue(~_blank(c) & ~F.trim(F.col(c)).rlike(EMAIL), c, "unusual email format", "warning") for c in emails]
    found += [_issue(~_blank(c) & parse_datetime_multi(F.col(c)).isNull(), c, "unrecognised date", "warning") for c in dates]
    for c, ok in ((latitude, valid_latitude), (longitude, valid_longitude)):
        if c:
            found.append(_issue(~_blank(c) & ~F.coalesce(ok(F.col(c)), F.lit(False)), c, "coordinate out of range", "error"))
    if latitude and longitude:
        either = ~_blank(latitude) | ~_blank(longitude)
        found.append(_issue(either & ~valid_gps_pair(F.col(latitude), F.col(longitude)), "gps", "coordinate pair is not usable", "warning"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _all_blank(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & _blank(c)
    return out


def issue_table(df: DataFrame, index: str, issue_col: str = "issues") -> DataFrame:
    """V8: one row per issue."""
    return df.select(F.col(index).alias("record_index"), F.explode(issue_col).alias("i")).select("record_index", "i.*")


def is_valid(issue_col: str = "issues") -> Column:
    """V9: no issue is an error."""
    return ~F.exists(issue_col, lambda i: i["severity"] == "error")


def totals(df: DataFrame, issue_col: str = "issues") -> DataFrame:
    """V9: one row of counts."""
    of = lambda s: F.sum(F.size(F.filter(issue_col, lambda i: i["severity"] == s))).cast("long")
    return df.agg(
        F.count_if(is_valid(issue_col)).alias("valid"), F.count_if(~is_valid(issue_col)).alias("invalid"),
        F.coalesce(of("error"), F.lit(0)).alias("errors"), F.coalesce(of("warning"), F.lit(0)).alias("warnings"),
    )


def missing_fields(required: Sequence[str], any_of: Sequence[Sequence[str]] = ()) -> Column:
    """Names of recommended fields that are blank, and of groups (a|b) without any field."""
    one = [F.when(_blank(c), F.lit(c)) for c in required]
    group = [F.when(_all_blank(g), F.lit("|".join(g))) for g in any_of]
    return F.filter(F.array(*one, *group), lambda x: x.isNotNull())


def ingestion_summary(df: DataFrame, source: str, issue_col: str = "issues") -> DataFrame:
    """Received, processed and rejected rows by source."""
    return df.groupBy(source).agg(F.count("*").alias("received"), F.count_if(is_valid(issue_col)).alias("processed"), F.count_if(~is_valid(issue_col)).alias("rejected"))
