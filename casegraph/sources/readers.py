"""Readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import blank_to_null

#: File name extension to MIME type.
MIME = {
    "txt": "text/plain", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def clean_records(df: DataFrame) -> DataFrame:
    """Names trimmed and columns without a name dropped; texts trimmed, blank ones null."""
    columns = [c for c in df.columns if c.strip().lstrip("﻿").strip()]
    kinds = dict(df.dtypes)
    return df.select(*((blank_to_null(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`")).alias(c.strip().lstrip("﻿").strip()) for c in columns))


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return clean_records(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A list of objects, {"records": [...]}, or one object, a row for each object."""
    df = spark.read.json(path, multiLine=True, schema=schema)
    if "records" in df.columns and isinstance(df.schema["records"].dataType, T.ArrayType):
        df = df.select(F.explode("records").alias("r")).select("r.*")
    return clean_records(df)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """S3: whole files with their number of characters and lines."""
    text = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), text.alias("text"), F.length(text).alias("n_chars"), F.size(F.split(text, "\r\n|\r|\n")).alias("n_lines"))


def file_registry(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, SHA-256 of the content and MIME type of each file."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    types = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.try_element_at(types, extension), F.lit("application/octet-stream")).alias("mime"))


def _merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    both = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "seq")]
    last = F.max_by(F.struct(*rest), F.struct("seq", *rest)).alias("v") if rest else F.max("seq").alias("v")
    return both.groupBy(*keys).agg(last).select(*keys, *(F.col(f"v.{c}") for c in rest))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (entity_type, normalized_value); new rows win, the largest of several."""
    return _merged(old, new, ["entity_type", "normalized_value"])


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (src, rel_type, dst)."""
    return _merged(old, new, ["src", "rel_type", "dst"])


def write_reports(df: DataFrame, path: str) -> None:
    """A JSON document a line, one per row."""
    df.write.mode("overwrite").json(path)
