"""Source records as a stream: the same normalisation, merged into the node and edge tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import readers, records


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """New JSON-lines files of a folder."""
    return spark.readStream.schema(schema).json(path)


def merge_edges_stream(raw: DataFrame, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Upserts the source's edges into versions of a Parquet table: table/v<batch>. A batch that runs again writes its version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = records.edges(records.typed(batch, source), source)
        old = new.limit(0) if number == 0 else spark.read.parquet(f"{table}/v{number - 1}")
        readers.merge_edges(old, new).write.mode("overwrite").parquet(f"{table}/v{number}")

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_windows(calls: DataFrame, late: str = "1 hour", window: str = "15 minutes") -> DataFrame:
    """Calls by caller and time window of typed call records; rows later than `late` behind the newest are left to the batch job."""
    return calls.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "caller_phone").agg(F.count("*").alias("calls"), F.sum("duration").alias("seconds"))
