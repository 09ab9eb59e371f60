"""The audit log as JSON lines: batch and streaming source, append-only sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = (
    "line_no bigint, request_id string, ts string, principal string, status string, original_sql string, executed_sql string, snapshot_hash string, "
    "verdicts array<struct<code: string, action: string, subject: string>>, subjects array<string>, row_count bigint, truncated boolean, latency_ms double, "
    "coalesced boolean, warehouse string, dataset_urns array<string>, denied boolean, column_reads map<string, array<string>>, ingested_at timestamp"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All lines that are valid records; others are skipped."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def tail(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The log as a stream of its new files."""
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def append(records: DataFrame, path: str) -> None:
    """Adds records as new files; existing ones are never touched."""
    records.write.mode("append").json(path)


def normalized(records: DataFrame) -> DataFrame:
    """Records with distinct, sorted subjects taken from the verdicts, and ``denied`` from the status."""
    named = F.filter(F.transform(F.coalesce("verdicts", F.array().cast(T.ArrayType(T.StructType.fromDDL("code string, action string, subject string")))), lambda v: v["subject"]), lambda s: s.isNotNull())
    return records.withColumn("subjects", F.array_sort(F.array_distinct(named))).withColumn("denied", F.coalesce(F.col("status").isin("denied", "error"), F.lit(False)))
