"""The audit log as a stream: sessions and daily usage kept up to date.

Each micro-batch goes through the same batch operators, so both modes give
the same rows. Late lines are never dropped: a session is merged wherever it
belongs, a day is emitted again as a whole. Sessions take lines to arrive in
the order of line_no: of one request the first seen holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgate.operators import usage
from quillgate.operators.sessions import SessionTable, audit_events
from quillgate.session import cut, scratch

NO_DAY = -1  # lines without a usable ts


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A Parquet table as a stream of its files; ``path`` may also be a single file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    path = f"{folder}/[{name[0]}]{name[1:]}"  # a pattern, as Spark's file streams take no plain file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sessions(stream: DataFrame, store: SessionTable, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into the session table. A batch run again changes nothing, as its events are known."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: store.merge(audit_events(df))).start()


def daily_usage(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``path``/days: daily usage per data set, partitioned by day.

    A micro-batch adds its lines to ``path``/lines by day and batch number (so
    a batch run again replaces its own) and their ids to ``path``/ids. Which
    line of a request holds is decided over all deliveries, as in the batch
    operators: the days that hold any line of one of the batch's requests are
    computed again from all their lines. A day left without usage is replaced
    by a row of no data set, which readers leave out.
    """
    columns = ["line_no", "request_id", "ts", "principal", "status", "original_sql", "executed_sql", "snapshot_hash", "denied", "dataset_urns", "column_reads"]

    def fold(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        day = F.coalesce((F.floor(usage.instant_us(F.col("ts")) / usage.DAY_US) * (usage.DAY_US // 1000)).cast("bigint"), F.lit(NO_DAY))
        rows = df.where("request_id IS NOT NULL").select(*columns, day.alias("day"), F.lit(batch).alias("batch"))
        replace = lambda x: x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replace(rows).partitionBy("day", "batch").parquet(f"{path}/lines")
        replace(rows.select("request_id", "line_no", "day", "batch")).partitionBy("batch").parquet(f"{path}/ids")
        ids = spark.read.schema("request_id string, line_no bigint, day bigint, batch int").parquet(f"{path}/ids")
        touched = ids.join(rows.select("request_id").distinct(), "request_id", "left_semi").select("day").distinct()
        touched = cut(touched.where(F.col("day") != NO_DAY), "touched")
        # A request's lines elsewhere matter too: the first of all must be the one of the day.
        first = ids.groupBy("request_id").agg(F.min("line_no").alias("line_no"))
        lines = spark.read.schema(rows.schema).parquet(f"{path}/lines").join(F.broadcast(touched), "day", "left_semi")  # a row per day
        tallies = usage.daily(lines.join(first, ["request_id", "line_no"], "left_semi").drop("day", "batch"))
        none = touched.select(F.lit(None).cast("string").alias("dataset_urn"), F.col("day").alias("bucket_ms"), F.lit(0).cast("bigint").alias("queries"), F.lit(0).cast("bigint").alias("unique_users"))
        replace(tallies.unionByName(none)).partitionBy("bucket_ms").parquet(f"{path}/days")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fold).start()


def run_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a Parquet log read as a stream to its present end."""
    store = SessionTable(spark, scratch(spark, "stream-sessions"))
    sessions(parquet_stream(spark, path), store, scratch(spark, "checkpoint")).awaitTermination()
    return store.sessions()


def run_daily_usage(spark: SparkSession, path: str) -> DataFrame:
    at = scratch(spark, "stream-usage")
    daily_usage(parquet_stream(spark, path), at, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("dataset_urn string, queries bigint, unique_users bigint, bucket_ms bigint").parquet(f"{at}/days").where("queries > 0")
