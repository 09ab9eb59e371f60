"""Usage and audit analytics over the audit log.

A request is counted once: of the lines with one request_id the first to
arrive holds. Requests without a usable ts belong to no day, and denied ones,
which read nothing, are no usage. All are aggregates
with map-side combining; distinct users and statements go through a second
grouping instead of collecting a day's values in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgate.functions.columns import instant_us
from quillgate.operators.ordered import DAY_US

TOP_SQL, SQL_CHARS, LEDGER = 5, 2000, 50


def requests(audit: DataFrame) -> DataFrame:
    """First line of every request: line_no, at_us, day, principal, status, statement, denied, dataset_urns, reads, snapshot_hash.

    One scan and one aggregate: the line's fields travel as a struct, whose
    first by line_no is kept before the shuffle too.
    """
    line = F.struct("ts", "principal", "status", F.coalesce("executed_sql", "original_sql").alias("statement"), "denied", "snapshot_hash", "dataset_urns", F.map_entries("column_reads").alias("reads"))
    first = audit.where("request_id IS NOT NULL").groupBy("request_id").agg(F.min("line_no").alias("line_no"), F.min_by(line, "line_no").alias("v"))
    rows = first.select(
        "request_id", "line_no", instant_us(F.col("v.ts")).alias("at_us"), F.lower(F.trim("v.principal")).alias("principal"), "v.status", "v.statement",
        F.coalesce("v.denied", F.lit(False)).alias("denied"), "v.snapshot_hash",
        F.array_distinct(F.filter(F.coalesce("v.dataset_urns", F.array()), lambda u: u.isNotNull())).alias("dataset_urns"),
        F.coalesce("v.reads", F.array()).alias("reads"),
    )
    return rows.withColumn("day", (F.floor(F.col("at_us") / DAY_US) * (DAY_US // 1000)).cast("bigint"))


def reads(audit: DataFrame) -> DataFrame:
    """dataset_urn, bucket_ms (day, null without a usable ts), line_no, principal, denied, statement, columns of each data set a request read."""
    return (
        requests(audit)
        .select("day", "line_no", "principal", "denied", "statement", F.explode("reads").alias("r"))
        .select(F.col("r.key").alias("dataset_urn"), F.col("day").alias("bucket_ms"), "line_no", "principal", "denied", "statement", F.array_distinct(F.transform("r.value", F.lower)).alias("columns"))
    )


def reads_by_day(audit: DataFrame) -> DataFrame:
    """The reads that count as usage of a day: those with a usable ts of requests that were not denied."""
    return reads(audit).where("bucket_ms IS NOT NULL AND NOT denied")


def daily(audit: DataFrame) -> DataFrame:
    """dataset_urn, bucket_ms, queries, unique_users."""
    users = reads_by_day(audit).groupBy("dataset_urn", "bucket_ms", "principal").agg(F.count("*").alias("n"))
    return users.groupBy("dataset_urn", "bucket_ms").agg(F.sum("n").alias("queries"), F.count("principal").alias("unique_users"))


def by_principal(audit: DataFrame) -> DataFrame:
    return reads_by_day(audit).where("principal IS NOT NULL").groupBy("dataset_urn", "bucket_ms", "principal").agg(F.count("*").alias("queries"))


def by_column(audit: DataFrame) -> DataFrame:
    flat = reads_by_day(audit).select("dataset_urn", "bucket_ms", F.explode("columns").alias("column"))
    return flat.where("column IS NOT NULL").groupBy("dataset_urn", "bucket_ms", "column").agg(F.count("*").alias("queries"))


def top_sql(audit: DataFrame, top: int = TOP_SQL) -> DataFrame:
    """The most frequent statements of each data set and day; ties go to the one seen first.

    Statements are counted by a 128-bit hash of their whole text; of each only
    the first SQL_CHARS characters are shown.
    """
    rows = reads_by_day(audit).where("statement IS NOT NULL").select("dataset_urn", "bucket_ms", "line_no", F.md5("statement").alias("_h"), F.substring("statement", 1, SQL_CHARS).alias("statement"))
    counted = rows.groupBy("dataset_urn", "bucket_ms", "_h").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.min("statement").alias("statement"))
    place = F.row_number().over(Window.partitionBy("dataset_urn", "bucket_ms").orderBy(F.desc("n"), "first_line"))
    best = counted.withColumn("place", place).where(F.col("place") <= top)
    return best.select("dataset_urn", "bucket_ms", F.col("place").cast("bigint").alias("place"), "statement", "n")


def dataset_ledger(audit: DataFrame) -> DataFrame:
    """Per data set: requests, denied attempts, last access (latest line) and the snapshot it used."""
    flat = requests(audit).select("line_no", "principal", "denied", "snapshot_hash", F.explode("dataset_urns").alias("dataset_urn"))
    last = F.max_by(F.struct("principal", "snapshot_hash"), F.col("line_no"))
    return (
        flat.groupBy("dataset_urn")
        .agg(F.count("*").alias("n_requests"), F.count_if("denied").alias("denied_attempts"), F.max("line_no").alias("last_line"), last.alias("l"))
        .select("dataset_urn", "n_requests", "denied_attempts", "last_line", F.col("l.principal").alias("last_principal"), F.coalesce("l.snapshot_hash", F.lit("unknown")).alias("last_snapshot"))
    )


def recent(audit: DataFrame, keep: int = LEDGER) -> DataFrame:
    """dataset_urn, place, line_no of the ``keep`` latest requests of each data set.

    Spark keeps only the first rows of each group before the shuffle (window
    group limit), so a crowded data set ships at most ``keep`` rows a task.
    """
    flat = requests(audit).select("line_no", F.explode("dataset_urns").alias("dataset_urn"))
    place = F.row_number().over(Window.partitionBy("dataset_urn").orderBy(F.desc("line_no")))
    return flat.withColumn("place", place).where(F.col("place") <= keep).select("dataset_urn", F.col("place").cast("bigint").alias("place"), "line_no")


def last_lines(audit: DataFrame) -> DataFrame:
    """The last line of every request_id, as an explanation of a request reads it."""
    rows = audit.where("request_id IS NOT NULL").select("request_id", "line_no", "status", "row_count", F.size(F.coalesce("verdicts", F.array())).cast("bigint").alias("n_verdicts"))
    return rows.groupBy("request_id").agg(F.max_by(F.struct("line_no", "status", "row_count", "n_verdicts"), F.col("line_no")).alias("l")).select("request_id", "l.*")


def read_back(day_usage: DataFrame) -> DataFrame:
    """Totals of the stored tallies per data set, without empty ones."""
    users = F.size(F.array_distinct(F.transform(F.map_keys("by_principal"), lambda p: F.lower(F.trim(p)))))
    rows = day_usage.select("dataset_urn", "queries", F.coalesce(users, F.lit(0)).cast("bigint").alias("users"))
    return rows.groupBy("dataset_urn").agg(F.sum("queries").alias("queries"), F.max("users").alias("most_users"), F.count("*").alias("n_days")).where("queries > 0")


def replay(audit: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What today's rules would do to the columns read: dataset_urn, action, n_reads, n_requests."""
    reads = requests(audit).select("line_no", F.explode("reads").alias("r")).select("line_no", F.col("r.key").alias("dataset_urn"), F.explode(F.array_distinct(F.transform("r.value", F.lower))).alias("column"))
    now = outcomes.select("dataset_urn", F.lower("column").alias("column"), "action")
    told = reads.join(now, ["dataset_urn", "column"], "left").withColumn("action", F.coalesce("action", F.lit("unknown")))
    per = told.groupBy("dataset_urn", "action", "line_no").agg(F.count("*").alias("n"))
    return per.groupBy("dataset_urn", "action").agg(F.sum("n").alias("n_reads"), F.count("*").alias("n_requests"))


def merge_ledger(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The stored ledger of :func:`dataset_ledger` with that of later lines: counts add up, the latest line holds.

    ``batch`` must hold requests the stored ledger has not seen. One aggregate
    over both tables, a row per data set each.
    """
    both = batch if stored is None else stored.unionByName(batch)
    last = F.max_by(F.struct("last_principal", "last_snapshot"), "last_line").alias("l")
    sums = both.groupBy("dataset_urn").agg(F.sum("n_requests").alias("n_requests"), F.sum("denied_attempts").alias("denied_attempts"), F.max("last_line").alias("last_line"), last)
    return sums.select("dataset_urn", "n_requests", "denied_attempts", "last_line", "l.last_principal", "l.last_snapshot")


def resume_usage(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored day tallies (dataset_urn, bucket_ms, queries) continued by those of later requests, never started again from nothing."""
    return stored.select("dataset_urn", "bucket_ms", "queries").unionByName(batch.select("dataset_urn", "bucket_ms", "queries")).groupBy("dataset_urn", "bucket_ms").agg(F.sum("queries").alias("queries"))
