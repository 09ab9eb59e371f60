"""Grouping activity into sessions, incrementally (problem 7).

Sessions are separated by more than ``gap`` without an event. Events are first
folded into slots of one gap's length per user: all events of a slot lie
within the gap of each other and so in one session, and the fold is a plain
aggregate with map-side combining, so a user with a third of all events costs
no more than another. A user has at most one slot per gap of time, which
bounds the window that joins slots to sessions.

:class:`SessionTable` keeps the result between batches. A batch's local
sessions are compared with the stored sessions that lie within the gap,
bridged ones are merged, and only the weeks within the gap of a local session
are written again; a new manifest then replaces the old one in one rename, so a
reader or a restarted job sees the table before or after the batch, never
between.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgate.functions.columns import instant_us

GAP_US = 30 * 60 * 1_000_000
WEEK_US = 7 * 86_400_000_000
SESSION = "user string, start_us bigint, end_us bigint, n bigint"


def audit_events(audit: DataFrame) -> DataFrame:
    """user, at_us, event_id (request_id), arrival (line_no): one row per usable request.

    Rows with a null principal, request_id or unusable ts are left out; of rows
    for one request_id the first to arrive holds.
    """
    rows = audit.select(
        F.lower(F.trim("principal")).alias("user"),
        instant_us(F.col("ts")).alias("at_us"),
        F.col("request_id").alias("event_id"),
        F.col("line_no").alias("arrival"),
    ).where("user IS NOT NULL AND at_us IS NOT NULL AND event_id IS NOT NULL")
    return rows.groupBy("event_id").agg(F.min(F.struct("arrival", "user", "at_us")).alias("f")).select("event_id", "f.*")


def merge_intervals(parts: DataFrame, gap_us: int) -> DataFrame:
    """Merges (user, start_us, end_us, n) rows that overlap or lie within the gap."""
    w = Window.partitionBy("user").orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_us") - reach > gap_us), 1).otherwise(0)
    return (
        parts.withColumn("_open", opens)
        .withColumn("_k", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("user", "_k")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
        .drop("_k")
    )


def sessionize(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """user, start_us, end_us, n of (user, at_us) rows."""
    slots = events.groupBy("user", F.floor(F.col("at_us") / gap_us).alias("_s")).agg(
        F.min("at_us").alias("start_us"), F.max("at_us").alias("end_us"), F.count("*").alias("n")
    )
    return merge_intervals(slots.drop("_s"), gap_us)


class SessionTable:
    """Sessions kept in ``path``, one folder per week of start and version."""

    def __init__(self, spark: SparkSession, path: str, gap_us: int = GAP_US):
        self.spark, self.path, self.gap = spark, path.rstrip("/"), gap_us
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    # The manifest: {"weeks": {week: [folder, greatest end_us]}, "seen": [folders]}.
    def _manifest(self) -> dict:
        at = f"{self.path}/manifest.json"
        if not self._fs.exists(self._path(at)):
            return {"weeks": {}, "seen": []}
        return json.loads("\n".join(r.value for r in self.spark.read.text(at).collect()))

    def _publish(self, manifest: dict) -> None:
        new = self._path(f"{self.path}/manifest-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(new, self._path(f"{self.path}/manifest.json"), array)

    def _weeks(self, manifest: dict, weeks: list[str]) -> DataFrame:
        folders = [manifest["weeks"][w][0] for w in weeks]
        if not folders:
            return self.spark.createDataFrame([], SESSION)
        return self.spark.read.schema(SESSION).parquet(*folders)

    def sessions(self) -> DataFrame:
        m = self._manifest()
        return self._weeks(m, list(m["weeks"]))

    def merge(self, events: DataFrame) -> None:
        """Adds a batch of (event_id, user, at_us); events seen before count once.

        An empty batch changes nothing. The driver only sees one row per week.
        """
        m, version = self._manifest(), uuid.uuid4().hex[:12]
        fresh = events.groupBy("event_id").agg(F.min(F.struct("at_us", "user")).alias("f")).select("event_id", "f.*")
        if m["seen"]:
            seen = self.spark.read.schema("event_id string").parquet(*m["seen"])
            fresh = fresh.join(seen, "event_id", "left_anti")
        batch_at = f"{self.path}/batch-{version}"
        fresh.write.parquet(batch_at)
        fresh = self.spark.read.schema(fresh.schema).parquet(batch_at)
        local_at = f"{self.path}/local-{version}"
        sessionize(fresh, self.gap).write.parquet(local_at)
        local = self.spark.read.schema(SESSION).parquet(local_at)
        # One row per week that the batch has sessions in: what they span.
        spans = local.groupBy(F.floor(F.col("start_us") / WEEK_US).alias("w")).agg(F.min("start_us").alias("low"), F.max("end_us").alias("high")).collect()
        if not spans:
            return
        near = [w for w, (_, end) in m["weeks"].items() if any(int(w) * WEEK_US <= r.high + self.gap and end >= r.low - self.gap for r in spans)]
        stored = self._weeks(m, near)
        merged = merge_intervals(stored.unionByName(local), self.gap) if near else local
        rows = merged.withColumn("week", F.floor(F.col("start_us") / WEEK_US).cast("bigint"))
        out = f"{self.path}/v-{version}"
        # Spark sizes the files: a week of very many sessions is split, small ones share a task.
        rows.hint("rebalance", "week").write.partitionBy("week").parquet(out)
        ends = self.spark.read.parquet(out).groupBy("week").agg(F.max("end_us").alias("end_us")).collect()
        weeks = {w: v for w, v in m["weeks"].items() if w not in near}
        # A week outside the batch's reach keeps its folder, one inside is replaced as a whole.
        weeks |= {str(r.week): [f"{out}/week={r.week}", r.end_us] for r in ends}
        self._publish({"weeks": weeks, "seen": [*m["seen"], batch_at]})


def found(audit: DataFrame, batches: int = 3, gap_us: int = GAP_US) -> DataFrame:
    """The audit's sessions, its lines merged in ``batches`` of arrival into a session table."""
    from quillgate.session import scratch

    spark = audit.sparkSession
    store = SessionTable(spark, scratch(spark, "sessions"), gap_us)
    low, high = audit.agg(F.min("line_no"), F.max("line_no")).first()
    if low is not None:
        step = max(1, -(-(high - low + 1) // batches))
        for start in range(low, high + 1, step):
            store.merge(audit_events(audit.where(F.col("line_no").between(start, start + step - 1))))
    return store.sessions().select(F.col("user").alias("principal"), "start_us", "end_us", F.col("n").alias("n_requests"))
