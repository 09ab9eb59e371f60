"""Session settings, shared scratch space and lineage cuts.

Intermediate tables live in the folder the cluster names in
``spark.checkpoint.dir``, which every executor can reach; losing an executor
never loses them. Only local sessions (tests, a laptop) may leave that setting
out and get a temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators and the SQL checks assume."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # for the Python workers of local sessions, one of which runs per core
    b = (
        SparkSession.builder.master(master)
        .appName("quillgate")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that sets none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-quillgate-")
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return _fallback[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table under the shared folder."""
    return f"{shared_dir(spark)}/quillgate/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and makes later reads cheap, column-pruned and
    independent of the executors that computed it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Number of partitions that holds ``rows`` at ``rows_per_task`` each."""
    return max(1, -(-rows // rows_per_task))
