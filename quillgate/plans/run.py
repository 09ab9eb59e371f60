"""Running a DataFrame for a caller: row cap, time limit, plain cell values."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


class TimedOut(RuntimeError):
    pass


def plain(x: Any) -> Any:
    """A JSON-safe value: decimals as floats, times as ISO text, bytes as hex, anything else as text."""
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (date, datetime, time)):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return str(x)


def run(df: DataFrame, row_limit: int = 10_000, seconds: float | None = None) -> Result:
    """At most ``row_limit`` rows; ``truncated`` tells whether there were more.

    Beyond ``seconds`` the query's jobs are cancelled on the executors too,
    and TimedOut is raised.
    """
    spark, tag = df.sparkSession, f"run-{uuid.uuid4().hex}"
    context = spark.sparkContext
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop) if seconds else None
    context.addJobTag(tag)
    if timer:
        timer.start()
    try:
        rows = df.limit(row_limit + 1).collect()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"cancelled after {seconds} s") from e
        raise
    finally:
        if timer:
            timer.cancel()
        context.removeJobTag(tag)
    return Result(df.columns, [tuple(plain(x) for x in r) for r in rows[:row_limit]], len(rows) > row_limit)
