"""Order-dependent steps whose groups stay bounded.

A plain window over a key puts the key's whole history in one task. Here each
key is cut into buckets of the order column; the window runs inside a bucket,
and only one row per (key, bucket) takes part in the second window that
carries values across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    width: int,
    value: Column,
    name: str,
    following: bool = False,
) -> DataFrame:
    """Adds ``name``: ``value`` of the row before (or after) within ``keys``.

    ``order`` is a bigint, unique within the keys; ``width`` is the length of
    a bucket in its units. Keys must not be null. The first (last) row of a
    key gets null.
    """
    at = F.col(order)
    df = df.withColumn("_b", F.floor(at / F.lit(width)).cast("bigint")).withColumn("_v", F.struct(value.alias("v")))
    part = [*keys, "_b"]
    by = at.desc() if following else at.asc()
    w = Window.partitionBy(*part).orderBy(by)
    inner = df.withColumn("_n", F.lag("_v").over(w)).withColumn("_edge", F.row_number().over(w) == 1)
    last = (F.min_by if following else F.max_by)(F.col("_v"), at)
    edges = df.groupBy(*part).agg(last.alias("_l"))
    wk = Window.partitionBy(*keys).orderBy(F.col("_b").desc() if following else F.col("_b").asc())
    edges = edges.withColumn("_c", F.lag("_l").over(wk)).drop("_l")
    return (
        inner.join(edges, part, "left")
        .withColumn(name, F.when(F.col("_edge"), F.col("_c")).otherwise(F.col("_n"))["v"])
        .drop("_b", "_v", "_n", "_edge", "_c")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, width: int, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... along ``order`` within ``keys`` (same terms)."""
    df = df.withColumn("_b", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    part = [*keys, "_b"]
    counts = df.groupBy(*part).agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    rn = F.row_number().over(Window.partitionBy(*part).orderBy(order))
    return (
        df.withColumn("_rn", rn)
        .join(counts, part, "left")
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint"))
        .drop("_b", "_rn", "_before")
    )
