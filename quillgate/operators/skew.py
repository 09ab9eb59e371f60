"""Joins of rows with their groups that no group can crowd."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int, most: int = MAX_HEAVY) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key.

    ``size`` is the groups' column with their number of rows, ``total`` the
    number of all rows. Groups of more than ``total / most`` rows, of which
    there can be ``most`` at most, are broadcast, so their rows stay where they
    are; the others, none of them large, are shuffled. ``groups`` is read
    twice and ``rows`` too: both should be written tables. Keys are not null.
    """
    bound = max(1000, total // most)
    keys, extra = list(keys), [c for c in groups.columns if c not in keys and c != size]
    heavy = groups.where(F.col(size) > bound).select(*keys, F.struct(F.lit(1).alias("_is"), *extra).alias("_hot"))
    split = rows.join(F.broadcast(heavy), keys, "left")
    hot = split.where("_hot IS NOT NULL").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in extra])
    cold = split.where("_hot IS NULL").drop("_hot").join(groups.where(F.col(size) <= bound).drop(size), keys)
    return hot.unionByName(cold.select(*rows.columns, *extra))
