"""What a use of a column leads to, as a Column expression.

A use is a column in a context (projection, predicate, group_by, order_by),
inside an aggregate or not. The expression gives the reason number and the
effect for millions of uses in one projection: the decision for a log, a
catalog or a planned workload is a scan, not a loop over statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXTS = ("projection", "predicate", "group_by", "order_by")

# Reason numbers.
MASK, MASK_ORDER, MASK_INHERITED = 110, 111, 113
DENY, DENY_AGGREGATE, DENY_INHERITED = 120, 121, 122
PREDICATE, OUT_OF_SCOPE, UNKNOWN_COLUMN = 130, 301, 409


def verdict(action: Column, inherited: Column, context: Column, in_aggregate: Column, transform_predicates: bool = False) -> Column:
    """struct<code int, effect string> of a use, null where it is simply allowed.

    Effects: mask, deny_column (null in the result), deny_statement, note.
    """
    out = lambda code, effect: F.struct(F.lit(code).alias("code"), F.lit(effect).alias("effect"))
    shown = context == "projection"
    denied = (
        F.when(shown & ~in_aggregate & inherited, out(DENY_INHERITED, "deny_column"))
        .when(shown & ~in_aggregate, out(DENY, "deny_column"))
        .when(in_aggregate, out(DENY_AGGREGATE, "deny_statement"))
        .otherwise(out(DENY, "deny_statement"))
    )
    masked = (
        F.when(context == "predicate", out(PREDICATE, "note" if transform_predicates else "deny_statement"))
        .when(context == "order_by", out(MASK_ORDER, "note"))
        .when(inherited, out(MASK_INHERITED, "mask"))
        .otherwise(out(MASK, "mask"))
    )
    return F.when(action == "deny", denied).when(action == "mask", masked)


def grid(outcomes: DataFrame, transform_predicates: bool = False) -> DataFrame:
    """Every masked or denied column in every context: urn, context, in_aggregate, code, effect."""
    governed = outcomes.where(F.col("action").isin("mask", "deny")).select("urn", "action", F.col("source").isNotNull().alias("inherited"))
    uses = governed.select("*", F.explode(F.array(*[F.lit(c) for c in CONTEXTS])).alias("context")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("in_aggregate"))
    v = verdict(F.col("action"), F.col("inherited"), F.col("context"), F.col("in_aggregate"), transform_predicates)
    return uses.withColumn("v", v).select("urn", "context", "in_aggregate", "v.code", "v.effect")


def decided_reads(reads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """dataset_urn, code, effect, n_reads of logged reads taken as plain projections.

    ``reads`` is (dataset_urn, column in lower case). A column the catalog does
    not list gets UNKNOWN_COLUMN; allowed reads get code 0.
    """
    now = outcomes.select("dataset_urn", F.lower("column").alias("column"), "action", F.col("source").isNotNull().alias("inherited"))
    v = verdict(F.col("action"), F.col("inherited"), F.lit("projection"), F.lit(False))
    unknown = F.struct(F.lit(UNKNOWN_COLUMN).alias("code"), F.lit("error").alias("effect"))
    allowed = F.struct(F.lit(0).alias("code"), F.lit("allow").alias("effect"))
    told = reads.join(now, ["dataset_urn", "column"], "left").withColumn("v", F.when(F.col("action").isNull(), unknown).otherwise(F.coalesce(v, allowed)))
    return told.groupBy("dataset_urn", F.col("v.code").alias("code"), F.col("v.effect").alias("effect")).agg(F.count("*").alias("n_reads"))
