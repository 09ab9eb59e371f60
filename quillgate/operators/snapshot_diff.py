"""What changed between full snapshots (problem 6).

Gaps and islands over key and row hash: along a source's snapshots, numbered
1, 2, ..., the rows of one key with one hash form islands of consecutive
numbers, the validity intervals. An interval that starts without a neighbour
before it is an addition, one that ends without a neighbour after it a
removal, and two that adjoin a change.

Only the numbers next to a row matter, so a key's numbers are cut into blocks
of ``BLOCK`` with the one row on either side repeated; a window group has at
most BLOCK + 2 rows however long the history is. Numbers themselves come from
per-day counts, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgate.functions.columns import blank_to_null, instant_us
from quillgate.operators import nested
from quillgate.operators.ordered import DAY_US, row_numbers

BLOCK = 512


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """Snapshots with a valid payload: source, at_us, snap_id (smallest), seq, next_snap_id.

    Null sources count as one source ''; rows whose compiled_at is no time are
    left out.
    """
    valid = snapshots.select(
        F.coalesce("source_url", F.lit("")).alias("source"),
        instant_us(F.col("compiled_at")).alias("at_us"),
        "snap_id",
        F.try_parse_json("payload").isNotNull().alias("ok"),
    ).where("ok AND at_us IS NOT NULL")
    heads = valid.groupBy("source", "at_us").agg(F.min("snap_id").alias("snap_id"))
    heads = row_numbers(heads, ["source"], "at_us", 30 * DAY_US, "seq")
    later = heads.select("source", (F.col("seq") - 1).alias("seq"), F.col("snap_id").alias("next_snap_id"))
    return heads.join(later, ["source", "seq"], "left")


def dataset_hash() -> Column:
    """Hash of a data set's content that ignores layout, order, repetition and blanks."""
    no_blank = lambda c: F.when(c != "", c)
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    cols = F.transform(
        F.col("columns"),
        lambda c: F.struct(
            c["name"].alias("n"),
            no_blank(c["data_type"]).alias("t"),
            as_set(F.concat(c["tags"], c["editable_tags"])).alias("g"),
            as_set(c["terms"]).alias("m"),
        ),
    )
    content = F.struct(
        F.upper(blank_to_null(F.col("lifecycle"))).alias("l"),
        F.upper(blank_to_null(F.col("certification"))).alias("c"),
        no_blank(F.col("domain")).alias("d"),
        as_set(F.col("owners")).alias("o"),
        as_set(F.col("tags")).alias("g"),
        as_set(F.col("terms")).alias("m"),
        F.array_distinct(F.array_sort(F.coalesce(cols, F.array()))).alias("x"),
    )
    return F.md5(F.to_json(content))


def observations(snapshots: DataFrame) -> DataFrame:
    """source, seq, snap_id, next_snap_id, key (URN), row_hash for every data set of every snapshot."""
    heads = snapshot_order(snapshots)
    rows = nested.datasets(snapshots).select(F.col("rec_id").alias("snap_id"), F.col("urn").alias("key"), dataset_hash().alias("row_hash"))
    rows = rows.groupBy("snap_id", "key").agg(F.min("row_hash").alias("row_hash"))
    return rows.join(heads, "snap_id")


def intervals(obs: DataFrame) -> DataFrame:
    """Adds is_start, is_end and the neighbours' presence to every observation."""
    seq, block = F.col("seq"), F.floor(F.col("seq") / BLOCK)
    at = seq % BLOCK
    homes = F.array_compact(F.array(block, F.when(at == 0, block - 1), F.when(at == BLOCK - 1, block + 1)))
    spread = obs.withColumn("_block", F.explode(homes))
    w = Window.partitionBy("source", "key", "_block").orderBy("seq")
    before = F.lag(F.struct("seq", "row_hash")).over(w)
    after = F.lead(F.struct("seq", "row_hash")).over(w)
    return (
        spread.withColumn("_p", before)
        .withColumn("_n", after)
        .where(F.col("_block") == block)
        .withColumn("had", F.coalesce(F.col("_p.seq") == seq - 1, F.lit(False)))
        .withColumn("has", F.coalesce(F.col("_n.seq") == seq + 1, F.lit(False)))
        .withColumn("is_start", ~(F.col("had") & (F.col("_p.row_hash") == F.col("row_hash"))))
        .withColumn("is_end", ~(F.col("has") & (F.col("_n.row_hash") == F.col("row_hash"))))
        .drop("_block", "_p", "_n")
    )


def changes(snapshots: DataFrame) -> DataFrame:
    """snap_id (the later snapshot), dataset_urn, change."""
    events = intervals(observations(snapshots)).select(
        F.col("key").alias("dataset_urn"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("is_start") & (F.col("seq") > 1), F.struct(F.col("snap_id").alias("snap_id"), F.when(F.col("had"), "changed").otherwise("added").alias("change"))),
                    F.when(F.col("is_end") & ~F.col("has") & F.col("next_snap_id").isNotNull(), F.struct(F.col("next_snap_id").alias("snap_id"), F.lit("removed").alias("change"))),
                )
            )
        ).alias("e"),
    )
    return events.select("e.snap_id", "dataset_urn", "e.change")


def validity(snapshots: DataFrame) -> DataFrame:
    """Number of validity intervals and observations of each key of each source."""
    return (
        intervals(observations(snapshots))
        .groupBy("source", "key")
        .agg(F.count_if("is_start").alias("n_intervals"), F.count("*").alias("n_seen"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    )
