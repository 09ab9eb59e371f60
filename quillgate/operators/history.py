"""History of changing attributes as a type-two dimension (problem 4).

State (:class:`History`): ``observations``, a log of (attribute, urn, at,
fact_id) with the value and its hash; ``current``, the open versions, one row
a key; and closed versions, tables that are only ever added to. A batch of
facts is merged by comparing attribute hashes (then the values) with the open
versions: equal ones only move ``seen_us``, a different one closes the open row
with an end date and inserts a new open row. Keys for which the batch brings a
compile not after the last one seen (late rows, corrections) have their
versions rebuilt from their observations, as a late value may split or join
old versions; their closed versions of earlier batches then no longer count.

Every step is an aggregate or an equi-join on (attribute, urn); the order
within a key is followed in time buckets, so a key with a third of all facts
is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.columns import loose_upper, tag_set_text
from quillgate.operators.ordered import DAY_US, neighbour
from quillgate.session import cut

KEY = ["attribute", "urn"]
BUCKET_US = 30 * DAY_US


def facts(rows: DataFrame, values: dict[str, Column], fact_id: str = "fact_id", urn: str = "urn", at: str = "compiled_at") -> DataFrame:
    """attribute, urn, at_us, fact_id, value, hash: the fact that holds at each instant.

    Rows with a null urn or instant are left out; of rows for one urn and
    instant the greatest fact_id holds, for every attribute.
    """
    pick = F.max_by(F.struct(*[v.alias(k) for k, v in values.items()]), F.col(fact_id)).alias("v")
    held = (
        rows.where(F.col(urn).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(urn).alias("urn"), F.unix_micros(at).alias("at_us"))
        .agg(F.max(fact_id).alias("fact_id"), pick)
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("attribute"), F.col(f"v.{k}").alias("value")) for k in values])
    return held.select("urn", "at_us", "fact_id", F.explode(pairs).alias("p")).select(
        "p.attribute", "urn", "at_us", "fact_id", "p.value", F.xxhash64("p.value", F.length("p.value")).alias("hash")
    )


def _versions(line: DataFrame) -> DataFrame:
    """attribute, urn, value, hash, from_us, to_us (null: open) of ordered rows (at_us, value, hash, _from)."""
    content = F.struct("hash", "value")  # compared in this order: the value only where hashes are equal
    line = cut(neighbour(line, KEY, "at_us", BUCKET_US, content, "_before"), "line")
    starts = line.where(F.col("_before").isNull() | (F.col("_before") != content))
    starts = cut(starts.select(*KEY, "value", "hash", F.coalesce("_from", "at_us").alias("from_us")), "starts")
    return neighbour(starts, KEY, "from_us", BUCKET_US, F.col("from_us"), "to_us", following=True)


def rebuild(observations: DataFrame) -> DataFrame:
    """versions of whole keys: attribute, urn, value, hash, from_us, to_us (null: open), seen_us."""
    ends = _versions(observations.select(*KEY, "at_us", "value", "hash", F.lit(None).cast("bigint").alias("_from")))
    last = observations.groupBy(*KEY).agg(F.max("at_us").alias("seen_us"))
    return ends.join(last, KEY).select(*KEY, "value", "hash", "from_us", "to_us", "seen_us")


@dataclass
class History:
    observations: DataFrame
    current: DataFrame
    closed: list[DataFrame]  # of each batch: versions it closed
    redone: list[DataFrame]  # of each batch: keys whose versions closed before no longer count

    def versions(self) -> DataFrame:
        out = self.current
        for i, part in enumerate(self.closed):
            for keys in self.redone[i + 1 :]:
                part = part.join(keys, KEY, "left_anti")
            out = out.unionByName(part)
        return out


def begin(batch: DataFrame) -> History:
    made = cut(rebuild(batch), "versions")
    return History(batch, made.where("to_us IS NULL"), [made.where("to_us IS NOT NULL")], [made.select(*KEY).limit(0)])


def merge(history: History, batch: DataFrame) -> History:
    """The history after ``batch``, which is in the form of :func:`facts`. Closed versions are not written again."""
    current = history.current
    reach = batch.groupBy(*KEY).agg(F.min("at_us").alias("_low"), F.max("at_us").alias("_high"))
    touched = cut(reach.join(current.select(*KEY, "seen_us"), KEY, "left").withColumn("_late", F.coalesce(F.col("_low") <= F.col("seen_us"), F.lit(False))), "touched")

    # In order: the open version stands before the batch's rows as their predecessor.
    calm, late = touched.where("NOT _late").select(*KEY, "_high"), touched.where("_late").select(*KEY)
    opening = current.join(calm, KEY, "left_semi").select(*KEY, F.col("seen_us").alias("at_us"), "value", "hash", F.col("from_us").alias("_from"))
    line = opening.unionByName(batch.join(calm, KEY, "left_semi").select(*KEY, "at_us", "value", "hash", F.lit(None).cast("bigint").alias("_from")))
    in_order = _versions(line).join(calm, KEY).select(*KEY, "value", "hash", "from_us", "to_us", F.col("_high").alias("seen_us"))

    # Late: the keys' observations, corrected by the batch, are read again; the log itself only grows.
    log = history.observations.unionByName(batch)
    held = (
        log.join(late, KEY, "left_semi")
        .groupBy(*KEY, "at_us")
        .agg(F.max(F.struct("fact_id", "value", "hash")).alias("h"))
        .select(*KEY, "at_us", "h.fact_id", "h.value", "h.hash")
    )
    new = cut(in_order.unionByName(rebuild(cut(held, "held"))), "versions")
    still = current.join(touched.select(*KEY), KEY, "left_anti")
    opened = cut(still.unionByName(new.where("to_us IS NULL")), "current")
    return History(log, opened, [*history.closed, new.where("to_us IS NOT NULL")], [*history.redone, late])


def attribute_history(fact_tables: list[tuple[DataFrame, dict[str, Column]]], batches: int = 2) -> DataFrame:
    """The versions of all attributes, the facts merged in ``batches`` of arrival (fact_id)."""
    history = None
    for i in range(batches):
        part = None
        for rows, values in fact_tables:
            low, high = rows.agg(F.min("fact_id"), F.max("fact_id")).first()
            step = 1 if low is None else -(-(high - low + 1) // batches)
            first = (low or 0) + i * step
            f = facts(rows.where(F.col("fact_id").between(first, first + step - 1)), values)
            part = f if part is None else part.unionByName(f)
        part = cut(part, "facts")
        history = begin(part) if history is None else merge(history, part)
    return history.versions()


def catalog_history(dataset_facts: DataFrame, column_facts: DataFrame, batches: int = 2) -> DataFrame:
    """Versions of lifecycle, certification and column tags.

    Values: trimmed upper case and '' for blank; tags as distinct lower-case
    names, sorted, joined by ','.
    """
    sets = {"lifecycle": loose_upper(F.col("lifecycle")), "certification": loose_upper(F.col("certification"))}
    return attribute_history([(dataset_facts, sets), (column_facts, {"tags": tag_set_text(F.col("tags"))})], batches)


def found(dataset_facts: DataFrame, column_facts: DataFrame) -> DataFrame:
    return catalog_history(dataset_facts, column_facts).select(
        "attribute",
        "urn",
        F.col("value").alias("fact_value"),
        F.col("from_us").alias("valid_from_us"),
        F.coalesce("to_us", F.lit(-1)).cast("bigint").alias("valid_to_us"),
    )
