"""Items that appear together (problem 3), by heavy-light decomposition.

Baskets are (record, data set) with the set of its columns. An item (a column
of a data set) is heavy if it stands in at least ``1 / MAX_HEAVY`` of all
basket entries, so there are never more than MAX_HEAVY of them, a proven bound
for what the tasks are sent. Inside each batch of baskets

* heavy-heavy pairs are counted on a dense bit matrix (items x baskets) by
  popcounts of ANDed rows,
* light-light pairs by hash counting,
* mixed pairs by probing the heavy rows with a light item's list of baskets.

The batches' counts are summed with map-side combining; pairs are scored
against chance after that. Baskets are range-partitioned by data set and
record, so a data set with a third of all records is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.session import cut

MAX_HEAVY = 4096
SET = ["origin", "dataset"]
PAIRS = "origin string, dataset string, a string, b string, n bigint"


def baskets(audit: DataFrame) -> DataFrame:
    """origin, dataset, record, items: the columns read or judged together.

    Rows of one request_id are one record (without one, a line is its own).
    Names in lower case, each once; null and empty names and subjects without
    a column are left out.
    """
    record = F.coalesce("request_id", F.concat(F.lit("line "), F.col("line_no"))).alias("record")
    read = F.transform(
        F.coalesce(F.map_entries("column_reads"), F.array()),
        lambda e: F.transform(F.coalesce(e["value"], F.array()), lambda c: F.struct(F.lit("column_reads").alias("origin"), e["key"].alias("dataset"), F.lower(c).alias("item"))),
    )
    named = F.filter(F.coalesce("subjects", F.array()), lambda s: s.startswith("column:") & s.contains("."))
    judged = F.transform(
        named,
        lambda s: F.struct(
            F.lit("subjects").alias("origin"),
            F.regexp_extract(s, r"(?s)^column:(.*)\.[^.]*$", 1).alias("dataset"),
            F.lower(F.regexp_extract(s, r"([^.]*)$", 1)).alias("item"),
        ),
    )
    flat = audit.select(record, F.explode(F.concat(F.flatten(read), judged)).alias("x")).select("record", "x.*")
    flat = flat.where("item IS NOT NULL AND item <> '' AND dataset IS NOT NULL AND record IS NOT NULL")
    return flat.groupBy(*SET, "record").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _count_group(items: list[np.ndarray], heavy: set[str]) -> tuple[list[str], list[str], list[int]]:
    """Pair counts of one data set's baskets in a batch."""
    sizes = np.fromiter((len(x) for x in items), dtype=np.int64, count=len(items))
    names, codes = np.unique(np.concatenate(items).astype(str), return_inverse=True)
    basket = np.repeat(np.arange(len(items)), sizes)
    is_heavy = np.fromiter((x in heavy for x in names), dtype=bool, count=len(names))
    rank = np.cumsum(is_heavy) - 1
    a_out, b_out, n_out = [], [], []

    def emit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        a_out.extend(names[lo])
        b_out.extend(names[hi])
        n_out.extend(n.tolist())

    heavy_codes = np.flatnonzero(is_heavy)
    bits = np.zeros((len(heavy_codes), len(items)), dtype=bool)
    on = is_heavy[codes]
    bits[rank[codes[on]], basket[on]] = True
    packed = np.packbits(bits, axis=1)
    for i in range(len(heavy_codes) - 1):
        n = np.bitwise_count(packed[i] & packed[i + 1 :]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(n)
        emit(np.full(len(hit), heavy_codes[i]), heavy_codes[i + 1 + hit], n[hit])
    light, where = codes[~on], basket[~on]
    if len(light):
        order = np.argsort(light, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(light[order]) > 0])
        for s, posting in zip(starts, np.split(where[order], starts[1:])):
            n = bits[:, posting].sum(axis=1)
            hit = np.flatnonzero(n)
            emit(np.full(len(hit), light[order[s]]), heavy_codes[hit], n[hit])
        counts: dict[int, int] = {}
        width = len(names)
        per = np.flatnonzero(np.r_[True, np.diff(where) > 0])
        for x in np.split(light, per[1:]):
            x = np.sort(x)
            for i in range(len(x) - 1):
                for k in (x[i] * width + x[i + 1 :]).tolist():
                    counts[k] = counts.get(k, 0) + 1
        if counts:
            k = np.fromiter(counts, dtype=np.int64, count=len(counts))
            emit(k // width, k % width, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
    return a_out, b_out, n_out


def _counter(heavy: dict[tuple[str, str], set[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for (origin, dataset), g in b.groupby(["origin", "dataset"], sort=False):
                a, c, n = _count_group(list(g["items"]), heavy.get((origin, dataset), set()))
                if n:
                    out.append(pd.DataFrame({"origin": origin, "dataset": dataset, "a": a, "b": c, "n": n}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def scored(audit: DataFrame, max_heavy: int = MAX_HEAVY, least: int = 1) -> DataFrame:
    """origin, dataset, column_a, column_b, n_ab, n_a, n_b, n_records, lift of pairs with n_ab >= least.

    Lossless pruning only: baskets with a single item enter the counts of
    items and records, but not the pair counting.
    """
    rows = cut(baskets(audit).repartitionByRange(*SET, "record").sortWithinPartitions(*SET, "record"), "baskets")
    records = rows.groupBy(*SET).agg(F.count("*").alias("n_records"))
    items = cut(rows.select(*SET, F.explode("items").alias("item")).groupBy(*SET, "item").agg(F.count("*").alias("n")), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    heavy: dict[tuple[str, str], set[str]] = {}
    for r in items.where(F.col("n") >= max(1, -(-total // max_heavy))).collect():  # at most max_heavy rows
        heavy.setdefault((r.origin, r.dataset), set()).add(r.item)
    counted = rows.where(F.size("items") > 1).select(*SET, "items").mapInPandas(_counter(heavy), PAIRS)
    pairs = counted.groupBy(*SET, "a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    of = lambda side: items.select(*SET, F.col("item").alias(side), F.col("n").alias(f"n_{side}"))
    full = pairs.join(of("a"), [*SET, "a"]).join(of("b"), [*SET, "b"]).join(records, SET)
    return full.select(
        *SET, F.col("a").alias("column_a"), F.col("b").alias("column_b"), "n_ab", "n_a", "n_b", "n_records",
        (F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
    )


def found(audit: DataFrame, least: int = 5, times: int = 2, max_heavy: int = MAX_HEAVY) -> DataFrame:
    s = scored(audit, max_heavy, least)
    return s.where(F.col("n_ab") * F.col("n_records") >= times * F.col("n_a") * F.col("n_b")).select(*SET, "column_a", "column_b")
