import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillgate.operators import history

SETS = "fact_id bigint, compiled_at timestamp, urn string, lifecycle string, certification string, value string, hash int"
COLS = "fact_id bigint, compiled_at timestamp, urn string, tags array<string>, attribute string"
DAY = 86_400_000_000


def at(day):
    return None if day is None else datetime.fromtimestamp(day * 86400, timezone.utc)


def brute(rows):
    """rows of (fact_id, day, urn, value) -> versions."""
    held = {}
    for f, d, u, v in rows:
        if d is not None and u is not None and (u, d) not in held or held.get((u, d), (-1,))[0] < f and d is not None and u is not None:
            held[u, d] = (f, v)
    out = []
    for u in {k[0] for k in held}:
        line = sorted((d, v[1]) for (x, d), v in held.items() if x == u)
        starts = [(d, v) for i, (d, v) in enumerate(line) if i == 0 or line[i - 1][1] != v]
        out += [(u, v, d * DAY, starts[i + 1][0] * DAY if i + 1 < len(starts) else -1) for i, (d, v) in enumerate(starts)]
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_any_order_of_arrival_gives_the_same_history(spark, batches):
    rng = random.Random(batches)
    rows = [(i, rng.choice([None, *range(0, 400, 9)]), rng.choice(["a", "b", "c", None]), rng.choice(["X", " x", "Y", None, ""])) for i in range(300)]
    sets = spark.createDataFrame([(f, at(d), u, v, None, "z", 1) for f, d, u, v in rows], SETS)
    got = history.attribute_history([(sets, {"life": history.loose_upper(F.col("lifecycle"))})], batches)
    got = sorted((r.urn, r.value, r.from_us, -1 if r.to_us is None else r.to_us) for r in got.collect())
    assert got == brute([(f, d, u, (v or "").strip().upper()) for f, d, u, v in rows])


def test_found_on_tags_and_empty_tables(spark):
    cols = spark.createDataFrame(
        [(1, at(1), "c", ["urn:li:tag:B", "a", "A", None, ""], "x"), (2, at(2), "c", ["b", "a"], "x"), (3, at(3), "c", None, "x"), (4, at(3), "c", [], "x"), (5, None, "c", ["q"], "x")], COLS
    )
    got = sorted(tuple(r) for r in history.found(spark.createDataFrame([], SETS), cols).collect())
    assert got == [("tags", "c", "", 3 * DAY, -1), ("tags", "c", "a,b", 1 * DAY, 3 * DAY)]
    assert history.found(spark.createDataFrame([], SETS), spark.createDataFrame([], COLS)).count() == 0
