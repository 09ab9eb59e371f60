import random

import pytest
from pyspark.sql import functions as F

from quillgate.functions.columns import instant_us
from quillgate.operators import sessions

M = 60_000_000
AUDIT = "line_no bigint, request_id string, ts string, principal string, start_us string, n int"


def brute(events, gap=sessions.GAP_US):
    out = []
    for u in {e[1] for e in events}:
        line = sorted(t for _, x, t in events if x == u)
        s = [[line[0]]]
        for a, b in zip(line, line[1:]):
            s.append([b]) if b - a > gap else s[-1].append(b)
        out += [(u, x[0], x[-1], len(x)) for x in s]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_bridge_and_late_events(spark, seed, tmp_path):
    rng = random.Random(seed)
    events = [(f"e{i}", rng.choice("ab") if rng.random() < 0.8 else "hot", rng.randrange(0, 3000) * 15 * M) for i in range(400)]
    table = sessions.SessionTable(spark, f"file://{tmp_path}/t")
    for k in range(4):
        batch = events[k::4] + rng.sample(events[: k + 1], 1) * 2  # and some delivered again
        table.merge(spark.createDataFrame(batch, "event_id string, user string, at_us bigint"))
    table.merge(spark.createDataFrame([], "event_id string, user string, at_us bigint"))
    assert sorted(tuple(r) for r in table.sessions().select("user", "start_us", "end_us", "n").collect()) == brute(events)


def test_a_late_line_rewrites_its_own_week_only(spark, tmp_path):
    week = sessions.WEEK_US
    table = sessions.SessionTable(spark, f"file://{tmp_path}/t")
    kind = "event_id string, user string, at_us bigint"
    table.merge(spark.createDataFrame([(f"e{i}", "ab"[i % 2], i * week // 3 + week // 7) for i in range(30)], kind))
    before = table._manifest()["weeks"]
    # One line of today, and one of the third week.
    table.merge(spark.createDataFrame([("new", "a", 10 * week + 5), ("late", "b", 2 * week + week // 2)], kind))
    after = table._manifest()["weeks"]
    assert {w for w in after if after[w] != before.get(w)} == {"2", "10"}
    assert table.sessions().count() == 32


def test_gap_is_inclusive_and_ties(spark):
    df = spark.createDataFrame([("u", 0), ("u", 0), ("u", 30 * M), ("u", 60 * M + 1)], "user string, at_us bigint")
    assert sorted(tuple(r) for r in sessions.sessionize(df).collect()) == [("u", 0, 30 * M, 3), ("u", 60 * M + 1, 60 * M + 1, 1)]


def test_found_reads_spellings_and_skips_the_unusable(spark):
    rows = [
        (1, "r1", "2020-01-01T00:00:00.000+00:00", " Bot"), (2, "r1", "2020-01-01T00:00:00.000+00:00", "bot "), (3, "r2", "2020-01-01T09:10:00+09:00", "BOT"),
        (4, "r3", "1577838000000", "bot"), (5, "r4", "unknown", "bot"), (6, "r5", None, "bot"), (7, "r6", "", "bot"), (8, "r7", "2020-01-01 00:20:00", None), (9, None, "2020-01-01 00:20:00", "bot"), (None, "r9", "2020-01-01 00:20:00", "bot"),
    ]
    got = sorted(tuple(r) for r in sessions.found(spark.createDataFrame([(*r, "x", 1) for r in rows], AUDIT)).collect())
    base = 1577836800 * 1_000_000
    assert got == [("bot", base, base + 20 * M, 3)]
    assert sessions.found(spark.createDataFrame([], AUDIT)).count() == 0


def test_instants(spark):
    texts = ["1970-01-01T00:00:01Z", "1970-01-01 00:00:01", "1970-01-01T01:00:01+01:00", "1000", "-", "12:30:00", "2020", None, "1970-01-01T00:00:01.5", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(instant_us(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [1_000_000, 1_000_000, 1_000_000, 1_000_000, None, None, 2_020_000, None, 1_500_000, None]
