import random

from pyspark.sql import functions as F

from quillgate.operators.ordered import neighbour, row_numbers
from quillgate.operators.skew import join_groups


def test_heavy_and_light_groups_join_alike(spark):
    rows = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = join_groups(rows, groups, ["k"], "n", 6000)
    want = rows.join(groups.drop("n"), "k")
    assert sorted(map(tuple, got.select("id", "k", "low").collect())) == sorted(map(tuple, want.select("id", "k", "low").collect()))
    assert got.columns == ["id", "k", "low"]


def test_neighbours_and_numbers_across_buckets(spark):
    rng = random.Random(2)
    at = {k: sorted(rng.sample(range(-500, 500), 60)) for k in "ab"}
    df = spark.createDataFrame([(k, t, f"{k}{t}") for k, v in at.items() for t in v], "k string, t bigint, x string")
    before = {(r.k, r.t): r.p for r in neighbour(df, ["k"], "t", 7, F.col("x"), "p").collect()}
    after = {(r.k, r.t): r.p for r in neighbour(df, ["k"], "t", 7, F.col("x"), "p", following=True).collect()}
    number = {(r.k, r.t): r.i for r in row_numbers(df, ["k"], "t", 7, "i").collect()}
    for k, v in at.items():
        for i, t in enumerate(v):
            assert before[k, t] == (f"{k}{v[i - 1]}" if i else None)
            assert after[k, t] == (f"{k}{v[i + 1]}" if i + 1 < len(v) else None)
            assert number[k, t] == i + 1
