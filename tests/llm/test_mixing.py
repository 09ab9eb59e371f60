import os
import random
from types import SimpleNamespace

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillgate.llm import mixing

PAGES = "doc_id bigint, source string, n_tokens bigint, copies int, block int"
TARGETS = "source string, target_share double, max_repeats int"


def pages(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i, s, rng.randrange(50, 150), 0, 0) for s, n in sizes.items() for i in range(hash(s) % 1000 * 100_000, hash(s) % 1000 * 100_000 + n)]
    return spark.createDataFrame(rows, PAGES), rows


def test_shares_caps_and_disjoint_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_PAGES", 8)
    p, rows = pages(spark, {"big": 3000, "mid": 600, "small": 100, "unasked": 50})
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 2), (None, 0.4, 1)], TARGETS)
    mixed = mixing.mix(p, t).cache()
    got = mixed.toPandas()
    size = {r[0]: r[2] for r in rows}
    assert set(got["source"]) == {"big", "mid", "small"}
    assert not got.duplicated(["doc_id", "copy"]).any()
    assert all(size[d] == n for d, n in zip(got["doc_id"], got["n_tokens"]))
    repeats = got.groupby(["source", "doc_id"]).size().groupby("source").max()
    assert repeats["big"] <= 1 and repeats["mid"] <= 2 and repeats["small"] <= 3
    s = {r.source: r for r in mixing.shares(p, t, mixed).collect()}
    for name, share in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("small", 0.1 / 0.9)):
        assert abs(s[name].actual_share - share) < 0.005
    assert s["absent"].actual_share == 0 and s["absent"].used_pages == 0
    per = got.groupby("shard")["n_tokens"].sum()
    assert len(per) == mixing.SHARDS and per.max() < 2 * per.min()
    again = mixing.mix(p, t).toPandas()
    key = ["doc_id", "copy"]
    assert got.sort_values(key)["shard"].tolist() == again.sort_values(key)["shard"].tolist()


def test_asked_total_beyond_the_caps(spark):
    p, _ = pages(spark, {"a": 200, "b": 200})
    t = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS)
    s = {r.source: r for r in mixing.shares(p, t, mixing.mix(p, t, total=100_000)).collect()}
    assert s["a"].used_tokens == s["a"].n_tokens and abs(s["b"].used_tokens - 10_000) < 150


def test_splitting_tree_is_exact_and_fair():
    counts = [1000, 10, 0, 333]
    out = mixing.split_quotas(counts, 7)
    assert out.sum(axis=0).tolist() == counts and out.min() >= 0
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 3
    mean = np.mean([mixing.split_quotas(counts, 8, seed=s)[3] for s in range(200)], axis=0)
    assert np.allclose(mean, np.array(counts) / 8, atol=2.5)


def test_plan_edges():
    row = lambda s, w, m, n, k: SimpleNamespace(source=s, target_share=w, max_repeats=m, n_pages=n, n_tokens=k)
    assert mixing.plan([]) == (0.0, {}) and mixing.plan([row("a", 0.5, 2, 0, 0), row("b", None, 1, 5, 50)]) == (0.0, {})
    total, quota = mixing.plan([row("a", 1.0, 3, 10, 100)])
    assert total == 300 and quota["a"]["copies"] == 3 and quota["a"]["rest"] == 0


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer files here")
def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "s", "the cat sat on the mat"), (2, "s", ""), (3, "s", None), (None, "s", "x"), (4, None, "abc " * 50_000)], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(docs).collect()}
    assert got[1] == 6 and got[2] == 0 and got[3] == 0 and got[4] > 50_000 and set(got) == {1, 2, 3, 4}


def test_empty_tables(spark):
    none, t = spark.createDataFrame([], PAGES), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(none, t).count() == 0
    assert [r.actual_share for r in mixing.shares(none, t, mixing.mix(none, t)).collect()] == [0.0]
    p, _ = pages(spark, {"a": 5})
    assert mixing.mix(p, spark.createDataFrame([], TARGETS)).count() == 0


def test_quotas_beyond_a_thousand_million_blocks():
    rows = [SimpleNamespace(source=s, target_share=w, max_repeats=3, n_pages=n, n_tokens=n * 500) for s, w, n in (("a", 0.7, 40_000_000_000_000), ("b", 0.3, 10**12))]
    total, quota = mixing.plan(rows, None)
    blocks = [q["blocks"] * (q["copies"] + 1) for q in quota.values()]
    assert sum(blocks) <= 2 * mixing.MOST_BLOCKS
    dealt = mixing.split_quotas(blocks, 16)
    assert dealt.sum(axis=0).tolist() == blocks and np.ptp(dealt.sum(axis=1)) <= 1


def test_shards_are_written_in_order(spark, tmp_path):
    pages = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 7) for i in range(2000)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(pages, targets, shards=4)
    mixing.write_shards(mixed, f"file://{tmp_path}/m")
    back = spark.read.parquet(f"file://{tmp_path}/m")
    assert back.count() == mixed.count()
    for shard in range(4):
        files = {}
        for r in back.where(f"shard = {shard}").select("place", F.input_file_name().alias("f")).collect():
            files.setdefault(r.f, []).append(r.place)
        spans = sorted((v[0], v[-1]) for v in files.values())
        assert all(v == sorted(v) for v in files.values()) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    other = {(r.doc_id, r.copy): r.shard for r in mixing.mix(pages, targets, shards=4, seed=5).collect()}
    assert sum(other.get((r.doc_id, r.copy)) == r.shard for r in mixed.collect()) < 0.6 * len(other)
