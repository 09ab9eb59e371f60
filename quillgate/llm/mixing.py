"""Mixing sources to target weights (problem 9), by a splitting tree.

Sizes are tokens of a public tokenizer. With no total asked for, the mix is
the largest in which every source with pages reaches its share without any
page being used more than ``max_repeats`` times. A source's quota is met by
whole copies of all its pages and, for the rest, blocks of pages in permuted
order; the last block is cut at the page boundary nearest to the quota, so a
source misses its quota by about half a page at most.

Pages fall into blocks by a hash of page and copy, which is the permutation:
no sort or rank over a source is needed, and a source with a third of all
pages is spread like any other. The numbers of blocks per source (a row per
target, not per page) are then split among the output shards down a binary
tree by multivariate hypergeometric draws, so each shard gets an exact quota
of disjoint blocks, distributed as in a perfect shuffle; pages are ordered
inside their shard by another hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgate.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_PAGES, MOST_BLOCKS, SHARDS, SEED = 64, 100_000_000, 16, 2024
_RANGE = 1 << 32


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of the whole text; a null text has none, rows without doc_id are left out."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    pattern = pattern or _pattern()
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary file, a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(n) for a, n in (line.split() for line in sent.value.splitlines() if line)}
        encoder = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    return documents.select("doc_id", "source", "text").where("doc_id IS NOT NULL").mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")


def split_quotas(counts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources): leaves of the splitting tree.

    A node hands its left half of the shards as many blocks as that half's
    part of the node's blocks, drawn without replacement from all sources.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def split(quota: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid = (lo + hi) // 2
        take = int(quota.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(quota, take, method="marginals") if take else np.zeros_like(quota)
        split(left, lo, mid)
        split(quota - left, mid, hi)

    if len(counts):
        split(np.array(counts, dtype=np.int64), 0, shards)
    return out


def plan(stats: list, total: float | None = None) -> tuple[float, dict[str, dict]]:
    """Total tokens and, for each source with pages and a share, its quota, whole copies and rest.

    stats: rows (source, target_share, max_repeats, n_pages, n_tokens). Shares
    are taken relative to the sources that have any tokens. A source whose cap
    forbids its quota under an asked-for total gets what the cap allows.
    """
    usable = [r for r in stats if (r.target_share or 0) > 0 and (r.n_tokens or 0) > 0 and (r.max_repeats or 0) > 0]
    whole = sum(r.target_share for r in usable)
    if not usable:
        return 0.0, {}
    share = {r.source: r.target_share / whole for r in usable}
    if total is None:
        total = min(r.n_tokens * r.max_repeats / share[r.source] for r in usable)
    out = {}
    for r in usable:
        quota = min(total * share[r.source], float(r.n_tokens * r.max_repeats))
        copies = min(int(quota // r.n_tokens), r.max_repeats)
        rest = 0.0 if copies == r.max_repeats else quota - copies * r.n_tokens
        out[r.source] = {"quota": quota, "copies": copies, "rest": rest}
    # Blocks hold BLOCK_PAGES pages, or as many as keep the number of blocks within what can be drawn from.
    uses = sum(r.n_pages * (out[r.source]["copies"] + 1) for r in usable)
    per_block = max(BLOCK_PAGES, -(-uses // MOST_BLOCKS))
    for r in usable:
        out[r.source]["blocks"] = max(1, -(-r.n_pages // per_block))
    return total, out


def statistics(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target: source, target_share, max_repeats, n_pages, n_tokens.

    Of repeated targets for one source the greatest share and cap hold; null
    sources are no targets.
    """
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    size = pages.groupBy("source").agg(F.count("*").alias("n_pages"), F.sum("n_tokens").alias("n_tokens"))
    return wanted.join(size, "source", "left").na.fill(0, ["n_pages", "n_tokens"])


def mix(pages: DataFrame, targets: DataFrame, total: float | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """shard, place, source, doc_id, copy, n_tokens: every use of a page; place orders a shard.

    ``pages`` is (doc_id, source, n_tokens). Pages of sources without a target
    are not used.
    """
    spark, pages = pages.sparkSession, pages.select("doc_id", "source", "n_tokens")
    _, quota = plan(statistics(pages, targets).collect(), total)  # a row per target
    schema = "shard int, place bigint, source string, doc_id bigint, copy int, n_tokens bigint"
    if not quota:
        return spark.createDataFrame([], schema)
    names = sorted(quota)
    params = spark.createDataFrame([(s, quota[s]["copies"], float(quota[s]["rest"]), quota[s]["blocks"]) for s in names], "source string, copies int, rest double, blocks bigint")
    uses = pages.join(F.broadcast(params), "source").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("copies") - F.when(F.col("rest") > 0, 0).otherwise(1))).alias("copy")
    ).where((F.col("copy") < F.col("copies")) | (F.col("rest") > 0))
    spot = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(_RANGE))
    uses = uses.withColumn("spot", spot).withColumn("block", F.floor(F.col("spot") * F.col("blocks") / F.lit(_RANGE)).cast("bigint"))

    # The rest: whole blocks in order while they fit, then pages of the block that crosses the quota.
    part = uses.where(F.col("copy") == F.col("copies"))
    sums = part.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("size"))
    sums = sums.withColumn("_super", F.floor(F.col("block") / 1024))
    supers = sums.groupBy("source", "_super").agg(F.sum("size").alias("_s"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    supers = supers.withColumn("_from", before(Window.partitionBy("source").orderBy("_super"), "_s")).drop("_s")
    sums = sums.join(supers, ["source", "_super"]).withColumn("start", F.col("_from") + before(Window.partitionBy("source", "_super").orderBy("block"), "size"))
    crossing = sums.where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("size") > F.col("rest")))
    ends = {r.source: (r.block, r.start) for r in crossing.select("source", "block", "start").collect()}  # at most one per source
    # Where the whole partial copy is short of the rest by rounding, all its blocks are used.
    last = spark.createDataFrame([(s, *(ends.get(s) or (quota[s]["blocks"], 0))) for s in names], "source string, end_block bigint, end_start bigint")
    uses = uses.join(F.broadcast(last), "source")
    whole = uses.where((F.col("copy") < F.col("copies")) | (F.col("block") < F.col("end_block")))
    edge = uses.where((F.col("copy") == F.col("copies")) & (F.col("block") == F.col("end_block")))
    w = Window.partitionBy("source").orderBy("spot", "doc_id")  # the pages of one block
    edge = edge.withColumn("_at", F.col("end_start") + before(w, "n_tokens")).where(F.col("_at") + F.col("n_tokens") / 2 <= F.col("rest")).drop("_at")
    used = whole.unionByName(edge)

    # Blocks of a source, numbered over its copies, permuted and dealt by the splitting tree.
    n_blocks = [quota[s]["copies"] * quota[s]["blocks"] + ((ends[s][0] + 1 if s in ends else quota[s]["blocks"]) if quota[s]["rest"] > 0 else 0) for s in names]
    dealt = split_quotas(n_blocks, shards, seed)
    rows = []
    for k, s in enumerate(names):
        # What is in a block is random by the hash of its pages, so any one-to-one order of the blocks is a shuffle.
        rng = np.random.default_rng([seed, k])
        step = next(a for a in range(int(rng.integers(1, n_blocks[k] + 1)), 2 * n_blocks[k] + 2) if gcd(a, n_blocks[k]) == 1)
        rows.append((s, n_blocks[k], step, int(rng.integers(n_blocks[k])), [int(x) for x in np.cumsum(dealt[:, k])]))
    deal = spark.createDataFrame(rows, "source string, n_blocks bigint, step bigint, first bigint, cuts array<bigint>")
    used = used.join(F.broadcast(deal), "source").withColumn("_o", F.pmod((F.col("copy") * F.col("blocks") + F.col("block")) * F.col("step") + F.col("first"), F.col("n_blocks")))
    return used.select(
        F.size(F.filter("cuts", lambda x: x <= F.col("_o"))).alias("shard"),
        F.xxhash64("doc_id", "copy", F.lit(seed + 1)).alias("place"),
        "source", "doc_id", "copy", "n_tokens",
    )


def shares(pages: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per target: what was asked for and what was reached, in tokens."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("used_pages"), (F.max("copy") + 1).cast("bigint").alias("most_repeats"))
    out = statistics(pages, targets).join(got, "source", "left").na.fill(0, ["used_tokens", "used_pages", "most_repeats"])
    everything = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # a row per target
    return out.select(
        "source", "target_share", "max_repeats", "n_pages", "n_tokens", "used_pages", "used_tokens", "most_repeats",
        F.coalesce(F.col("used_tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)).alias("actual_share"),
    )


def write_shards(mixed: DataFrame, path: str) -> None:
    """Writes :func:`mix` as one folder per shard, its files in the order of place, a shard's later files after its earlier."""
    mixed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def counted(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts of the pages that have a target, written once and read by every later step."""
    names = targets.select("source").where("source IS NOT NULL").distinct()
    return cut(token_counts(documents.join(F.broadcast(names), "source", "left_semi"), tokenizer), "tokens")
