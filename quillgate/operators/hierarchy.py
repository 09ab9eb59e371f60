"""Parent-child links to full hierarchies (problem 5).

Nodes with at most one parent form trees and, where links lead back, loops.
One level of the solution:

1. Place rows so that many children meet their parent: a node with a "tail"
   coin goes to its parent's partition if the parent has a "head" coin
   (coins are hashes, so nothing is looked up). A parent with very many
   children is never a head, so it draws no crowd to one task.
2. Inside each partition contract the parent chains by pointer doubling to
   their exit (the first ancestor not in the partition), or to a root, or find
   the loop they end in.
3. The exits are the nodes of a smaller quotient forest, solved the same way.
   The links themselves always go to as many partitions as the session
   shuffles to; a quotient below ``rows_per_task`` rows is solved in one: that
   bound, a parameter, is the only data ever in one task.
4. Expand: root and depth of a node are its exit's, plus its own steps. If an
   exit is on a loop, the fragments that lead from one loop exit to the next
   are walked once more to mark the nodes between.

At least an eighth of the links is contracted per level in expectation, also
in a single long chain, so the number of levels is logarithmic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.operators.skew import join_groups
from quillgate.session import cut

ROWS_PER_TASK = 500_000
OPEN, ROOT, LOOPED, ON_LOOP = 0, 1, 2, 3
LEVEL = "frag int, node string, up string, steps bigint, state int"
SOLVED = "node string, root string, depth bigint, state int"


def _contract(node: np.ndarray, up: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exit (or root), steps to it and state of every row; ``up`` None marks a root."""
    n = len(node)
    index = pd.Index(node)
    to = index.get_indexer(pd.Index(up, dtype=object))
    is_root = np.array([u is None for u in up], dtype=bool)
    to[is_root] = -1
    end = to < 0
    jump = np.where(end, np.arange(n), to)
    far = np.where(end, 0, steps)
    for _ in range(max(1, int(n).bit_length())):
        far = far + far[jump]
        jump = jump[jump]
    stopped = end[jump]
    state = np.where(stopped, np.where(is_root[jump], ROOT, OPEN), LOOPED)
    total = np.where(stopped & ~is_root[jump], far + steps[jump], far)
    exit_ = np.array([None] * n, dtype=object)
    root_rows, open_rows = state == ROOT, state == OPEN
    exit_[root_rows] = node[jump[root_rows]]
    exit_[open_rows] = up[jump[open_rows]]
    # After 2^k >= n steps every pointer of a looped row lies on its loop: those pointed to again are the loop.
    looped = np.flatnonzero(state == LOOPED)
    if len(looped):
        on = np.zeros(n, dtype=bool)
        cur = np.unique(jump[looped])
        while len(cur) and not on[cur].all():
            on[cur] = True
            cur = np.unique(to[cur])
        state[on & (state == LOOPED)] = ON_LOOP
    total[~stopped] = 0
    return exit_, total, state, jump


def _contract_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    d = pd.concat(parts, ignore_index=True)
    node, up = d["node"].to_numpy(dtype=object), d["up"].to_numpy(dtype=object)
    up = np.where(pd.isna(up), None, up)
    exit_, steps, state, _ = _contract(node, up, d["steps"].to_numpy(dtype=np.int64))
    yield pd.DataFrame({"frag": d["frag"], "node": node, "up": exit_, "steps": steps, "state": state.astype(np.int32), "link": up})


def _mark_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes between a loop's entries and their exits, by walking the links of one partition."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    d = pd.concat(parts, ignore_index=True)
    for _, g in d.groupby("frag", sort=False):
        node, link = g["node"].to_numpy(dtype=object), g["link"].to_numpy(dtype=object)
        to = pd.Index(node).get_indexer(pd.Index(link, dtype=object))
        on = np.zeros(len(node), dtype=bool)
        cur = np.flatnonzero(g["entry"].to_numpy(dtype=bool))
        while len(cur):
            on[cur] = True
            cur = np.unique(to[cur])
            cur = cur[cur >= 0]
            cur = cur[~on[cur]]
        yield pd.DataFrame({"node": node[on]})


def _solve(rows: DataFrame, level: int, rows_per_task: int) -> DataFrame:
    """SOLVED of (node, up, steps): state ROOT, LOOPED (leads to a loop) or ON_LOOP."""
    n = rows.count()
    parts = max(1, -(-n // rows_per_task))
    if level == 0:
        parts = max(parts, min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if parts == 1:
        placed = rows.coalesce(1).withColumn("frag", F.lit(0))
    else:
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(2)) == 1
        crowd = max(1000, n // 1000)  # at most 1000 parents have more children than this
        crowded = rows.where("up IS NOT NULL").groupBy("up").count().where(F.col("count") > crowd).select("up", F.lit(True).alias("_crowd"))
        home = F.when(~coin("node") & coin("up") & F.col("_crowd").isNull(), F.col("up")).otherwise(F.col("node"))
        placed = (
            rows.join(F.broadcast(crowded), "up", "left")
            .withColumn("frag", F.pmod(F.xxhash64(home, F.lit(level + 1000)), F.lit(parts)).cast("int"))
            .drop("_crowd")
            .repartition(parts, "frag")
        )
    done = cut(placed.select("frag", "node", "up", "steps").mapInPandas(_contract_part_by_frag, LEVEL + ", link string"), f"level{level}")
    ended = done.where(F.col("state") != OPEN).select(
        "node",
        F.when(F.col("state") == ROOT, F.col("up")).otherwise("").alias("root"),
        F.when(F.col("state") == ROOT, F.col("steps")).otherwise(-1).cast("bigint").alias("depth"),
        "state",
    )
    if parts == 1:
        return ended
    opened = done.where(F.col("state") == OPEN).select("frag", "node", "up", "steps", "link")
    crowds = opened.groupBy("up").agg(F.count("*").alias("_n"))
    needed = crowds.select(F.col("up").alias("node"))
    # The quotient: a needed node stands with its own contracted link; ended ones are roots of it.
    quotient = (
        done.join(needed, "node", "left_semi")
        .where(F.col("state") == OPEN)
        .select("node", "up", "steps")
    )
    closed = ended.join(needed, "node", "left_semi")
    tops = closed.select("node", F.lit(None).cast("string").alias("up"), F.lit(0).cast("bigint").alias("steps"))
    solved = _solve(cut(quotient.unionByName(tops), f"quotient{level}"), level + 1, rows_per_task)
    # A top of the quotient stands for what its own row ended in; a root may have very many rows below it.
    rooted = solved.where(F.col("state") == ROOT)
    below = rooted.groupBy("root").agg(F.count("*").alias("_n"))
    tops_end = closed.select(F.col("node").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("state").alias("_s"))
    tops_end = cut(tops_end.join(below, "root"), f"tops{level}")
    ended_at = join_groups(rooted, tops_end, ["root"], "_n", n).select(
        "node",
        F.col("_r").alias("root"),
        F.when(F.col("_s") == ROOT, F.col("depth") + F.col("_d")).otherwise(-1).cast("bigint").alias("depth"),
        F.when(F.col("_s") == ROOT, ROOT).when((F.col("_s") == ON_LOOP) & (F.col("depth") == 0), ON_LOOP).otherwise(LOOPED).alias("state"),
    )
    solved = ended_at.unionByName(solved.where(F.col("state") != ROOT))
    solved = cut(solved, f"solved{level}")
    exits = solved.select(F.col("node").alias("up"), "root", F.col("depth").alias("_d"), F.col("state").alias("_s"))
    exits = cut(exits.join(crowds, "up"), f"exits{level}")
    through = join_groups(opened, exits, ["up"], "_n", n)
    marks = _marks(through, solved)
    rest = through.join(marks, "node", "left").select(
        "node",
        "root",
        F.when(F.col("_s") == ROOT, F.col("_d") + F.col("steps")).otherwise(-1).cast("bigint").alias("depth"),
        F.when(F.col("_s") == ROOT, ROOT).when(F.col("_on"), ON_LOOP).otherwise(LOOPED).alias("state"),
    )
    return cut(ended.unionByName(rest), f"expanded{level}")


def _contract_part_by_frag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task may hold several fragments; each is contracted on its own."""
    parts = [b for b in batches if len(b)]
    if parts:
        for _, g in pd.concat(parts, ignore_index=True).groupby("frag", sort=False):
            yield from _contract_part(iter([g.reset_index(drop=True)]))


def _marks(through: DataFrame, solved: DataFrame) -> DataFrame:
    """node, _on: nodes of the fragments that lie on a loop running through several fragments."""
    near = through.where(F.col("_s") == ON_LOOP).select("frag", "node", "link")
    entries = solved.where(F.col("state") == ON_LOOP).select("node", F.lit(True).alias("entry"))
    flagged = near.join(entries, "node", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return flagged.repartition("frag").mapInPandas(_mark_part, "node string").distinct().withColumn("_on", F.lit(True))


def links(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """node, up of all named nodes: one row per node, up null for roots.

    Repeated edges count once; an edge with a null end only names the other
    node. If a child had several parents, the smallest would hold.
    """
    named = edges.select(F.explode(F.array(F.struct(F.col(child).alias("node"), F.col(parent).alias("up")), F.struct(F.col(parent).alias("node"), F.lit(None).cast("string").alias("up")))).alias("l"))
    return named.select("l.node", "l.up").where("node IS NOT NULL").groupBy("node").agg(F.min("up").alias("up"))


def solve(edges: DataFrame, parent: str, child: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """node, root, depth, on_cycle of every node; '' and -1 where the parents never end."""
    rows = cut(links(edges, parent, child).withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint")), "links")
    s = _solve(rows, 0, rows_per_task)
    return s.select("node", "root", "depth", (F.col("state") == ON_LOOP).cast("bigint").alias("on_cycle"))


def paths(edges: DataFrame, parent: str, child: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """node, root, depth, path (array from the root to the node) for nodes of trees.

    The path is built by doubling: a node's known piece is put behind its far
    end's piece, so the number of joins is the logarithm of the greatest depth.
    Nodes in or below a loop have no path and are left out.
    """
    solved = cut(solve(edges, parent, child, rows_per_task), "solved")
    tree = solved.where("depth >= 0")
    greatest = tree.agg(F.max("depth")).first()[0] or 0
    at = cut(links(edges, parent, child).join(tree, "node").select("node", "root", "depth", F.col("up").alias("far"), F.array("node").alias("path")), "paths")
    for _ in range(int(greatest).bit_length()):
        # Rows that have reached their root stay out of the join; far ends with very many rows are joined apart.
        going = at.where(F.col("far").isNotNull())
        sizes = going.groupBy("far").agg(F.count("*").alias("_n"))
        ends = at.select(F.col("node").alias("far"), F.col("far").alias("_far"), F.col("path").alias("_path"))
        ends = cut(ends.join(sizes, "far"), "ends")
        longer = join_groups(going, ends, ["far"], "_n", going.count()).select("node", "root", "depth", F.col("_far").alias("far"), F.concat("_path", "path").alias("path"))
        at = cut(at.where(F.col("far").isNull()).unionByName(longer), "paths")
    return at.select("node", "root", "depth", "path")


def descendants(pathed: DataFrame) -> DataFrame:
    """node, descendant, distance: every pair of a node and one below it."""
    return (
        pathed.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("_at", "node"))
        .where(F.col("_at") < F.col("depth"))
        .select("node", "descendant", (F.col("depth") - F.col("_at")).cast("bigint").alias("distance"))
    )


def ancestors(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """node, walk (array of its ancestors, nearest first) of every named node, in trees and in or below loops.

    Built by doubling like the paths. A walk that meets an ancestor again has
    gone round its loop and holds all of them; a node on a loop is the last of
    its own ancestors.
    """
    at = cut(links(edges, parent, child).select("node", F.col("up").alias("far"), F.array_compact(F.array("up")).alias("walk")), "walks")
    while True:
        # As in ``paths``: what is done stays out of the join, far ends with very many rows are joined apart.
        going = at.where(F.col("far").isNotNull())
        total = going.count()
        if not total:
            return at.select("node", "walk")
        sizes = going.groupBy("far").agg(F.count("*").alias("_n"))
        ends = at.select(F.col("node").alias("far"), F.col("far").alias("_far"), F.col("walk").alias("_walk"))
        ends = cut(ends.join(sizes, "far"), "ends")
        longer = join_groups(going, ends, ["far"], "_n", total).withColumn("_both", F.array_distinct(F.concat("walk", "_walk")))
        longer = longer.select(
            "node", F.when(F.size("_both") == F.size("walk") + F.size("_walk"), F.col("_far")).alias("far"), F.col("_both").alias("walk")
        )
        at = cut(at.where(F.col("far").isNull()).unionByName(longer), "walks")


def descendant_pairs(walks: DataFrame) -> DataFrame:
    """node, descendant, distance (least steps): as ``descendants``, of all nodes of ``ancestors``."""
    return walks.select(F.posexplode("walk").alias("_at", "node"), F.col("node").alias("descendant")).select("node", "descendant", (F.col("_at") + 1).cast("bigint").alias("distance"))


def descendant_counts(pathed: DataFrame) -> DataFrame:
    """node, n_descendants, n_children of every node that has a path."""
    below = descendants(pathed).groupBy("node").agg(F.count("*").alias("n_descendants"), F.count_if(F.col("distance") == 1).alias("n_children"))
    return pathed.select("node", "root", "depth").join(below, "node", "left").na.fill(0, ["n_descendants", "n_children"])


def found(lineage: DataFrame, column_lineage: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    both = [("lineage", lineage, "src_urn", "dst_urn"), ("column_lineage", column_lineage, "upstream_urn", "field_urn")]
    out = None
    for graph, edges, parent, child in both:
        s = solve(edges, parent, child, rows_per_task).select(
            F.lit(graph).alias("graph"), F.col("node").alias("node_urn"), F.col("root").alias("root_urn"), "depth", "on_cycle"
        )
        out = s if out is None else out.unionByName(s)
    return out
