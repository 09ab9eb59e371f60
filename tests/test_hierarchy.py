import random

import pytest

from quillgate.operators import hierarchy
from quillgate.plans import problems


def truth(up):
    out = {}
    for n in up:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        out[n] = (seen[-1], len(seen) - 1, 0) if x is None else ("", -1, int(x == n))
    return out


def chain(rng, n):
    return {f"n{i}": f"n{i - 1}" if i else None for i in range(n)}


def loop(rng, n):
    return {f"n{i}": f"n{(i + 1) % n}" for i in range(n)}


def anything(rng, n):
    return {f"n{i}": None if rng.random() < 0.03 else f"n{rng.randrange(n)}" for i in range(n)}


def crowd(rng, n):
    return {f"n{i}": "n0" if i and rng.random() < 0.4 else (f"n{rng.randrange(i)}" if i else None) for i in range(n)} | {"self": "self", "below": "self"}


@pytest.mark.parametrize("shape", [chain, loop, anything, crowd])
@pytest.mark.parametrize("rows_per_task", [25, 10_000])
def test_against_walking_up(spark, shape, rows_per_task):
    up = shape(random.Random(5), 150)
    edges = spark.createDataFrame([(p, c, 1, "r") for c, p in up.items()] * 2, "p string, c string, steps int, root string")
    got = {r.node: (r.root, r.depth, r.on_cycle) for r in hierarchy.solve(edges, "p", "c", rows_per_task).collect()}
    assert got == truth(up)


def test_null_ends_and_empty_edges(spark):
    edges = spark.createDataFrame([("a", None), (None, "b"), (None, None), ("a", "c")], "p string, c string")
    got = sorted(tuple(r) for r in hierarchy.solve(edges, "p", "c").collect())
    assert got == [("a", "a", 0, 0), ("b", "b", 0, 0), ("c", "a", 1, 0)]
    assert hierarchy.solve(spark.createDataFrame([], "p string, c string"), "p", "c").count() == 0


def test_paths_and_descendants(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("x", "y"), ("y", "x")], "p string, c string")
    paths = hierarchy.paths(edges, "p", "c")
    assert {r.node: r.path for r in paths.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "c", "d"], "e": ["a", "e"]}
    assert {r.node: (r.n_descendants, r.n_children) for r in hierarchy.descendant_counts(paths).collect()} == {"a": (4, 2), "b": (2, 1), "c": (1, 1), "d": (0, 0), "e": (0, 0)}


def test_links_below_the_bound_go_through_fragments(spark, monkeypatch):
    levels, inner = [], hierarchy._solve
    monkeypatch.setattr(hierarchy, "_solve", lambda rows, level, bound: levels.append(level) or inner(rows, level, bound))
    edges = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [(f"c{i}", f"c{(i + 1) % 40}") for i in range(40)] + [("c3", "below")]
    got = {r.node: (r.root, r.depth, r.on_cycle) for r in hierarchy.solve(spark.createDataFrame(edges, "p string, c string"), "p", "c").collect()}
    want = {f"n{i}": ("n0", i, 0) for i in range(301)} | {f"c{i}": ("", -1, 1) for i in range(40)} | {"below": ("", -1, 0)}
    assert got == want and levels == [0, 1]


def all_ancestors(up):
    """(node, descendant, distance) by walking up from every node until nothing new comes."""
    out = set()
    for n in up:
        seen, x = [], up[n]
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        out |= {(a, n, i + 1) for i, a in enumerate(seen)}
    return out


@pytest.mark.parametrize("shape", [chain, loop, anything, crowd])
def test_descendant_pairs_in_trees_and_loops(spark, shape):
    up = shape(random.Random(7), 70)
    edges = spark.createDataFrame([(p, c) for c, p in up.items()] * 2, "p string, c string")
    got = [tuple(r) for r in hierarchy.descendant_pairs(hierarchy.ancestors(edges, "p", "c")).collect()]
    assert len(got) == len(set(got)) and set(got) == all_ancestors(up)


def test_descendant_pairs_of_a_crowd_below_a_loop(spark):
    up = {"a": "b", "b": "a"} | {f"n{i}": "a" for i in range(1200)} | {f"m{i}": f"n{i}" for i in range(50)} | {"alone": None}
    edges = spark.createDataFrame([(p, c) for c, p in up.items()] + [(None, None), ("alone", None)], "p string, c string")
    got = [tuple(r) for r in hierarchy.descendant_pairs(hierarchy.ancestors(edges, "p", "c")).collect()]
    assert len(got) == len(set(got)) and set(got) == all_ancestors(up)


def test_descendant_pairs_have_no_rows_without_links(spark):
    for rows in ([], [(None, None), ("a", None), (None, "b")]):
        edges = spark.createDataFrame(rows, "p string, c string")
        assert hierarchy.descendant_pairs(hierarchy.ancestors(edges, "p", "c")).count() == 0


def test_every_looped_node_of_both_graphs_has_descendants(spark, tmp_path):
    pairs = [("a", "b"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "t"), ("s", "s")]
    spark.createDataFrame([(p, c, 0) for p, c in pairs], "src_urn string, dst_urn string, ord int").write.parquet(f"{tmp_path}/lineage.parquet")
    spark.createDataFrame([(c, p) for p, c in pairs], "field_urn string, upstream_urn string").write.parquet(f"{tmp_path}/column_lineage.parquet")
    got = sorted((r.graph, r.node, r.descendant, r.distance) for r in problems.QUERIES["p5_descendant_pairs"](spark, str(tmp_path)).collect())
    one = [("a", "b", 1), ("s", "s", 1), ("x", "t", 3), ("x", "x", 2), ("x", "y", 1), ("x", "z", 2), ("y", "t", 2), ("y", "x", 1), ("y", "y", 2), ("y", "z", 1), ("z", "t", 1)]
    assert got == sorted((g, *r) for g in ("lineage", "column_lineage") for r in one)
