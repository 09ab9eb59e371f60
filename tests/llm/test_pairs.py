import random
from collections import Counter
from itertools import combinations

import pytest

from quillgate.llm import pairs

AUDIT = "line_no bigint, request_id string, column_reads map<string, array<string>>, subjects array<string>, dataset string, item string"


def brute(rows, least=1):
    seen = {}
    for line, req, reads, subjects in rows:
        rec = req if req is not None else (f"line {line}" if line is not None else None)
        if rec is None:
            continue
        for k, v in (reads or {}).items():
            for c in v or []:
                if c:
                    seen.setdefault(("column_reads", k, rec), set()).add(c.lower())
        for s in subjects or []:
            if s and s.startswith("column:") and "." in s:
                t, _, c = s[7:].rpartition(".")
                if c:
                    seen.setdefault(("subjects", t, rec), set()).add(c.lower())
    n, one, two = Counter(), Counter(), Counter()
    for (o, d, _), items in seen.items():
        n[o, d] += 1
        for a in items:
            one[o, d, a] += 1
        for a, b in combinations(sorted(items), 2):
            two[o, d, a, b] += 1
    return {(o, d, a, b, m, one[o, d, a], one[o, d, b], n[o, d]) for (o, d, a, b), m in two.items() if m >= least}


@pytest.mark.parametrize("max_heavy", [1, 6, 4096])
def test_against_counting_pairs(spark, max_heavy):
    rng = random.Random(max_heavy)
    cols = [f"C{i}" for i in range(12)] + ["c0", None, ""]
    rows = []
    for i in range(400):
        reads = {rng.choice(["u", "v"]): [rng.choice(cols[: rng.choice([3, 15])]) for _ in range(rng.randrange(6))] for _ in range(2)}
        subjects = [rng.choice(["column:t.a", "column:t.B", "column:x.t.c", "statement:query", None, "column:", "column:t.", "column:none"]) for _ in range(4)]
        rows.append((i, rng.choice([None, f"r{rng.randrange(300)}"]), rng.choice([reads, reads, None]), rng.choice([subjects, None])))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], AUDIT)
    got = {(r.origin, r.dataset, r.column_a, r.column_b, r.n_ab, r.n_a, r.n_b, r.n_records) for r in pairs.scored(df, max_heavy).collect()}
    assert got == brute(rows)


def test_found_and_empty(spark):
    rows = [(i, f"r{i}", {"u": ["a", "b"] if i % 4 == 0 else ["c"]}, None) for i in range(40)] + [(100, "r0", {"u": ["a", "b"]}, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], AUDIT)
    assert [tuple(r) for r in pairs.found(df).collect()] == [("column_reads", "u", "a", "b")]
    assert pairs.found(spark.createDataFrame([], AUDIT)).count() == 0
