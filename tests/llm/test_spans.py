import random

import numpy as np
import pytest

from quillgate.llm import spans

DOCS = "doc_id bigint, text string, h bigint, start int"


def brute(rows, least):
    texts = {}
    for d, t in rows:
        if d is not None and t is not None:
            texts.setdefault(d, t)
    at = {}
    for d, t in texts.items():
        for i in range(len(t) - least + 1):
            at.setdefault(t[i : i + least], set()).add(d)
    out = {}
    for d, t in texts.items():
        hit = set()
        for i in range(len(t) - least + 1):
            if len(at[t[i : i + least]]) > 1:
                hit |= set(range(i, i + least))
        if hit:
            out[d] = len(hit)
    return out


def run(spark, rows, least, gram):
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], DOCS)
    return {r.doc_id: r.shared_chars for r in spans.covered(spans.windows(df, least, gram), least).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_every_window(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé\n𝄞 ") for _ in range(n))
    shared = [text(rng.choice([29, 30, 31, 80])) for _ in range(8)]
    rows = [(d, "".join(rng.choice([text(rng.randrange(60)), rng.choice(shared)]) for _ in range(6))) for d in range(40)]
    rows += [(100, "-" * 90), (101, "=" + "-" * 50), (102, None), (103, ""), (None, shared[0] * 3), (104, rows[0][1]), (104, rows[0][1])]
    assert run(spark, rows, 30, 10) == brute(rows, 30)


def test_a_boilerplate_on_every_page_and_long_texts(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    notice, book = text(250), text(300_000)
    rows = [(d, text(200) + notice + text(150)) for d in range(60)] + [(100, book), (101, text(500) + book[1000:1300] + text(100))]
    got = run(spark, rows, 200, 48)
    # Chance may lengthen a shared stretch by a few characters at either end.
    assert all(250 <= got[d] <= 260 for d in range(60)) and 300 <= got[100] <= 304 and 300 <= got[101] <= 304
    assert {d: got[d] for d in range(60)} == brute(rows[:60], 200)


def test_first_copy_is_kept(spark):
    t = "".join(random.Random(1).choice("abcdefg") for _ in range(300))
    df = spark.createDataFrame([(1, t, 1, 1), (2, t, 1, 1), (3, t + "x", 1, 1)], DOCS)
    got = {r.doc_id: (r.shared_chars, r.repeated_chars) for r in spans.covered(spans.windows(df)).collect()}
    assert got == {1: (300, 0), 2: (300, 300), 3: (300, 300)}


def test_empty_table(spark):
    assert spans.found(spark.createDataFrame([], DOCS)).count() == 0


def test_hashes_are_of_the_run_alone():
    x = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4], dtype=np.uint32)
    for n in (1, 2, 3, 4):
        h = spans.run_hashes(x, n)
        assert len(h) == len(x) - n + 1 and h[0] == h[5]
        assert len(set(h.tolist())) == len({tuple(x[i : i + n]) for i in range(len(h))})


def test_runs_of_sentences(spark):
    s = [f"Sentence number {i} is here. " for i in range(9)]
    docs = [(1, "".join(s[:6])), (2, "Other words! " + "".join(s[1:5]) + "An end"), (3, "".join(s[6:9]) * 2), (4, None), (5, ""), (None, "".join(s)), (6, "".join(s[:2]))]
    got = {r.doc_id: (r.n_sentences, r.shared_chars, r.repeated_chars) for r in spans.sentence_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    n = len(s[0])
    # Page 3 repeats only itself; 1 is first, 2 has four sentences of it.
    assert got == {1: (6, 4 * n, 0), 2: (6, 4 * n, 4 * n), 3: (6, 0, 3 * n)}
    assert spans.sentence_spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
