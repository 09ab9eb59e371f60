import random

import numpy as np
import pytest

from quillgate.llm import leaks

DOCS = "doc_id bigint, text string, letters string, term int"
ITEMS = "item_id bigint, text string, answer string"
PARTS = "bal cor dun el fen gar hal jor kel lan mel nor ol par ral sol tor ul val wen yar zel".split()


def word(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.choice([2, 2, 3]))) + rng.choice(["er", "ing", "ed", "al", ""])


def lines(words, width=4):
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def noisy(rng, text, rate):
    swap = {"e": "c", "l": "1", "o": "0", "n": "u", "m": "rn", "h": "b", "i": "l"}
    return "".join(swap.get(c, c) if rng.random() < rate else c for c in text)


@pytest.fixture(scope="module")
def corpus():
    """Pages with 18-word items: whole, 12 words, 9 words, or none; clean, misread, interleaved, broken."""
    rng = random.Random(4)
    common = [word(rng) for _ in range(400)]
    items = [[rng.choice(common) if rng.random() < 0.3 else word(rng) for _ in range(18)] for _ in range(40)]
    pages, truth = [], set()
    for d in range(300):
        body = lines([rng.choice(common) for _ in range(200)])
        if d % 2:
            i, n = rng.randrange(40), rng.choice([18, 14, 12, 9, 9])
            start = rng.randrange(18 - n + 1)
            part = lines(items[i][start : start + n], 3)
            how = rng.choice(["plain", "misread", "interleaved", "broken"])
            if how == "misread":
                part = [noisy(rng, x, 0.04) for x in part]
            if how == "broken":
                part = [x[:-3] + "-\n" + x[-3:] for x in part]
            at = rng.randrange(len(body) - 12)
            if how == "interleaved":
                mixed = []
                for k, x in enumerate(part):
                    mixed += [x, body[at + k]]
                body[at : at + len(part)] = mixed
            else:
                body[at:at] = part
            if n >= 12:
                truth.add((d, i))
        pages.append((d, "\n".join(body), "x", 1))
    return pages, [(i, " ".join(w).capitalize() + ".", "a") for i, w in enumerate(items)], truth


def test_found_against_planted(spark, corpus):
    pages, items, truth = corpus
    got = {tuple(r) for r in leaks.found(spark.createDataFrame(pages, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(got & truth) >= 0.97 * len(truth)
    assert len(got - truth) <= 0.03 * len(truth)


def test_candidate_search_recall_against_every_pair(spark, corpus):
    """The exhaustive check of all pages and items, against the pairs the latent search offers it."""
    pages, items, truth = corpus
    fold = leaks.fold_table()
    take = pages[:80]
    codes, ends = leaks.letter_stream([p[1] for p in take], fold)
    of_page = np.split(codes, ends[:-1])
    of_item = [leaks.letter_stream([t], fold)[0] for _, t, _ in items]
    every = {(p[0], i) for p, x in zip(take, of_page) for i, y in enumerate(of_item) if leaks.longest_word_run(y, x) >= 12}
    hits = leaks.search(spark.createDataFrame(pages, DOCS), spark.createDataFrame(items, ITEMS))
    offered = {(r.doc_id, r.item_id) for r in hits.collect()}
    assert len(every & offered) >= 0.95 * len(every) > 0


def test_item_on_a_third_of_all_pages(spark, corpus):
    pages, items, _ = corpus
    rng = random.Random(8)
    leaked = [(d, t + "\n" + noisy(rng, items[3][1], 0.03), "x", 1) if d % 3 == 0 else (d, t, "x", 1) for d, t, _, _ in pages]
    got = {r.doc_id for r in leaks.found(spark.createDataFrame(leaked, DOCS), spark.createDataFrame(items, ITEMS)).where("item_id = 3").collect()}
    assert len({d for d in range(0, 300, 3)} - got) <= 2


def test_letters_join_broken_and_split_words():
    fold = leaks.fold_table()
    a, _ = leaks.letter_stream(["Al-\npha  BÉTA\n9ama, d0t"], fold)
    b, _ = leaks.letter_stream(["alpha beta gama dot"], fold)
    assert ((a & leaks.LETTER) == (b & leaks.LETTER)).all()
    words = lambda x: int(((x & leaks.WORD) > 0).sum())
    assert (words(a), words(b)) == (4, 4)


def test_nulls_empty_and_very_long_texts(spark, corpus):
    pages, items, _ = corpus
    first = items[0][1]
    odd = [(1, None, "x", 1), (2, "", "x", 1), (None, first, "x", 1), (4, "\n".join(p[1] for p in pages) * 3 + "\n" + first, "x", 1), (5, first, "x", 1), (5, first, "x", 1), (6, "!!! ...", "x", 1)]
    got = {tuple(r) for r in leaks.found(spark.createDataFrame(odd, DOCS), spark.createDataFrame([items[0], (7, None, None), (8, "", None), (None, first, "a")], ITEMS)).collect()}
    assert {(4, 0), (5, 0)} <= got and all(i == 0 for _, i in got)
    assert leaks.found(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert leaks.found(spark.createDataFrame(odd, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_part_of_an_item_on_a_third_of_all_pages(spark, corpus):
    """Thirteen words of a longer item on every third page, nothing else of it anywhere."""
    pages, items, _ = corpus
    rng = random.Random(9)
    text = [word(rng) for _ in range(25)]
    part = "\n".join(lines(text[12:], 4))
    leaked = [(d, noisy(rng, part, 0.03) + "\n" + t if d % 3 == 0 else t, "x", 1) for d, t, _, _ in pages]
    got = {r.doc_id for r in leaks.found(spark.createDataFrame(leaked, DOCS), spark.createDataFrame([*items, (99, " ".join(text), "a")], ITEMS)).where("item_id = 99").collect()}
    assert len({d for d in range(0, 300, 3)} - got) <= 2 and all(d % 3 == 0 for d in got)


@pytest.fixture(scope="module")
def long_corpus():
    """Pages with 12 words of items of 20 to 160 words, 300 items: clean, poorly scanned, in the lines of another column, or both."""
    rng = random.Random(11)
    common = [word(rng) for _ in range(400)]
    other = lambda: "".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") for _ in range(rng.choice([2, 3, 3])))
    items = [[rng.choice(common) if rng.random() < 0.1 else other() for _ in range(rng.choice([20, 60, 110, 160]))] for _ in range(300)]
    pages, kind = [], {}
    for d in range(120):
        body = lines([rng.choice(common) for _ in range(200)])
        i, how = rng.randrange(300), ("clean", "poor", "interleaved", "both")[d % 4]
        start = rng.randrange(len(items[i]) - 11)
        part = lines(items[i][start : start + 12], 3)
        if how in ("poor", "both"):
            part = [noisy(rng, x, 0.15) for x in part]
        at = rng.randrange(len(body) - 20)
        body[at:at] = [y for x, z in zip(part, body) for y in (x, z)] if how in ("interleaved", "both") else part
        pages.append((d, "\n".join(body), "x", 1))
        kind[d] = (i, how)
    return pages, [(i, " ".join(w), "a") for i, w in enumerate(items)], kind


def test_twelve_words_of_long_items(spark, long_corpus):
    """The search offers every pair that the exhaustive check accepts, whatever the item's length and the scan."""
    pages, items, kind = long_corpus
    fold = leaks.fold_table()
    letters = lambda t: leaks.letter_stream([t], fold)[0]
    of_item = {i: letters(t) for i, t, _ in items}
    true = {(d, kind[d][0]) for d, t, _, _ in pages if leaks.longest_word_run(of_item[kind[d][0]], letters(t)) >= leaks.LEAST_WORDS}
    got = {tuple(r) for r in leaks.found(spark.createDataFrame(pages, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    for how in ("clean", "poor", "interleaved", "both"):
        want = {p for p in true if kind[p[0]][1] == how}
        assert len(want & got) >= 0.98 * len(want) > 0


LENGTHS, AMOUNTS = (18, 40, 80, 200, 800, 1500), ("whole", "half", 20, 12)


@pytest.fixture(scope="module")
def by_length():
    """Six items of every length, each planted whole, half, 20 and 12 words of it on a page of its own, among clean pages."""
    rng = random.Random(21)
    common = [word(rng) for _ in range(600)]
    items, pages, truth = [], [], {}
    for n in LENGTHS:
        for _ in range(6):
            text = [rng.choice(common) if rng.random() < 0.3 else word(rng) for _ in range(n)]
            for amount in AMOUNTS:
                m = min(n, {"whole": n, "half": max(12, n // 2)}.get(amount, amount))
                a = rng.randrange(n - m + 1)
                body = [rng.choice(common) for _ in range(250)]
                at = rng.randrange(len(body))
                truth[len(pages), len(items)] = (n, amount)
                pages.append((len(pages), "\n".join(lines(body[:at] + text[a : a + m] + body[at:], 6)), "x", 1))
            items.append((len(items), " ".join(text), "a"))
    pages += [(len(pages) + k, "\n".join(lines([rng.choice(common) for _ in range(250)], 6)), "x", 1) for k in range(200)]
    return pages, items, truth


def test_recall_by_length_of_item(spark, by_length):
    pages, items, truth = by_length
    hits = leaks.search(spark.createDataFrame(pages, DOCS), spark.createDataFrame(items, ITEMS))
    got = {(r.doc_id, r.item_id) for r in hits.where("n_words >= 12").collect()}
    recall = {}
    for n in LENGTHS:
        for amount in AMOUNTS:
            want = {k for k, v in truth.items() if v == (n, amount)}
            recall[n, amount] = len(want & got) / len(want)
    assert min(recall.values()) >= 0.95
    assert len(got - set(truth)) <= 0.05 * len(truth)


def test_parts_and_pieces_lose_nothing(spark, corpus, monkeypatch):
    """Several parts, and an item of 300 words in pieces, planted across the pieces' edges."""
    pages, items, truth = corpus
    rng = random.Random(31)
    text = [word(rng) for _ in range(300)]
    docs = [p for p in pages if p[0] < 60] + [(1000 + k, pages[0][1] + "\n" + " ".join(text[a : a + 13]), "x", 1) for k, a in enumerate(range(0, 288, 16))]
    monkeypatch.setattr(leaks, "PART_PASSAGES", 25)
    monkeypatch.setattr(leaks, "PIECE_WORDS", 100)
    got = {tuple(r) for r in leaks.found(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, (99, " ".join(text), "a")], ITEMS)).collect()}
    want = {p for p in truth if p[0] < 60} | {(1000 + k, 99) for k in range(18)}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 2


def test_very_long_page_in_windows_finds_what_the_whole_page_does(by_length):
    pages, items, truth = by_length
    fold = leaks.fold_table()
    letters = lambda t: leaks.letter_stream([t], fold)[0]
    page = letters("\n".join(p[1] for p in pages[:60]))
    item = letters(" ".join(items[0][1].split()[:18]))
    at = [leaks.BLOCK * k for k in range(len(page) // leaks.BLOCK)]
    assert leaks._windows(at, len(page), len(item)) != {(0, len(page))}
    whole = leaks.word_cover(item, page)
    windows = [leaks.word_cover(item, page[a:z]) for a, z in leaks._windows(at, len(page), len(item))]
    assert max(r for r, _ in windows) >= whole[0] >= 12
    assert all(z - a <= 2 * 102 * (len(item) + leaks.BLOCK) for a, z in leaks._windows(at, len(page), len(item)))


def test_reworded_items_need_the_answer(spark, corpus):
    pages, items, _ = corpus
    words = items[5][1].rstrip(".").split()
    changed = " ".join(w if k % 5 else "zzzzq" for k, w in enumerate(words))
    docs = [(1, pages[0][1] + "\n" + changed + "\nmoltan", "x", 1), (2, pages[2][1] + "\n" + changed, "x", 1), (3, pages[4][1], "x", 1)]
    hits = leaks.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, items[5][1], "Moltan.")], ITEMS))
    assert [tuple(r) for r in leaks.reworded(hits).select("doc_id", "item_id").collect()] == [(1, 5)]
