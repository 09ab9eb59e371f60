"""Evaluation texts leaking into a corpus (problem 8).

Latent semantic retrieval over passages:

1. Every page becomes its stream of letters (case, punctuation, white space
   and accents gone, look-alike digits read as letters), so broken, split and
   joined words leave no trace. A page's passages are windows of two blocks of
   ``BLOCK`` letters, one block apart, over the whole page; an item's are
   ``PASSAGE`` words, ``PASSAGE_STEP`` apart, so any ``LEAST_WORDS`` consecutive
   words lie in one of them, however long the item is.
2. Terms are letter 5-grams that occur in the items, weighted TF-IDF with
   document frequencies counted over all passages; those in more than
   ``MAX_DF`` of the blocks are stop terms, but of every run of
   ``LEAST_WORDS`` words of an item the ``RUN_TERMS`` rarest keep their weight.
3. A randomised SVD of the TF-IDF matrix gives the latent space. Partial
   products M^T(M X) are computed in the tasks and summed by an aggregate. The
   space is fitted on pages of a documented, bounded sample (``FIT_PAGES``)
   and all items; all pages are projected and searched.
4. A page is a candidate for an item by its passages in the latent space: by
   the cosine to one of the item's, and by holding a share of the weight of
   that one's lightest run of ``LEAST_WORDS`` words. Recall of this step
   against the exhaustive check is measured in the tests.
5. A longest-common-subsequence check on each candidate page: exact runs of
   letters are chained in the order of both texts; between two runs there may
   be misread letters, or lines of other matter. The words of the item covered
   by the chain give the longest run of consecutive words, and how many stand
   there in all. Long items are checked in sections of ``SECTION`` words.
6. An answer check: whether the item's answer stands on the page too, which
   tells reworded items from chance (:func:`reworded`).

No step shuffles text or compares pages with each other. A space of ``RANK``
dimensions can tell about as many passages apart, so the evaluation set is
searched in parts of about ``PART_PASSAGES`` passages, as many as it needs; a
part's letters, terms and latent base are all that is sent to tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.session import cut

GRAM, BLOCK = 5, 250
PASSAGE, PASSAGE_STEP, SECTION, SECTION_STEP = 26, 12, 60, 40
PART_PASSAGES, PIECE_WORDS = 320, 200
MAX_DF, FLOOR_DF, RUN_TERMS = 0.005, 50, 24
FIT_PAGES, FIT_TASKS, RANK, EXTRA = 3000, 4, 320, 16
LEAST_COSINE, LEAST_SHARE, LEAST_WORDS = 0.4, 0.3, 12
SLICE, CELLS = 1_000_000, 8_000_000
JUMP, TURN, MISSING, COLUMNS = 4.0, 9.0, 14, 64

# Digits and signs that scanners give for letters.
LOOK_ALIKES = {"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "|": "l", "!": "l", "ß": "s", "ſ": "s", "æ": "a", "œ": "o", "ø": "o"}

WORD, PIECE, LETTER = 32, 64, 31


def fold_table() -> np.ndarray:
    """Letter code (1-26 Latin, 27-31 other letters, 0 none) of every BMP character."""
    out = np.zeros(0x10000, dtype=np.uint8)
    for i in range(0x10000):
        ch = chr(i)
        base = LOOK_ALIKES.get(ch)
        if base is None and ch.isalpha():
            base = unicodedata.normalize("NFD", ch.lower())[0]
            base = LOOK_ALIKES.get(base, base)
        if base is not None:
            out[i] = ord(base) - 96 if "a" <= base <= "z" else 27 + i % 5
    return out


def letter_stream(texts: list[str], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the letters of all texts, with WORD and PIECE start bits, and each text's end."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    raw = np.minimum(raw, 0xFFFF)
    code = fold[raw]
    letter = code > 0
    at, ends = np.flatnonzero(letter), np.cumsum(sizes)
    starts, ends = np.searchsorted(at, ends - sizes), np.searchsorted(at, ends)
    if not len(at):
        return np.zeros(0, dtype=np.uint8), ends
    # What is no letter counts for the letter behind it.
    behind = np.cumsum(letter, dtype=np.int32)
    count = lambda hit: np.bincount(behind[np.flatnonzero(hit)], minlength=len(at) + 1)[: len(at)]
    blanks, lines = count((raw == 32) | (raw == 9)), count((raw == 10) | (raw == 13))
    first = np.zeros(len(at), dtype=bool)
    first[starts[starts < len(at)]] = True
    gap = np.flatnonzero(blanks + lines)
    after, nb, nl = raw[at[gap - 1] + 1], blanks[gap], lines[gap]
    broken = (nl > 0) & ((after == 45) | (after == 0xAC) | (after == 0xAD)) & ~first[gap]
    out = code[at]
    out[gap[~broken]] |= WORD
    out[gap[(nl > 0) | (nb > 1)]] |= PIECE
    out[first] |= WORD | PIECE
    return out, ends


def _grams(x: np.ndarray) -> np.ndarray:
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    g = np.zeros(n, dtype=np.int64)
    for k in range(GRAM):
        g = (g << 5) | x[k : k + n]
    return g


def _distinct(key: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting."""
    key = np.sort(key)
    return key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key


def _slices(rows: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, r in enumerate(rows):
        size += len(r)
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(rows):
        yield start, len(rows)


def _terms(rows: list[bytes], look: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, term) pairs, distinct and sorted, of some pages; first block and number of blocks of each page."""
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    n_blocks = np.maximum(1, -(-sizes // BLOCK))
    first = np.r_[0, np.cumsum(n_blocks)[:-1]]
    x = np.frombuffer(b"".join(rows), dtype=np.uint8) & LETTER
    g = _grams(x)
    if not len(g):
        none = np.zeros(0, dtype=np.int64)
        return none, none, first, n_blocks
    term = look[g]
    at = np.flatnonzero(term >= 0)
    start = np.r_[0, np.cumsum(sizes)]
    page = np.repeat(np.arange(len(rows)), sizes)[at]
    inside = at + GRAM <= start[page + 1]
    at, page = at[inside], page[inside]
    block = first[page] + (at - start[page]) // BLOCK
    key = _distinct(block * width + term[at])
    return key // width, key % width, first, n_blocks


def _spans(n: int, size: int, step: int) -> list[tuple[int, int]]:
    """Stretches of ``size``, one every ``step``, that cover 0 to n; the last one may be shorter."""
    return [(a, min(n, a + size)) for a in range(0, max(1, n - size + step), step)]


def _look(state: dict) -> np.ndarray:
    """Term of every possible gram, -1 for none; made once per worker, as a broadcast's value stays there."""
    if "look" not in state:
        keep, grams = state["keep"], state["grams"]
        out = np.full(1 << (5 * GRAM), -1, dtype=np.int32)
        out[grams[keep]] = np.flatnonzero(keep)
        state["look"] = out
    return state["look"]


class Items:
    """Evaluation items as letters: sections of items, to be checked, and passages of sections, to be searched."""

    def __init__(self, rows: list, fold: np.ndarray):
        codes, ends = letter_stream([r.text or "" for r in rows], fold) if rows else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        answers, to = letter_stream([r.answer or "" for r in rows], fold) if rows else (codes, ends)
        self.ids, self.letters, self.answers, passages, section = [], [], [], [], []
        for k, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends) if rows else []):
            x = codes[lo:hi]
            bounds = np.r_[np.flatnonzero(x & WORD), len(x)]
            for a, z in _spans(len(bounds) - 1, SECTION, SECTION_STEP) if len(x) else []:
                for c, e in _spans(z - a, PASSAGE, PASSAGE_STEP):
                    passages.append(x[bounds[a + c] : bounds[a + e]])
                    section.append(len(self.ids))
                self.ids.append(rows[k].item_id)
                self.letters.append(x[bounds[a] : bounds[z]])
                self.answers.append((answers[to[k - 1] if k else 0 : to[k]] & LETTER).tobytes())
        self.section = np.array(section, dtype=np.int64)
        every = [_grams((x & LETTER).astype(np.int64)) for x in passages]
        self.grams = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
        self.n_terms = len(self.grams)
        # The term at every place of every passage, one behind the other, and the places of each run of LEAST_WORDS words.
        self.begin = np.r_[0, np.cumsum([len(g) for g in every])].astype(np.int64)
        self.places = np.searchsorted(self.grams, np.concatenate(every)) if every else np.zeros(0, np.int64)
        self.terms = [np.unique(self.places[a:z]) for a, z in zip(self.begin, self.begin[1:])]
        lows, highs, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(every), dtype=np.int64)
        for q, x in enumerate(passages):
            bounds = np.r_[np.flatnonzero(x & WORD), len(x)]
            if len(bounds) > LEAST_WORDS:
                lo = bounds[:-LEAST_WORDS]
                lows.append(self.begin[q] + lo)
                highs.append(self.begin[q] + np.maximum(lo, bounds[LEAST_WORDS:] - GRAM + 1))
                count[q] = len(lo)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.first_run = np.r_[0, np.cumsum(count)]

    def matrix(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, term) pairs without stop terms."""
        row, col = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms]), np.concatenate(self.terms)
        ok = idf[col] > 0
        return row[ok], col[ok]


def streams(documents: DataFrame, fold: np.ndarray) -> DataFrame:
    """doc_id and the page's letter stream; a null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for a, z in _slices(texts):
                codes, ends = letter_stream(texts[a:z], fold)
                data = codes.tobytes()
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[a:z], "letters": [data[i:j] for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]})

    return cut(documents.select("doc_id", "text").where("doc_id IS NOT NULL").mapInPandas(run, "doc_id bigint, letters binary"), "letters")


def frequencies(pages: DataFrame, items: Items) -> tuple[np.ndarray, int, int]:
    """Number of blocks with each term, of all blocks and of all pages. Collects one row per term."""
    width = items.n_terms
    sent = pages.sparkSession.sparkContext.broadcast({"grams": items.grams, "keep": np.ones(width, dtype=bool)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _look(sent.value)
        df, n, m = np.zeros(width, dtype=np.int64), 0, 0
        for b in batches:
            rows = list(b["letters"])
            for a, z in _slices(rows):
                _, term, _, n_blocks = _terms(rows[a:z], look, width)
                df += np.bincount(term, minlength=width)
                n += int(n_blocks.sum())
                m += z - a
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[hit, -1, -2], "n": np.r_[df[hit], n, m]})

    total = {r.term: r.n for r in pages.select("letters").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(width, dtype=np.int64)
    for t, n in total.items():
        if t >= 0:
            df[t] = n
    sent.destroy()
    return df, total.get(-1, 0), total.get(-2, 0)


def weights(items: Items, df: np.ndarray, n_blocks: int) -> np.ndarray:
    """Inverse document frequency of every term, 0 for stop terms."""
    keep = df <= max(FLOOR_DF, MAX_DF * n_blocks)
    for a, z in zip(items.low, items.high):
        t = np.unique(items.places[a:z])
        keep[t[np.argsort(df[t], kind="stable")[:RUN_TERMS]]] = True
    return np.where(keep, np.log((2 + n_blocks) / (1 + df)), 0).astype(np.float32)


def _product(row: np.ndarray, col: np.ndarray, val: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
    """Sparse (row-sorted) times dense; ``x`` must lie row by row, as take copies it otherwise."""
    out = np.zeros((n_rows, x.shape[1]), dtype=np.float32)
    if len(row):
        starts = np.flatnonzero(np.r_[True, np.diff(row) > 0])
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(row)]):
            out[row[a]] = np.einsum("i,ij->j", val[a:z], x.take(col[a:z], 0))
    return out


def _normal_product(row: np.ndarray, col: np.ndarray, val: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
    """M^T (M x)."""
    y = _product(row, col, val, x, n_rows)
    order = np.argsort(col, kind="stable")
    return _product(col[order], row[order], val[order], y, x.shape[0])


def _weighted(block: np.ndarray, term: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF values of (block, term) pairs, each block of length 1."""
    w = idf[term]
    length = np.sqrt(np.bincount(block, weights=w * w, minlength=n))
    return (w / np.maximum(length[block], 1e-6)).astype(np.float32)


def fit_sample(pages: DataFrame, n_pages: int) -> DataFrame:
    """About FIT_PAGES pages, by hash, in FIT_TASKS tasks: bounded, so the partial products of the fit are too."""
    rate = min(1.0, FIT_PAGES / max(1, n_pages))
    sample = pages.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(rate * 1_000_000)).select("letters")
    return cut(sample.repartition(FIT_TASKS), "fit")


def latent_base(sample: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms x rank) by randomised subspace iteration.

    The items' rows are weighted so that together they count as much as the
    sampled passages; else rare items would fall out of the space.
    """
    n_terms, n_passages = items.n_terms, len(items.terms)
    width = min(rank + EXTRA, n_terms)
    rng = np.random.default_rng(7)
    base = np.ascontiguousarray(np.linalg.qr(rng.standard_normal((n_terms, width)))[0], dtype=np.float32)
    row, col = items.matrix(idf)
    val = _weighted(row, col, idf, n_passages)
    context = sample.sparkSession.sparkContext
    chunk = 512

    def partials(sent):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            look, weights, x = _look(sent.value), sent.value["idf"], sent.value["x"]
            z, n = np.zeros(x.shape, dtype=np.float32), 0
            for b in batches:
                rows = list(b["letters"])
                for i, j in _slices(rows):
                    block, term, _, n_blocks = _terms(rows[i:j], look, n_terms)
                    m = int(n_blocks.sum())
                    n += m
                    if len(block):
                        z += _normal_product(block, term, _weighted(block, term, weights, m), x, m)
            if n:
                for k in range(0, len(z), chunk):
                    yield pd.DataFrame({"k": [k], "z": [z[k : k + chunk].tobytes()], "n": [n]})

        return run

    def add(g: pd.DataFrame) -> pd.DataFrame:
        z = np.sum([np.frombuffer(x, dtype=np.float32) for x in g["z"]], axis=0, dtype=np.float32)
        return pd.DataFrame({"k": g["k"].iloc[:1], "z": [z.tobytes()], "n": [int(g["n"].sum())]})

    z = base
    for _ in range(2):
        sent = context.broadcast({"grams": items.grams, "keep": idf > 0, "idf": idf, "x": base})
        sums = sample.mapInPandas(partials(sent), "k bigint, z binary, n bigint").groupBy("k").applyInPandas(add, "k bigint, z binary, n bigint")
        z, n = np.zeros(base.shape, dtype=np.float32), 0
        for r in sums.collect():  # terms x rank numbers, whatever the corpus
            part = np.frombuffer(bytes(r.z), dtype=np.float32).reshape(-1, width)
            z[r.k : r.k + len(part)] = part
            n = r.n
        z = z + max(1.0, n / max(1, n_passages)) * _normal_product(row, col, val, base, n_passages)
        base = np.ascontiguousarray(np.linalg.qr(z)[0], dtype=np.float32)
        sent.destroy()
    # Rotation of the base to singular vectors: for a converged subspace Z = M^T M base holds the singular values.
    order = np.argsort(-np.linalg.norm(z @ (z.T @ base), axis=0)) if z.size else np.arange(width)
    return np.ascontiguousarray(base[:, order[:rank]])


def _windows(places: list[int], size: int, letters: int) -> set[tuple[int, int]]:
    """Stretches of a page to check for hits at ``places``: the page, or windows of a very long one.

    A chain's costs are less than the letters of the section, and a letter of
    distance on the page costs a hundredth, so no chain spans more than
    ``span`` letters and each lies whole in one of the windows.
    """
    span = 102 * (letters + BLOCK)
    if size <= 2 * span:
        return {(0, size)}
    near = {k for p in places for k in (p // span - 1, p // span) if k >= 0}
    return {(k * span, min(size, (k + 2) * span)) for k in near}


def _lcs(a: list[int], b: list[int]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for k, y in enumerate(b):
            above = row[k + 1]
            if x == y:
                row[k + 1] = diagonal + 1
            elif row[k] > above:
                row[k + 1] = row[k]
            diagonal = above
    return row[-1]


def _runs(item: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal equal stretches of at least GRAM letters: start in item, in page, length; in item order."""
    ga, gb = _grams(item.astype(np.int64)), _grams(page.astype(np.int64))
    by = np.argsort(ga, kind="stable")
    lo, hi = np.searchsorted(ga[by], gb, "left"), np.searchsorted(ga[by], gb, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(gb)), n)
    i = by[np.repeat(lo, n) + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)]
    d = j - i
    o = np.lexsort((j, d))
    d, j = d[o], j[o]
    new = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(j) != 1)]) if len(j) else np.zeros(0, np.int64)
    length = np.r_[new[1:], len(j)] - new + GRAM - 1
    j0 = j[new]
    i0 = j0 - d[new]
    o = np.lexsort((j0, i0))
    return i0[o], j0[o], length[o]


def _chain(i0: np.ndarray, j0: np.ndarray, size: np.ndarray, tail: np.ndarray, head: np.ndarray) -> list[int]:
    """The runs of the best chain, in order of the item.

    A run follows only runs that end at most MISSING letters of the item before
    it, so the gains are computed for some columns at a time and those only.
    """
    n, i1, j1 = len(size), i0 + size, j0 + size
    score, back = size.astype(np.float64), np.full(n, -1)
    for start in range(1, n, COLUMNS):
        stop = min(n, start + COLUMNS)
        rows = np.flatnonzero(i1[: stop - 1] >= i0[start] - MISSING)
        a, b = rows[:, None], np.arange(start, stop)[None, :]
        behind = j1[b] <= j0[a]
        ok = (a < b) & (i0[a] < i0[b]) & (i1[a] < i1[b]) & (behind | (j0[a] < j0[b]) & (j1[a] < j1[b]))
        gi, gj = i0[b] - i1[a], j0[b] - j1[a]
        over = np.maximum(0, np.maximum(-gi, np.where(behind, 0, -gj)))
        gi, gj = gi + over, gj + over
        # What the item has between two runs should stand, misread, between them and their edges.
        stray = np.abs(gi - tail[a] - head[b])
        misread = ~behind & (np.abs(gi - gj) <= 3) & (np.maximum(gi, gj) <= MISSING + 2)
        jump = JUMP + 0.5 * gi + 0.01 * gj + np.minimum(10, 0.8 * np.maximum(0, stray - 2))
        # From the foot of a column to the head of the next, where columns were read across each other.
        turn = np.where(stray > 6, np.inf, TURN + 0.5 * gi - 0.01 * gj)
        cost = np.where(misread, 0.5 * np.maximum(gi, gj), np.where(gi > MISSING, np.inf, np.where(behind, turn, jump)))
        gain = np.where(ok, size[b] - over - cost, -np.inf)
        ends = np.searchsorted(rows, np.arange(start, stop))
        for k, m in zip(range(start, stop), ends.tolist()):
            if m:
                v = score[rows[:m]] + gain[:m, k - start]
                x = int(v.argmax())
                if v[x] > score[k]:
                    score[k], back[k] = v[x], rows[x]
    chain = [int(score.argmax())]
    while back[chain[-1]] >= 0:
        chain.append(int(back[chain[-1]]))
    chain.reverse()
    return chain


def longest_word_run(item_codes: np.ndarray, page_codes: np.ndarray) -> int:
    """Greatest number of consecutive words of the item that the page holds, by the chain of step 5."""
    return word_cover(item_codes, page_codes)[0]


def word_cover(item_codes: np.ndarray, page_codes: np.ndarray) -> tuple[int, int]:
    """The longest run of consecutive words of the item on the page, and the number of its words there in order."""
    item, page = item_codes & LETTER, page_codes & LETTER
    i0, j0, size = _runs(item, page)
    if not len(i0):
        return 0, 0
    i1, j1 = i0 + size, j0 + size
    # Letters from each end of a run to the edge of its line or column.
    edges = np.r_[0, np.flatnonzero(page_codes & PIECE), len(page)]
    tail = edges[np.searchsorted(edges, j1)] - j1
    head = j0 - edges[np.searchsorted(edges, j0, side="right") - 1]
    chain = _chain(i0, j0, size, tail, head)
    held = np.zeros(len(item), dtype=np.int8)
    for x in chain:
        held[i0[x] : i1[x]] = 2
    for x, y in zip(chain, chain[1:]):
        a, z, c, e = i1[x], i0[y], j1[x], j0[y]
        if z - a <= 0:
            continue
        if z - a <= 3 or (e > c and abs((z - a) - (e - c)) <= 3 and _lcs(item[a:z].tolist(), page[c:e].tolist()) >= 0.34 * (z - a)):
            held[a:z] = 1
        else:  # other matter in between: what follows the one run and what precedes the other
            held[a:z] = _torn(item[a:z], page, c, e)
    bounds = np.r_[np.flatnonzero(item_codes & WORD), len(item)]
    part = lambda: np.add.reduceat(held > 0, bounds[:-1], dtype=np.int64) / np.diff(bounds)
    present = (part() >= 0.5).tolist()
    _grow(present, bounds, item, page, page_codes, i0[chain[0]], j0[chain[0]], i1[chain[-1]], j1[chain[-1]])
    part = part()
    for k in range(1, len(present) - 1):  # a badly misread word between two others
        if present[k - 1] and present[k + 1] and part[k] >= 0.3:
            present[k] = True
    best = run = 0
    for p in present:
        run = run + 1 if p else 0
        best = max(best, run)
    return best, sum(present)


def _torn(gap: np.ndarray, page: np.ndarray, end: int, start: int) -> np.ndarray:
    """Which letters of the item's gap stand, misread, right behind the first run or right before the second."""
    n = len(gap)
    out = np.zeros(n, dtype=np.int8)
    left, right = page[end : end + n + 2].tolist(), page[max(0, start - n - 2) : start].tolist()
    g = gap.tolist()
    for k in range(n, 1, -1):
        if _lcs(g[:k], left[: k + 2]) >= 0.7 * k:
            out[:k] = 1
            break
    for k in range(n, 1, -1):
        if _lcs(g[n - k :], right[-(k + 2) :]) >= 0.7 * k:
            out[n - k :] = 1
            break
    return out


def _grow(present: list[bool], bounds: np.ndarray, item: np.ndarray, page: np.ndarray, codes: np.ndarray, a: int, c: int, z: int, e: int) -> None:
    """Trims a short end word that is only the start or end of another word on the page, then
    adds end words that stand, misread, next to the chain's ends."""
    words = len(present)
    start_of = lambda j: j >= len(page) or bool(codes[j] & (WORD | PIECE))
    last = max((k for k in range(words) if present[k] and bounds[k] < z), default=None)
    if last is not None:
        if bounds[last + 1] - bounds[last] <= 4 and bounds[last + 1] == z and not start_of(e):
            present[last] = False
        else:
            z0, e0 = int(bounds[last + 1]), int(e + bounds[last + 1] - z)
            for k in range(last + 1, words):
                w = item[bounds[k] : bounds[k + 1]].tolist()
                n = len(w)
                if not (start_of(e0) and e0 + n <= len(page) + 1 and _lcs(w, page[e0 : e0 + n].tolist()) >= (n if n <= 3 else 0.7 * n) and (n > 4 or start_of(e0 + n))):
                    break
                present[k] = True
                e0 += n
                z0 += n
    first = min((k for k in range(words) if present[k] and bounds[k + 1] > a), default=None)
    if first is not None:
        if bounds[first + 1] - bounds[first] <= 4 and bounds[first] == a and not start_of(c):
            present[first] = False
        else:
            c0 = int(c + bounds[first] - a)
            for k in range(first - 1, -1, -1):
                w = item[bounds[k] : bounds[k + 1]].tolist()
                n = len(w)
                if not (c0 - n >= 0 and start_of(c0) and _lcs(w, page[c0 - n : c0].tolist()) >= (n if n <= 3 else 0.7 * n) and (n > 4 or start_of(c0 - n))):
                    break
                present[k] = True
                c0 -= n


def lightest(items: Items, weight: np.ndarray) -> np.ndarray:
    """Weight of the lightest run of LEAST_WORDS words of every passage; infinite where it has none."""
    total = np.r_[0, np.cumsum(weight[items.places].astype(np.float64))]
    run = total[items.high] - total[items.low]
    return np.array([run[a:z].min() if z > a else np.inf for a, z in zip(items.first_run, items.first_run[1:])])


HITS = "doc_id bigint, item_id bigint, cosine double, n_words bigint, n_held bigint, of_words bigint, answered boolean"


def candidates_and_runs(pages: DataFrame, items: Items, idf: np.ndarray, base: np.ndarray, cosine: float = LEAST_COSINE, share: float = LEAST_SHARE) -> DataFrame:
    """HITS: every candidate page of every section of an item; the words from the check on the whole page."""
    row, col = items.matrix(idf)
    latent = _product(row, col, idf[col], base, len(items.terms))
    norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-6).astype(np.float32)
    # Least product and cosine with a passage: of its lightest run of words, not of the whole passage.
    run_weight = lightest(items, idf * idf)
    whole = np.add.reduceat(idf[col] ** 2, np.searchsorted(row, np.arange(len(latent)))) if len(row) else np.zeros(0)
    least = (share * run_weight / norm).astype(np.float32)
    least_cosine = (cosine * np.sqrt(np.minimum(1, run_weight / np.maximum(whole, 1e-6)))).astype(np.float32)
    state = {
        "ids": items.ids, "letters": items.letters, "answers": items.answers, "section": items.section, "grams": items.grams, "keep": idf > 0,
        "to_latent": base * idf[:, None], "unit": latent / norm[:, None], "least": least, "least_cosine": least_cosine,
    }
    sent, n_terms = pages.sparkSession.sparkContext.broadcast(state), items.n_terms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        look, ids, letters, answers, section, unit = _look(s), s["ids"], s["letters"], s["answers"], s["section"], s["unit"]
        for b in batches:
            rows, docs = list(b["letters"]), b["doc_id"].to_numpy()
            for i, j in _slices(rows):
                block, term, first, n_blocks = _terms(rows[i:j], look, n_terms)
                if not len(block):
                    continue
                total = int(n_blocks.sum())
                x = _product(block, term, np.ones(len(block), dtype=np.float32), s["to_latent"], total)
                owner = np.repeat(np.arange(j - i), n_blocks)
                joined = np.flatnonzero(owner[:-1] == owner[1:])
                x[joined] += x[joined + 1].copy()
                size = np.maximum(np.linalg.norm(x, axis=1), 1e-6)
                hits: dict[tuple[int, int], float] = {}
                places: dict[tuple[int, int], list[int]] = {}
                step = max(1, CELLS // len(unit))
                for a in range(0, total, step):
                    dot = x[a : a + step] @ unit.T
                    p, q = np.nonzero((dot >= s["least"]) & (dot >= s["least_cosine"] * size[a : a + step, None]))
                    for p, q, c in zip((p + a).tolist(), q.tolist(), (dot[p, q] / size[p + a]).tolist()):
                        k = (int(owner[p]), int(section[q]))
                        hits[k] = max(hits.get(k, 0.0), c)
                        places.setdefault(k, []).append(int(p - first[k[0]]) * BLOCK)
                out, last = [], -1
                for (d, q), c in sorted(hits.items()):
                    if d != last:
                        page, last = np.frombuffer(rows[i + d], dtype=np.uint8), d
                        plain = (page & LETTER).tobytes()
                    cover = [word_cover(letters[q], page[a:z]) for a, z in _windows(places[d, q], len(page), len(letters[q]))]
                    words = int(((letters[q] & WORD) > 0).sum())
                    out.append((docs[i + d], ids[q], c, max(r for r, _ in cover), max(n for _, n in cover), words, len(answers[q]) > 0 and answers[q] in plain))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "n_words", "n_held", "of_words", "answered"])

    return pages.mapInPandas(run, HITS)


def parts(eval_items: DataFrame) -> tuple[DataFrame, int]:
    """item_id, text, answer, part and the number of parts; items of more than PIECE_WORDS words lie in overlapping pieces."""
    words = F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - SECTION), F.lit(PIECE_WORDS - SECTION))
    pieces = F.when(F.size(words) <= PIECE_WORDS, F.array("text")).otherwise(F.transform(starts, lambda a: F.array_join(F.slice(words, a, PIECE_WORDS), "")))
    items = cut(eval_items.where("item_id IS NOT NULL AND text <> ''").select("item_id", "answer", F.posexplode(pieces).alias("piece", "text")), "items")
    passages = F.greatest(F.lit(1), F.ceil((F.size(words) - PASSAGE) / PASSAGE_STEP) + 1)
    n = -(-(items.agg(F.sum(passages)).first()[0] or 0) // PART_PASSAGES)
    return items.select("item_id", "text", "answer", F.pmod(F.xxhash64("item_id", "piece"), F.lit(max(1, n))).alias("part")), n


def search(documents: DataFrame, eval_items: DataFrame, cosine: float = LEAST_COSINE, share: float = LEAST_SHARE, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cosine, n_words, n_held, of_words, answered of all candidate pairs.

    n_words is the longest run of consecutive words, n_held how many of the
    of_words words of the item stand on the page in order; both of the best of
    its sections where an item is longer than ``SECTION`` words. answered:
    the page holds the item's answer. Null and empty texts on either side hold
    nothing, rows without an id are left out; rows of one id count as one.
    """
    spark = documents.sparkSession
    fold = fold_table()
    items_of, n_parts = parts(eval_items)
    out, pages, sample = None, None, None
    for k in range(n_parts):
        items = Items(items_of.where(F.col("part") == k).collect(), fold)  # about PART_PASSAGES passages
        if not items.n_terms:
            continue
        pages = pages if pages is not None else streams(documents, fold)
        df, n_blocks, n_pages = frequencies(pages, items)
        if not n_blocks:
            break
        idf = weights(items, df, n_blocks)
        sample = sample if sample is not None else fit_sample(pages, n_pages)
        hits = candidates_and_runs(pages, items, idf, latent_base(sample, items, idf, rank), cosine, share)
        hits = hits if n_parts == 1 else cut(hits, "hits")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], HITS)
    best = F.max_by(F.struct("n_held", "of_words"), F.struct("n_held", "n_words")).alias("b")
    found = out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("n_words").alias("n_words"), best, F.bool_or("answered").alias("answered"))
    return found.select("doc_id", "item_id", "cosine", "n_words", "b.n_held", "b.of_words", "answered")


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return search(documents, eval_items).where(F.col("n_words") >= LEAST_WORDS).select("doc_id", "item_id")


def reworded(hits: DataFrame) -> DataFrame:
    """Pairs of :func:`search` without a run of LEAST_WORDS words whose page still holds half of the words in order, and the answer."""
    return hits.where((F.col("n_words") < LEAST_WORDS) & (2 * F.col("n_held") >= F.col("of_words")) & F.col("answered"))
