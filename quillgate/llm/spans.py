"""Long exact spans shared between records (problem 10).

Hashing runs of whole sentences cannot give the required result: on scanned
pages a shared stretch starts and ends inside sentences, and sentence marks
are themselves misread, so two equal stretches need not hold one equal
sentence. The runs hashed here are therefore runs of characters; the rest of
the sliding-span method (hash, join globally, mark what another record holds,
keep the first) is unchanged.

1. Winnowing: every page keeps, of each window of ``least - GRAM + 1``
   consecutive character GRAM-grams, the one with the smallest hash. Two equal
   stretches of ``least`` characters contain an equal window and so keep the
   same gram: nothing is missed, and about one position in 75 is shuffled.
2. Grams kept in more than one page, by an aggregate of the least and greatest
   page (map-side combining; a gram on a third of all pages costs one row).
3. Around those grams only, every window of ``least`` characters is hashed to
   128 bits, and the same aggregate finds the windows of more than one page.
   This is exact per window, for groups of any size, without pairs of pages.
4. A page's windows are united: gaps between their starts give the number of
   characters covered.

The sliding runs of whole sentences are here too (:func:`sentence_spans`), for
what they are good at: removing repeated sentences as a whole. How much of the
required result they would find is measured in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgate.operators.skew import join_groups
from quillgate.session import cut

LEAST, GRAM, SLICE, RUN = 200, 48, 1_000_000, 3
SENTENCE = r"[^.!?]*[.!?]+[ \n\t\r]*|[^.!?]+\z"  # up to its mark and the space behind it; nothing is lost in between
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, joined, and the bounds of each."""
    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def run_hashes(points: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` code points, by doubling a polynomial hash."""
    n = len(points) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        cur = (points.astype(np.uint64) + np.uint64(1)) * _MIX[which]
        cur ^= cur >> np.uint64(32)
        power, size, done, out = _BASE[which], 1, 0, None
        while True:
            if length & size:
                part = cur[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += size
            if size * 2 > length:
                break
            cur = cur[:-size] * power + cur[size:]
            power, size = power * power, size * 2
        out ^= out >> np.uint64(29)
        out *= _MIX[1 - which]
        out ^= out >> np.uint64(32)
    return out


def _slide(x: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """Least (greatest) value of every window of ``width``."""
    cur, size = x, 1
    while size * 2 <= width:
        cur, size = ufunc(cur[:-size], cur[size:]), size * 2
    return ufunc(cur[: len(x) - width + 1], cur[width - size : width - size + len(x) - width + 1])


def kept_grams(points: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams kept by winnowing (all of equal least ones)."""
    h = run_hashes(points, gram)
    width = least - gram + 1
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _slide(h, width, np.minimum)
    padded = np.r_[np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]
    at = np.flatnonzero(_slide(padded, width, np.maximum) == h)
    return at, h[at]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def anchors(documents: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """h, doc_id, pos of the kept grams of every page of at least ``least`` characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, docs = list(b["text"]), b["doc_id"].to_numpy()
            for i, j in _slices(texts):
                points, bounds = _points(texts[i:j])
                at, h = kept_grams(points, least, gram)
                page = np.searchsorted(bounds, at, side="right") - 1
                inside = at + gram <= bounds[page + 1]
                at, h, page = at[inside], h[inside], page[inside]
                yield pd.DataFrame({"h": h.view(np.int64), "doc_id": docs[i:j][page], "pos": (at - bounds[page]).astype(np.int32)})

    pages = documents.select("doc_id", "text").where((F.length("text") >= least) & F.col("doc_id").isNotNull())
    return pages.mapInPandas(run, "h bigint, doc_id bigint, pos int")


def _several(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one page has, the first such page and the number of rows."""
    both = rows.groupBy(*key).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last"), F.count("*").alias("n_rows"))
    return cut(both.where("first_doc <> _last").drop("_last"), "several")


def windows(documents: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, start, first_doc of every window of ``least`` characters that another page has too.

    Null texts and pages shorter than ``least`` have none; rows with the same
    doc_id are one page.
    """
    kept = cut(anchors(documents, least, gram), "anchors")
    near = join_groups(kept, _several(kept, "h"), ["h"], "n_rows", kept.count())
    near = cut(near.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("pos")), "near")
    pages = documents.select("doc_id", "text").where((F.length("text") >= least) & F.col("doc_id").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, docs, places = list(b["text"]), b["doc_id"].to_numpy(), list(b["pos"])
            for i, j in _slices(texts):
                points, bounds = _points(texts[i:j])
                want = np.zeros(len(points) + 1, dtype=np.int32)
                for k in range(i, j):
                    p = np.asarray(places[k], dtype=np.int64)
                    lo, hi = bounds[k - i], bounds[k - i + 1] - least
                    np.add.at(want, np.maximum(lo, lo + p - (least - gram)), 1)
                    np.add.at(want, np.minimum(hi, lo + p) + 1, -1)
                at = np.flatnonzero(np.cumsum(want[:-1]) > 0)
                page = np.searchsorted(bounds, at, side="right") - 1
                one, two = run_hashes(points, least, 0), run_hashes(points, least, 1)
                for a in range(0, len(at), 200_000):
                    x, g = at[a : a + 200_000], page[a : a + 200_000]
                    yield pd.DataFrame({"h": one[x].view(np.int64), "g": two[x].view(np.int64), "doc_id": docs[i:j][g], "start": (x - bounds[g]).astype(np.int32)})

    rows = cut(pages.join(near, "doc_id").mapInPandas(run, "h bigint, g bigint, doc_id bigint, start int"), "windows")
    return join_groups(rows, _several(rows, "h", "g"), ["h", "g"], "n_rows", rows.count()).select("doc_id", "start", "first_doc")


def covered(shared: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, shared_chars, repeated_chars: characters in any shared window, and in those that an
    earlier page has (what removing all but the first copy would take away).

    A page's windows are at most as many as its characters.
    """
    once = shared.groupBy("doc_id", "start").agg(F.min("first_doc").alias("first_doc"))
    w = Window.partitionBy("doc_id").orderBy("start")
    later = F.col("first_doc") < F.col("doc_id")
    step = lambda before: F.least(F.lit(least), F.coalesce(F.col("start") - before, F.lit(least)))
    lagged = once.select(
        "doc_id",
        step(F.lag("start").over(w)).alias("n"),
        F.when(later, step(F.last(F.when(later, F.col("start")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))).alias("m"),
    )
    return lagged.groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("shared_chars"), F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("repeated_chars"))


def found(documents: DataFrame, least: int = LEAST) -> DataFrame:
    return covered(windows(documents, least), least).select("doc_id", "shared_chars")


def sentence_spans(documents: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_sentences, shared_chars, repeated_chars by runs of ``run`` consecutive sentences.

    Every run is hashed to 128 bits and joined globally. shared_chars are the
    characters of sentences in any run that another page has; repeated_chars
    those of sentences covered by any run that is not the first of its kind
    (by doc_id, then place), which removing repeats would take away. Pages
    without a repeated run, null texts and rows without an id are left out;
    a page of fewer sentences than ``run`` has no run.
    """
    pages = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)).alias("s"))
    at = F.when(F.size("s") >= run, F.sequence(F.lit(0), F.size("s") - run)).otherwise(F.array().cast("array<int>"))
    each = F.transform(at, lambda i: F.struct(i.alias("i"), F.md5(F.array_join(F.slice("s", i + 1, run), "")).alias("h")))
    runs = cut(pages.select("doc_id", F.explode(each).alias("r")).select("doc_id", "r.i", "r.h"), "runs")
    groups = runs.groupBy("h").agg(F.min(F.struct("doc_id", "i")).alias("first"), F.max("doc_id").alias("_last"), F.count("*").alias("n_rows")).where("n_rows > 1")
    groups = cut(groups.select("h", "first", (F.col("first.doc_id") != F.col("_last")).alias("elsewhere"), "n_rows"), "repeats")
    hit = join_groups(runs, groups, ["h"], "n_rows", runs.count())
    marks = hit.select("doc_id", F.explode(F.sequence(F.col("i"), F.col("i") + run - 1)).alias("j"), "elsewhere", (F.col("first") != F.struct("doc_id", "i")).alias("later"))
    marks = marks.groupBy("doc_id", "j").agg(F.bool_or("elsewhere").alias("elsewhere"), F.bool_or("later").alias("later"))
    sentences = pages.select("doc_id", F.size("s").alias("n"), F.posexplode(F.transform("s", F.length)).alias("j", "chars"))
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("chars"))), F.lit(0)).cast("bigint").alias("shared_chars" if c == "elsewhere" else "repeated_chars")
    return sentences.join(marks, ["doc_id", "j"]).groupBy("doc_id").agg(F.max("n").cast("bigint").alias("n_sentences"), count("elsewhere"), count("later"))
