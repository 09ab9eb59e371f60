"""Duplicates hidden by formatting differences (problem 2).

Each statement is brought to a canonical form (characters, case, white space,
identifier quotes, closing punctuation, order of the select list) and hashed
to 128 bits inside the task that reads it; the text itself is never shuffled.
Copies are counted by an aggregate on the hash with map-side combining. A
second, independent 64-bit hash of the same form travels along as collision
check: it is part of the grouping key, so two forms that shared 128 bits would
still be kept apart, and :func:`collisions` counts such cases.

Groups with very many copies join back through a broadcast of at most
1000 rows; all others through a shuffle on the hash.
"""

from __future__ import annotations

import re
from hashlib import blake2b, md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgate.operators.skew import join_groups
from quillgate.session import cut

KEY = ["origin", "rec_id", "h", "c"]

_TOKEN = re.compile(r"""'(?:[^']|'')*(?:'|$)|"[^"]*"|`[^`]*`|\w+|\s+|.""", re.S)
_LIST_ENDS = {"from", "into", "where", "group", "having", "order", "limit", "union", "intersect", "except"}


def _tokens(text: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(text):
        head = t[0]
        if head == "'":
            out.append(t)
        elif head in "\"`":
            inner = " ".join(t.strip(head).lower().split())
            if inner:
                out.append(inner)
        elif not t.isspace():
            out.append(t.lower())
    while out and out[-1] == ";":
        out.pop()
    return out


def _wordy(t: str) -> bool:
    return t[-1].isalnum() or t[-1] == "_"


def _join(parts: list[str]) -> str:
    out: list[str] = []
    for p in parts:
        if not p:
            continue
        if out and _wordy(out[-1]) and (p[0].isalnum() or p[0] == "_"):
            out.append(" ")
        out.append(p)
    return "".join(out)


def canonical_statement(text: str) -> str:
    """One form for all spellings of a statement.

    What stands inside single quotes is kept as written. Select lists, also
    nested ones, are sorted. Empty text has the empty form; text that is not
    SQL merely has its case and white space evened out.
    """
    # A frame is [pieces, items or None]: items are the finished members of an open select list.
    stack: list[list] = [[[], None, 0]]

    def close_list(f: list) -> None:
        if f[1] is not None:
            items = [*f[1], _join(f[0][f[2] :])]
            f[0][f[2] :] = [",".join(sorted(items))]
            f[1] = None

    for t in _tokens(text):
        f = stack[-1]
        if t == "(":
            stack.append([[], None, 0])
        elif t == ")" and len(stack) > 1:
            close_list(f)
            stack.pop()
            stack[-1][0].append("(" + _join(f[0]) + ")")
        elif t == "select":
            close_list(f)
            f[0].append(t)
            f[1], f[2] = [], len(f[0])
        elif f[1] is not None and t in ("distinct", "all") and not f[1] and len(f[0]) == f[2]:
            f[0].append(t)
            f[2] += 1
        elif f[1] is not None and t == ",":
            f[1].append(_join(f[0][f[2] :]))
            del f[0][f[2] :]
        elif f[1] is not None and (t in _LIST_ENDS or t == ";"):
            close_list(f)
            f[0].append(t)
        else:
            f[0].append(t)
    while len(stack) > 1:
        f = stack.pop()
        close_list(f)
        stack[-1][0].append("(" + _join(f[0]))
    close_list(stack[0])
    return _join(stack[0][0])


@F.pandas_udf(T.StructType([T.StructField("h", T.BinaryType()), T.StructField("c", T.LongType())]))
def statement_key(texts: pd.Series) -> pd.DataFrame:
    """128-bit hash and 64-bit check of the canonical form; null for null."""
    h, c = [], []
    for t in texts:
        if t is None:
            h.append(None)
            c.append(None)
        else:
            form = canonical_statement(t).encode("utf-8", "surrogatepass")
            h.append(md5(form, usedforsecurity=False).digest())
            c.append(int.from_bytes(blake2b(form, digest_size=8).digest(), "little", signed=True))
    return pd.DataFrame({"h": h, "c": pd.array(c, dtype="Int64")})


def keyed(audit: DataFrame, day_usage: DataFrame) -> DataFrame:
    """origin, rec_id, no, h, c of every statement that is not null."""
    lines = audit.select(F.lit("original_sql").alias("origin"), F.lit(0).cast("bigint").alias("rec_id"), F.col("line_no").alias("no"), F.col("original_sql").alias("stmt"))
    days = day_usage.select("usage_id", F.posexplode("by_sql").alias("no", "s")).select(
        F.lit("by_sql").alias("origin"), F.col("usage_id").alias("rec_id"), F.col("no").cast("bigint").alias("no"), F.col("s.stmt").alias("stmt")
    )
    rows = lines.unionByName(days).where("stmt IS NOT NULL")
    return cut(rows.select("origin", "rec_id", "no", statement_key("stmt").alias("k")).select("origin", "rec_id", "no", "k.h", "k.c"), "keyed")


def groups(rows: DataFrame) -> DataFrame:
    """One row per canonical form: KEY, first_no, n."""
    return rows.groupBy(*KEY).agg(F.min("no").alias("first_no"), F.count("*").alias("n"))


def collisions(rows: DataFrame) -> DataFrame:
    """128-bit hashes shared by different forms, by the 64-bit check (normally none)."""
    return rows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").agg(F.count("*").alias("n_collisions"))


def copies(rows: DataFrame) -> DataFrame:
    """origin, rec_id, first_no, copy_no: every copy but the first of its group."""
    many = cut(groups(rows).where("n > 1"), "groups")
    both = join_groups(rows, many, KEY, "n", rows.count())
    return both.where("no <> first_no").select("origin", "rec_id", "first_no", F.col("no").alias("copy_no"))
