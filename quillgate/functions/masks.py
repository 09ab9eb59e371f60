"""Masking strategies as Column expressions.

All stay inside whole-stage codegen; none is a Python function on rows, so
scans keep their pruned columns and pushed filters. The salt enters as a
literal Column, never as text spliced into SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRATEGIES = ("null", "hash", "partial_email", "partial_phone", "generalize_date", "fixed_string")

# The shape each strategy's output must have.
SHAPES = {"hash": "^[0-9a-f]{32}$", "partial_email": r"^(\*\*\*|.\*\*\*@.*)$", "partial_phone": r"^\*\*\*(-.{4})?$", "fixed_string": r"^\*\*\*$"}


# What a reader is told about each strategy's output.
HINTS = {
    "null": "Values are nulled; the column carries no signal.",
    "hash": "Masked values preserve equality: GROUP BY / COUNT(DISTINCT ...) remain correct.",
    "partial_email": "Only the first character and domain survive; equality is not preserved.",
    "partial_phone": "Only the last four digits survive; equality is not preserved.",
    "generalize_date": "Dates are generalized to the first of the month.",
    "fixed_string": "Every value is replaced by a constant.",
}

# What ``auto`` and ``partial`` become, the first pattern that fits the lower-case name;
# below it, types taken as dates. All else is hashed.
BY_NAME = {"email": "partial_email", "phone|_tel$": "partial_phone"}
TEMPORAL = "DATE|TIME"


def resolve(strategy: str, column: str, data_type: str) -> str:
    """The strategy behind ``auto`` and ``partial``; a date mask on other types becomes a hash."""
    if strategy not in (*STRATEGIES, "auto", "partial"):
        raise ValueError(f"unknown masking strategy {strategy!r}")
    by_type = "generalize_date" if re.search(TEMPORAL, data_type.upper()) else "hash"
    if strategy == "generalize_date":
        return by_type
    if strategy in STRATEGIES:
        return strategy
    return next((s for pattern, s in BY_NAME.items() if re.search(pattern, column.lower())), by_type)


def masked_outputs(schema: T.StructType, policy: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, strategy, hint) of every masked column of a governed table."""
    by = {k.lower(): v for k, v in policy.items()}
    pairs = [(f.name, resolve(by[f.name.lower()], f.name, f.dataType.simpleString())) for f in schema if by.get(f.name.lower(), "deny") != "deny"]
    return [(n, s, HINTS[s]) for n, s in pairs]


def masked(column: Column, strategy: str, salt: str, data_type: T.DataType | None = None) -> Column:
    """``column`` masked. Null stays null for null, hash and date; the others give '***'."""
    text = column.cast("string")
    if strategy == "null":
        return F.lit(None).cast(data_type or "string")
    if strategy == "hash":
        return F.md5(F.concat(F.lit(salt), text))
    if strategy == "partial_email":
        at = F.instr(text, "@")
        shown = F.concat(F.substring(text, 1, 1), F.lit("***@"), F.substring(text, at + 1, F.length(text)))
        return F.when(at > 0, shown).otherwise("***")
    if strategy == "partial_phone":
        return F.when(F.length(text) >= 7, F.concat(F.lit("***-"), F.right(text, F.lit(4)))).otherwise("***")
    if strategy == "generalize_date":
        return F.date_trunc("month", column)
    if strategy == "fixed_string":
        return F.lit("***")
    raise ValueError(f"unknown masking strategy {strategy!r}")


def governed(df: DataFrame, policy: dict[str, str], salt: str) -> DataFrame:
    """``df`` as its readers may see it: {column: strategy or 'deny'}; names match in any case.

    Denied columns are null of their own type and are not read at all. Columns
    the policy names but the table lacks are ignored.
    """
    by = {k.lower(): v for k, v in policy.items()}
    out = []
    for f in df.schema:
        action, c = by.get(f.name.lower()), F.col(f"`{f.name}`")
        if action is None:
            out.append(c)
        elif action == "deny":
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            out.append(masked(c, resolve(action, f.name, f.dataType.simpleString()), salt, f.dataType).alias(f.name))
    return df.select(*out)


def misshapen(df: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """One row: rows seen, and per masked column how many values lack the shape of its strategy."""
    counts = [F.count_if(F.col(c).isNotNull() & ~F.col(c).rlike(SHAPES[s])).alias(c) for c, s in shapes.items() if s in SHAPES]
    return df.agg(F.count("*").alias("n_rows"), *counts)
