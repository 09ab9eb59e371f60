"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_PREFIX = "urn:li:tag:"
TERM_PREFIX = "urn:li:glossaryTerm:"
DOMAIN_PREFIX = "urn:li:domain:"


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)


def loose_upper(c: Column) -> Column:
    """Trimmed upper case, '' for null or blank."""
    return F.coalesce(F.upper(F.trim(c)), F.lit(""))


def label_name(c: Column) -> Column:
    """A tag's or term's name: the URN without its prefix, other text as it is."""
    return F.regexp_replace(c, f"^(?:{TAG_PREFIX}|{TERM_PREFIX})", "")


def tag_set_text(tags: Column) -> Column:
    """Distinct lower-case tag names without prefix, sorted, joined by ','.

    Null arrays, null entries and empty names count as nothing.
    """
    names = F.transform(tags, lambda x: F.regexp_replace(F.lower(x), f"^{TAG_PREFIX}", ""))
    kept = F.filter(names, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(kept)), ","), F.lit(""))


def instant_us(c: Column) -> Column:
    """Microseconds since 1970 of a time written as text, else null.

    ISO dates with 'T' or a space, with 'Z', an offset or none (then UTC);
    digits alone are milliseconds since 1970. Independent of the session's
    time zone.
    """
    t = F.trim(c)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    zoned = t.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    text = F.when(zoned, t).otherwise(F.concat(t, F.lit("Z")))
    return (
        F.when(t.rlike(r"^\d{1,15}$"), t.try_cast("bigint") * 1000)
        .when(iso, F.unix_micros(text.try_cast("timestamp")))
        .otherwise(F.lit(None).cast("bigint"))
    )


def dataset_urn(platform: Column, name: Column, env: Column) -> Column:
    return F.concat(
        F.lit("urn:li:dataset:(urn:li:dataPlatform:"), platform, F.lit(","), name, F.lit(","), env, F.lit(")")
    )


def dataset_name(urn: Column) -> Column:
    """The dotted name in a data set's URN; null for other text."""
    name = F.regexp_extract(urn, r"^urn:li:dataset:\(urn:li:dataPlatform:[^,]*,(.*),[^,)]*\)$", 1)
    return F.when(name != "", name)


def dataset_platform(urn: Column) -> Column:
    name = F.regexp_extract(urn, r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]*),.*,[^,)]*\)$", 1)
    return F.when(name != "", name)


def field_dataset(urn: Column) -> Column:
    """The data set's URN in a field's URN (split at the last comma)."""
    name = F.regexp_extract(urn, r"^urn:li:schemaField:\((.*),[^,]*\)$", 1)
    return F.when(name != "", name)


def field_column(urn: Column) -> Column:
    name = F.regexp_extract(urn, r"^urn:li:schemaField:\(.*,([^,]*)\)$", 1)
    return F.when(name != "", name)


def table_key(c: Column) -> Column:
    """A written table name in lower case, without identifier quotes."""
    return F.lower(F.regexp_replace(F.trim(c), r'["`\[\]]', ""))
