"""Tables of other stores, behind one function.

Files and JDBC go through Spark's own readers. ``dbapi`` is a Python data
source for any PEP 249 driver: the table is read in ranges of a numeric
column, one task each.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "text": "text", "postgres": "jdbc", "jdbc": "jdbc", "snowflake": "net.snowflake.spark.snowflake", "bigquery": "bigquery"}


def bound(style: str, low: int | None, high: int) -> tuple[str, str, tuple | dict]:
    """Marks for the two ends of a range and their values, in any of the five parameter styles."""
    # How a parameter is written in each style, by its place from 1.
    mark = {"qmark": "?", "format": "%s", "numeric": ":{0}", "named": ":p{0}", "pyformat": "%(p{0})s"}[style]
    ends = [high] if low is None else [low, high]
    values = {f"p{i}": v for i, v in enumerate(ends, 1)} if style in ("named", "pyformat") else tuple(ends)
    return mark.format(1), mark.format(len(ends)), values


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


ONE_TASK_ROWS, RANGE_ROWS = 100_000, 250_000


class DbApiSource(DataSource):
    """Options: module, database, table, key (a numeric column; only small tables are read without), parts (default by the number of rows)."""

    @classmethod
    def name(cls) -> str:
        return "dbapi"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return DbApiReader(self.options, schema)


class DbApiReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.fields = dict(options), schema.fieldNames()

    def _run(self, sql: str, values: tuple = ()):
        connection = importlib.import_module(self.options["module"]).connect(self.options["database"])
        try:
            cursor = connection.cursor()
            cursor.execute(sql, values)
            while rows := cursor.fetchmany(5000):
                yield from rows
        finally:
            connection.close()

    def _name(self, x: str) -> str:
        return '"' + x.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        key = self.options.get("key")
        if not key:
            if int(self.options.get("max_rows_in_one", ONE_TASK_ROWS)) < next(self._run(f"SELECT count(*) FROM {self._name(self.options['table'])}"))[0]:
                raise ValueError("a table of this size needs the option key, a numeric column to read it in ranges")
            return [_Range(None, None)]
        k, t = self._name(key), self._name(self.options["table"])
        low, high, rows = next(self._run(f"SELECT min({k}), max({k}), count(*) FROM {t}"))
        if low is None:
            return [_Range(None, None)]
        step = max(1, -(-(high - low + 1) // int(self.options.get("parts", max(4, -(-rows // RANGE_ROWS))))))
        # The first range also takes the rows without a key.
        return [_Range(a if a > low else None, a + step) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        cols, t = ", ".join(self._name(f) for f in self.fields), self._name(self.options["table"])
        if part.high is None:
            yield from self._run(f"SELECT {cols} FROM {t}")
        else:
            k = self._name(self.options["key"])
            low, high, values = bound(importlib.import_module(self.options["module"]).paramstyle, part.low, part.high)
            where = f"{k} < {high} OR {k} IS NULL" if part.low is None else f"{k} >= {low} AND {k} < {high}"
            yield from self._run(f"SELECT {cols} FROM {t} WHERE {where}", values)


def read(spark: SparkSession, kind: str, path: str | None = None, **options: str) -> DataFrame:
    """A table by kind of store. JDBC and connector kinds need their driver on the class path."""
    if kind in ("dbapi", "sqlite"):
        spark.dataSource.register(DbApiSource)
        return spark.read.format("dbapi").options(**({"module": "sqlite3"} if kind == "sqlite" else {}), **options).load()
    if kind not in FORMATS:
        raise ValueError(f"unknown kind of store {kind!r}; known: {', '.join(sorted([*FORMATS, 'dbapi', 'sqlite']))}")
    reader = spark.read.format(FORMATS[kind]).options(**options)
    return reader.load(path) if path else reader.load()


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe_table(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]
