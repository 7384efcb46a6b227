"""A store of related tables: made where missing, widened where older, upserted, and deleted from with all that refers to what goes.

Each table is kept in versions, so every change is seen whole or not at all. Built-in Parquet tables take no DELETE or foreign keys; here a deletion is a new
version without the rows, of the tables that refer to them first and of their own table last, so one that breaks off leaves no row that refers to nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources import versions


@dataclass(frozen=True)
class Table:
    """A table's schema, its keys, the column that says which of two rows of a key is later, and the table whose key it refers to."""

    schema: str
    keys: tuple[str, ...]
    seq: str
    parent: str | None = None
    parent_key: str | None = None


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Table]) -> None:
        self.spark, self.path, self.tables = spark, path, dict(tables)

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.tables[name].schema)

    def _put_whole(self, name: str, rows: DataFrame) -> None:
        versions.swap(self.spark, self._at(name), lambda folder: rows.write.parquet(folder))

    def create(self) -> list[str]:
        """Makes the tables that are missing, empty; which ones."""
        missing = [n for n in self.tables if versions.current(self.spark, self._at(n)) is None]
        for name in missing:
            self._put_whole(name, self._empty(name))
        return missing

    def migrate(self, defaults: Mapping[str, Column] | None = None, backfill: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> list[str]:
        """Adds the columns that a table of an older layout lacks, null or their default, and puts ``backfill`` of the table in its place; which tables changed.

        Columns beyond the schema stay. A table that lacks nothing is left alone, so this may be run at every start.
        """
        changed = []
        for name in self.tables:
            rows, want = versions.read(self.spark, self._at(name)), self._empty(name)
            lacking = [f for f in want.schema.fields if f.name not in rows.columns]
            if lacking:
                default = lambda f: (defaults or {}).get(f.name, F.lit(None)).cast(f.dataType)
                wide = rows.withColumns({f.name: default(f) for f in lacking})
                fill = (backfill or {}).get(name)
                self._put_whole(name, fill(wide) if fill else wide)
                changed.append(name)
        return changed

    def rows(self, name: str) -> DataFrame:
        """The last row of each key."""
        table = self.tables[name]
        return versions.read(self.spark, self._at(name), table.keys, table.seq)

    def upsert(self, name: str, rows: DataFrame, every: int = 10) -> None:
        """Adds or replaces rows by key. Rows that refer to nothing are an error, found before anything is written."""
        table = self.tables[name]
        if table.parent:
            parent = self.rows(table.parent).select(*self.tables[table.parent].keys)
            if not rows.join(parent, table.parent_key, "left_anti").isEmpty():
                raise ValueError(f"{name}: rows refer to no row of {table.parent}")
        now = versions.current(self.spark, self._at(name))
        versions.upsert(rows.select(*self._empty(name).columns), self._at(name), table.keys, table.seq, now["batch"] + 1, every)

    def _children(self, name: str) -> Sequence[tuple[str, Table]]:
        return [(n, t) for n, t in self.tables.items() if t.parent == name]

    def delete(self, name: str, keys: DataFrame) -> None:
        """Deletes the rows of ``keys`` and all rows that refer to them, in whatever table."""
        for child, table in self._children(name):
            mine = self.rows(child).join(keys.select(table.parent_key), table.parent_key, "left_semi")
            self.delete(child, mine.select(*table.keys))
        self._put_whole(name, self.rows(name).join(keys, list(self.tables[name].keys), "left_anti"))

    def clear(self, name: str) -> None:
        """Deletes all rows, and first those of the tables that refer to it, as a forced import begins."""
        for child, _ in self._children(name):
            self.clear(child)
        self._put_whole(name, self.rows(name).limit(0))
