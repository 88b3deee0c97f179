"""SQLite databases as a Spark data source: text columns of all user tables, with equality pushed into the query.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", p).load()          # all text columns: (tab, col, rowid, value)
    spark.read.format("sqlite").option("path", p).option("table", "t").option("column", "c").load()

Pushdown needs ``spark.sql.python.filterPushdown.enabled``. Opened read-only. One partition per table. Identifiers come from the database's own catalogue or are refused.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def text_columns(con: sqlite3.Connection) -> list[tuple[str, str]]:
    tabs = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    kinds = ("CHAR", "CLOB", "TEXT")
    return [(t, c[1]) for t in tabs for c in con.execute('SELECT * FROM pragma_table_info(?)', (t,)) if not c[2] or any(k in c[2].upper() for k in kinds)]


class Part(InputPartition):
    def __init__(self, tab: str, columns: list[str]):
        self.tab, self.columns = tab, columns


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tab, self.column, self.equal = options["path"], options.get("table"), options.get("column"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("value",):
                self.equal = f.value
            else:
                yield f

    def partitions(self) -> list[Part]:
        with connect(self.path) as con:
            known = text_columns(con)
        chosen = [(t, c) for t, c in known if (self.tab is None or t == self.tab) and (self.column is None or c == self.column)]
        if (self.tab or self.column) and not chosen:
            raise ValueError(f"no text column {self.tab}.{self.column}")
        return [Part(t, [c for u, c in chosen if u == t]) for t in sorted({t for t, _ in chosen})]

    def read(self, partition: Part) -> Iterator[tuple]:
        quote = lambda x: '"' + x.replace('"', '""') + '"'
        with connect(self.path) as con:
            for c in partition.columns:
                q = f"SELECT rowid, {quote(c)} FROM {quote(partition.tab)} WHERE {quote(c)} IS NOT NULL"
                for rowid, value in con.execute(q + (f" AND {quote(c)} = ?" if self.equal is not None else ""), (self.equal,) if self.equal is not None else ()):
                    yield partition.tab, c, rowid, str(value)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return "tab string, col string, row_id bigint, value string"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options))
