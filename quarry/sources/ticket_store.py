"""Ticket tables in SQLite files as a Spark data source: read in ranges of rows with pushed filters, written a file for each task."""

from __future__ import annotations

import datetime
import os
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

NAME = "ticket_store"
#: Rows of one partition.
ROWS = 100_000
#: Rows that are fetched or inserted together.
TOGETHER = 5000
SUFFIX = ".sqlite"
#: What SQLite keeps a Spark type as; dates and times are ISO text, so that they sort and compare as such.
KEPT = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.StringType: "TEXT", T.DateType: "TEXT", T.TimestampType: "TEXT", T.TimestampNTZType: "TEXT", T.BinaryType: "BLOB"}
READ = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def folder_of(path: str) -> str:
    """A folder that the driver and all executors mount; other stores than files are refused."""
    bare = path.removeprefix("file:") if path.startswith("file:") else path
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"a ticket store needs a folder that all executors mount, not {path}")
    return "/" + bare.lstrip("/") if path.startswith("file:") else bare


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kept(value):
    """A value as SQLite keeps it."""
    return value.isoformat(" ") if isinstance(value, datetime.datetime) else value.isoformat() if isinstance(value, datetime.date) else int(value) if isinstance(value, bool) else value


def given(value, kind: T.DataType):
    """A value that SQLite kept, as Spark's type."""
    if value is None:
        return None
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(value[:10])
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return datetime.datetime.fromisoformat(value)
    return bool(value) if isinstance(kind, T.BooleanType) else value


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def files_of(folder: str) -> list[str]:
    """The store's finished files, in order of their names; a path may also be one file."""
    if os.path.isfile(folder):
        return [folder]
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(SUFFIX))


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.folder, self.table, self.schema = folder_of(options["path"]), options["table"], schema
        self.rows = int(options.get("rows", ROWS))
        self.where: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters on single columns that SQLite answers as Spark does; gives back the others."""
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in kinds or isinstance(kinds[name], T.TimestampType | T.TimestampNTZType | T.FloatType | T.DoubleType):  # text forms of times and rounded numbers may differ
                yield f
            elif type(f) in COMPARED:
                self.where.append(f"{quoted(name)} {COMPARED[type(f)]} ?")
                self.values.append(kept(f.value))
            elif isinstance(f, In):
                self.where.append(f"{quoted(name)} IN ({', '.join('?' * len(f.value))})")
                self.values.extend(map(kept, f.value))
            elif isinstance(f, IsNull | IsNotNull):
                self.where.append(f"{quoted(name)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            elif isinstance(f, StringStartsWith):
                self.where.append(f"substr({quoted(name)}, 1, ?) = ?")
                self.values.extend((len(f.value), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of row numbers of each file that has the table."""
        found = []
        for file in files_of(self.folder):
            with opened(file) as db:
                if not db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (self.table,)).fetchone():
                    continue
                first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            if first is not None:
                found += [Rows(file, at, min(at + self.rows - 1, last)) for at in range(first, last + 1, self.rows)]
        return found or [Rows("", 1, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if not partition.file:
            return
        columns = ", ".join(quoted(f.name) for f in self.schema.fields) or "1"
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        kinds = [f.dataType for f in self.schema.fields]
        with opened(partition.file) as db:
            rows = db.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE {where}", (partition.first, partition.last, *self.values))
            while some := rows.fetchmany(TOGETHER):
                for row in some:
                    yield tuple(map(given, row, kinds))


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceWriter):
    """A file for each task, under a hidden name until all tasks are done, so that a task that is run again leaves no rows twice."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.folder, self.table, self.schema, self.overwrite = folder_of(options["path"]), options["table"], schema, overwrite

    def write(self, iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        name = f"{self.table}-{uuid.uuid4().hex}{SUFFIX}"
        columns = ", ".join(f"{quoted(f.name)} {KEPT[type(f.dataType)]}" for f in self.schema.fields)
        db = sqlite3.connect(os.path.join(self.folder, f".{name}.part"))
        db.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
        put = f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.schema.fields))})"
        some: list[tuple] = []
        for row in iterator:
            some.append(tuple(map(kept, row)))
            if len(some) >= TOGETHER:
                db.executemany(put, some)
                some.clear()
        db.executemany(put, some)
        db.commit()
        db.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        new = [m.name for m in messages if m is not None]
        if self.overwrite:
            for file in files_of(self.folder):
                os.remove(file)
        for name in new:
            os.replace(os.path.join(self.folder, f".{name}.part"), os.path.join(self.folder, name))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(part := os.path.join(self.folder, f".{m.name}.part")):
                os.remove(part)


class TicketStore(DataSource):
    """Options: path (a folder or a file), table, rows (of a partition). Without a given schema the columns are those of the first
    file's table."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        for file in files_of(folder_of(self.options["path"])):
            with opened(file) as db:
                columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
            if columns:
                return T.StructType([T.StructField(c[1], READ.get(c[2].upper(), T.StringType())) for c in columns])
        raise ValueError(f"no table {self.options['table']} in {self.options['path']}")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TicketStore)


def read_tickets(spark: SparkSession, path: str, table: str, schema: str | T.StructType | None = None, rows: int = ROWS) -> DataFrame:
    """A ticket table of a store. A schema names the columns that are read; filters on them are pushed to SQLite."""
    register(spark)
    reader = spark.read.format(NAME).option("path", path).option("table", table).option("rows", rows)
    return (reader.schema(schema) if schema else reader).load()


def export_tickets(tables: dict[str, DataFrame], path: str) -> None:
    """Each table in a store of its name below path, in files that SQLite opens; what was there is replaced."""
    for name, df in tables.items():
        register(df.sparkSession)
        df.write.format(NAME).mode("overwrite").option("path", f"{path.rstrip('/')}/{name}").option("table", name).save()
