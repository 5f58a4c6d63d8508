"""Readers of run artifacts: CSV, array bundles, image files, folders and SQLite traces, as frames."""

from __future__ import annotations

import gzip
import io
import sqlite3
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def csv_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, in the file's names; an absent file is an empty frame of the given columns."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns or ["value"]))
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]) if columns else rows


def text_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, pos, word): words between blanks, a line end as <eos>."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "text"))
    words = F.concat(F.filter(F.split("text", "[ \t]+"), lambda w: w != ""), F.array(F.lit("<eos>")))
    return lines.select("file", "line", F.posexplode(words).alias("pos", "word"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, modified): files below a folder; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, values) of the arrays in NPZ bundles."""

    def run(batches):
        for b in batches:
            out = {"path": [], "name": [], "shape": [], "values": []}
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as bundle:
                    for name in bundle.files:
                        a = bundle[name]
                        for k, v in zip(out, (p, name, list(a.shape), a.astype(float).ravel().tolist()), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("name", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, shape array<bigint>, values array<double>")


def idx_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, values): the items of (gzipped) IDX files of unsigned bytes: images as pixels, labels as one value."""

    def run(batches):
        for b in batches:
            out = {"path": [], "id": [], "values": []}
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                dims = raw[3]
                shape = struct.unpack(f">{dims}I", raw[4 : 4 + 4 * dims])
                items = np.frombuffer(raw, np.uint8, offset=4 + 4 * dims).reshape(shape[0], -1)
                out["path"] += [p] * len(items)
                out["id"] += range(len(items))
                out["values"] += items.astype(np.int16).tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("id", pa.int64()), ("values", pa.list_(pa.int16()))]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, id bigint, values array<smallint>")


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path, self.table = schema.names, options["path"], options["table"]
        self.parts = int(options.get("parts", "8"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(k, min(high, k + step - 1)) for k in range(low, high + 1, step)]

    def read(self, part):
        columns = ", ".join(f'"{n}"' for n in self.names)
        with self._open() as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (part.first, part.last))


class SqliteTable(DataSource):
    """``spark.read.format("sqlite_table").schema(...).options(path=..., table=...)``: a table in ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            rows = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "DOUBLE": "double"}
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in rows)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def sqlite_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of an SQLite file that every executor can reach; a missing table is an empty frame."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        if not db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone():
            return spark.createDataFrame([], "value string")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table).load()
