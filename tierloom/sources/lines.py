"""Raw lines of JSONL files, byte for byte: a Python data source with one partition a file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tierloom.errors import IngestError

_NAME = re.compile(r"\.jsonl(\.\d+)?$")
SCHEMA = "file string, line_index bigint, raw binary"


def trace_files(root: str, exclude: str | None = None) -> list[tuple[str, str]]:
    """(relative name, path) of the JSONL files below a folder, by name, without the folder ``exclude``; or of the one file."""
    top = Path(root)
    if top.is_file():
        return [(top.name, str(top))]
    if not top.is_dir():
        raise IngestError(f"no such file or folder: {root}")
    found = {p.relative_to(top).as_posix(): str(p) for p in top.rglob("*") if p.is_file() and _NAME.search(p.name)}
    return [(n, p) for n, p in sorted(found.items()) if not exclude or not (n == exclude or n.startswith(exclude.rstrip("/") + "/"))]


class _File(InputPartition):
    def __init__(self, name: str, path: str):
        self.name, self.path = name, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_File(*f) for f in trace_files(self.options["path"], self.options.get("exclude"))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("line_index", pa.int64()), ("raw", pa.binary())])
        with open(partition.path, "rb") as f:
            at, held, size = 0, [], 0
            for line in f:
                held.append(line.removesuffix(b"\n"))
                size += len(line)
                if size > 4_000_000 or len(held) >= 8192:
                    yield self._batch(schema, partition.name, at, held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield self._batch(schema, partition.name, at, held)

    @staticmethod
    def _batch(schema: pa.Schema, name: str, at: int, lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.binary())], schema=schema)


class JsonlLines(DataSource):
    """Every physical line, split at newlines only; carriage returns, byte-order marks and broken UTF-8 stay as they are."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_lines(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """file, line_index and raw of all JSONL files at ``path``."""
    spark.dataSource.register(JsonlLines)
    reader = spark.read.format("jsonl_lines").option("path", path)
    return (reader.option("exclude", exclude) if exclude else reader).load()
