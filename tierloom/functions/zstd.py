"""Zstandard frames of binary columns, and dictionaries for them. Spark has no function for either."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a dictionary, and rows that it is trained on, at most.
DICTIONARY, SAMPLE = 110_000, 2_000


def train_dictionary(rows: DataFrame, column: str, size: int = DICTIONARY, sample: int = SAMPLE) -> bytes:
    """A dictionary of the ``sample`` payloads whose digests are least; empty where there is too little to train on."""
    some = rows.select(F.col(column).alias("b")).filter(F.octet_length("b") > 0).orderBy(F.sha2("b", 256)).limit(sample).toArrow()["b"].to_pylist()
    try:
        return zstandard.train_dictionary(size, some).as_bytes() if some else b""
    except zstandard.ZstdError:
        return b""


def _mapped(rows: DataFrame, column: str, make) -> DataFrame:
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([None if x is None else f(x) for x in cols[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in rows.schema.fields])
    return rows.mapInArrow(run, schema)


def compressed(rows: DataFrame, column: str, level: int = 3, dictionary: bytes = b"", window_log: int | None = None, long_range: bool = False) -> DataFrame:
    """The binary column as one frame a row. ``window_log`` and ``long_range`` let a frame refer far back."""

    def make():
        more = {"window_log": window_log} if window_log else {}
        how = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=True, enable_ldm=long_range, **more)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, compression_params=how).compress

    return _mapped(rows, column, make)


def decompressed(rows: DataFrame, column: str, dictionary: bytes = b"", most: int = 1 << 31) -> DataFrame:
    def make():
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, max_window_size=most)
        return d.decompress

    return _mapped(rows, column, make)
