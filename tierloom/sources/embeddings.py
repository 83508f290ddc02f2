"""Embedding files: npy, parquet and JSONL, with or without ids, one file or a folder of them."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierloom.errors import IngestError
from tierloom.functions.vectors import finite, l2_normalize, norm
from tierloom.operators.tables import ranked

VECTORS = ("vector", "embedding", "embeddings", "vec")
IDS = ("id", "ids")


def _npy(spark: SparkSession, path: Path) -> DataFrame:
    """Rows are read where they are processed: a task maps the file and takes its own range."""
    x = np.load(path, mmap_mode="r", allow_pickle=False)
    if x.ndim != 2 or not np.issubdtype(x.dtype, np.number):
        raise IngestError(f"{path}: not a numeric matrix")
    beside = path.with_name("ids.npy")
    has_ids = path.name == "vectors.npy" and beside.exists()
    if has_ids and np.load(beside, mmap_mode="r").shape != (len(x),):
        raise IngestError(f"{beside}: not one id a row")
    at, n = str(path), len(x)

    def rows(batches):
        m = np.load(at, mmap_mode="r")
        ids = np.load(str(beside), mmap_mode="r") if has_ids else None
        for b in batches:
            i = b.column(0).to_numpy()
            own = [str(v) for v in ids[i]] if ids is not None else [str(v) for v in i]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(own), pa.array(m[i].astype(np.float64).tolist(), pa.list_(pa.float64()))], ["row", "id", "vector"])

    return spark.range(n).mapInArrow(rows, "row bigint, id string, vector array<double>")


def vector_column(df: DataFrame) -> Column:
    """The column of vectors: by name, else the first list or binary one, else all numeric columns side by side."""
    kinds = {f.name: f.dataType for f in df.schema}
    named = [c for v in VECTORS for c in df.columns if c.lower() == v]
    lists = [c for c, k in kinds.items() if isinstance(k, T.ArrayType | T.BinaryType)]
    for c in [*named, *lists][:1]:
        if isinstance(kinds[c], T.BinaryType):
            return _floats(F.col(c))
        if not isinstance(kinds[c], T.ArrayType):
            raise IngestError(f"{c}: not a column of vectors")
        return F.col(c).cast("array<double>")
    numbers = [c for c, k in kinds.items() if isinstance(k, T.NumericType) and c.lower() not in IDS]
    if len(numbers) < 2:
        raise IngestError("no column of vectors")
    return F.array(*[F.col(c).cast("double") for c in numbers])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _floats(b):
    import pandas as pd

    return pd.Series([None if x is None else np.frombuffer(x, "<f4").astype(float).tolist() for x in b])


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    names = [c for i in IDS for c in df.columns if c.lower() == i]
    rows = df.select(*( [F.col(names[0]).cast("string").alias("id")] if names else []), vector_column(df).alias("vector")).withColumn("_at", F.monotonically_increasing_id())
    rows = ranked(rows, [], [F.col("_at")], "vectors").withColumnRenamed("rank", "row")
    return rows.select("row", (F.col("id") if names else F.col("row").cast("string")).alias("id"), "vector")


def _jsonl(spark: SparkSession, path: str) -> DataFrame:
    from tierloom.sources.lines import read_lines

    def rows(batches):
        for b in batches:
            out = []
            for at, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if raw.strip():
                    try:
                        obj = json.loads(raw)
                        v = obj.get("vector", obj.get("embedding"))
                        out.append((at, None if obj.get("id") is None else str(obj["id"]), [float(x) for x in v]))
                    except (ValueError, TypeError, AttributeError) as e:
                        raise IngestError(f"{path}:{at}: {e}") from e
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.float64())))], ["row", "id", "vector"])

    df = read_lines(spark, path).mapInArrow(rows, "row bigint, id string, vector array<double>")
    n, with_id = df.agg(F.count("*"), F.count("id")).first()
    if 0 < with_id < n:
        raise IngestError(f"{path}: some rows have ids and some don't")
    return df.withColumn("id", F.coalesce("id", F.col("row").cast("string")))


def read_embeddings(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """row, id (string) and vector (unit length; zero where it wasn't finite) of all embeddings at ``path``; zeroed: whether it was made zero."""
    at = Path(path)
    if at.is_dir() and not any(at.glob("part-*.parquet")):
        files = [p for p in sorted(at.iterdir()) if p.suffix in (".npy", ".parquet", ".jsonl") and p.name != "ids.npy"]
        files.sort(key=lambda p: p.name != "vectors.npy")
    else:
        files = [at]
    if not files or not files[0].exists():
        raise IngestError(f"no embeddings at {path}")
    out, n = None, 0
    for f in files:
        read = {".npy": _npy, ".jsonl": lambda s, p: _jsonl(s, str(p))}.get(f.suffix, lambda s, p: _parquet(s, str(p)))
        if f.is_file() and f.suffix not in (".npy", ".parquet", ".jsonl"):
            raise IngestError(f"{f}: unknown kind of file")
        part = read(spark, f).withColumn("row", F.col("row") + n)
        n += part.count()
        out = part if out is None else out.unionByName(part)
    low, high = out.agg(F.min(F.coalesce(F.size("vector"), F.lit(-1))), F.max(F.size("vector"))).first()
    if low != high or (dims is not None and high != dims):
        raise IngestError(f"{path}: vectors of {low} to {high} dimensions" + (f", not {dims}" if dims else ""))
    length = norm(F.col("vector"))
    bad = ~finite(F.col("vector")) | F.isnan(length) | (length == float("inf"))
    return out.select("row", "id", l2_normalize(F.col("vector")).alias("vector"), bad.alias("zeroed"))
