"""Tiers and what each promises, byte accounting and prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """A tier's vector codec, compression of traces, least recall among ten, most bytes of the original's, and rerank depth."""

    tier: str
    codec: str | None
    zstd_level: int | None
    recall_floor: float | None
    footprint: float
    rerank_depth: int


SPECS = (
    Spec("hot", None, None, None, 1.0, 0),
    Spec("warm", "sq8", 10, 0.99, 0.25, 0),
    Spec("cold", "pq", 19, 0.95, 0.08, 200),
    Spec("cold", "binary", 19, 0.90, 0.08, 500),
)
GB_MONTH = {"traces": 0.023, "vectors": 0.33}


def spec_for(tier: str, codec: str | None = None) -> Spec:
    for s in SPECS:
        if s.tier == tier and (codec is None or s.codec == codec):
            return s
    raise ValueError(f"no such tier: {tier} {codec or ''}".strip())


def specs(spark: SparkSession) -> DataFrame:
    rows = [(s.tier, s.codec, s.zstd_level, s.recall_floor, s.footprint, s.rerank_depth) for s in SPECS]
    return spark.createDataFrame(rows, "tier string, codec string, zstd_level int, recall_floor double, footprint double, rerank_depth int")


def codec_bytes(n: Column, d: Column) -> DataFrame:
    """Per codec: bytes of a row's code and of what all rows share."""
    per_row = {"fp32": (4 * d, F.lit(0)), "sq8": (d, 8 * d), "pq": ((d / 4).cast("bigint"), 1024 * d), "binary": ((d / 8).cast("bigint"), F.lit(0))}
    return F.explode(F.array(*[F.struct(F.lit(k).alias("codec"), (n * a).cast("bigint").alias("codes"), b.cast("bigint").alias("aux")) for k, (a, b) in per_row.items()]))


def monthly_cost(traces_bytes: Column, vectors_bytes: Column) -> Column:
    return traces_bytes / 1e9 * GB_MONTH["traces"] + vectors_bytes / 1e9 * GB_MONTH["vectors"]
