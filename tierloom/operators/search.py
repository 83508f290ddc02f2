"""Top-k search of a set of queries over all rows, in blocks of queries; scans score whole Arrow batches as matrices.

A block of queries, of a fixed size at most, goes to every partition; a partition keeps the k best rows a query, and only
those are shuffled. Ties go to the smaller id, here and in the merge, so the result doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierloom.operators.tables import ranked, written

BLOCK = 4096
ROWS = 8192
#: Queries of a block that are scored at once.
TILE = 256
Scorer = Callable[[np.ndarray], Callable[[pa.RecordBatch], np.ndarray]]


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Lists of one length as rows. No rows give an empty matrix; a null, or lists of different lengths, are an error, as their numbers would be of other rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype)
    sizes = pc.list_value_length(column)
    if column.null_count or pc.min_max(sizes)["min"] != pc.min_max(sizes)["max"]:
        raise ValueError("vectors must not be null, and all of one length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id, in order."""
    if k < len(scores):
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def top_k(rows: DataFrame, queries: DataFrame, scorer: Scorer, k: int, but_itself: bool = True) -> DataFrame:
    """query_id, rank (from 1), id and score of the k rows with the highest scores.

    rows: id and what the scorer reads; queries: query_id and vector. ``scorer`` gets a block's query matrix and returns the
    function that scores a batch: [query, row].
    """
    spark = rows.sparkSession
    queries = written(ranked(queries, [], [F.col("query_id")], "queries").withColumn("block", F.floor(F.col("rank") / BLOCK)), "queries")
    last = queries.agg(F.max("block")).first()[0]
    kind = "query_id bigint, id bigint, score double"
    found = None
    for i in range(0 if last is None else last + 1):
        own = queries.filter(F.col("block") == i).orderBy("query_id").select("query_id", "vector").toArrow()
        part = rows.mapInArrow(_scan(own["query_id"].to_numpy(), matrix(own["vector"]), scorer, k, but_itself), kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], kind)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _scan(query_ids: np.ndarray, q: np.ndarray, scorer: Scorer, k: int, but_itself: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [(lo, scorer(q[lo : lo + TILE])) for lo in range(0, len(q), TILE)]
        held = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for lo, score in tiles:
                    for i, own in enumerate(score(b), lo):
                        if but_itself:
                            own = np.where(ids == query_ids[i], -np.inf, own)
                        x, y = np.concatenate([held[i][0], own]), np.concatenate([held[i][1], ids])
                        keep = best(x, y, k)
                        held[i] = (x[keep], y[keep])
        for lo in range(0, len(q), TILE):
            some = held[lo : lo + TILE]
            qid = np.repeat(query_ids[lo : lo + TILE], [len(x) for x, _ in some])
            s, ids = (np.concatenate([h[j] for h in some]) for j in range(2))
            own = s > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(qid[own]), pa.array(ids[own]), pa.array(s[own])], ["query_id", "id", "score"])

    return scan


def inner(q: np.ndarray):
    """Exact inner products with the column ``vector``."""
    return lambda b: q @ matrix(b.column(b.schema.get_field_index("vector"))).T


def rerank(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int, vector: str = "vector") -> DataFrame:
    """The candidates found, scored again by inner products with ``vector`` of their rows; the k best of each query."""
    again = found.select("query_id", "id").join(rows.select("id", F.col(vector).alias("_v")), "id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
    products = F.aggregate(F.zip_with("_v", "_q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    again = again.select("query_id", "id", products.alias("score")).withColumn("rank", F.row_number().over(w))
    return again.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
