"""Recall of the tiers' codecs, on queries that are held out: nothing is fitted on them, and they aren't searched."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.errors import AuditError
from tierloom.operators.codecs import PQ, SQ8, Binary, recalls
from tierloom.operators.search import inner, rerank, top_k
from tierloom.operators.tables import ranked, written
from tierloom.plans import tiers

#: Rows of the database at least: recall among a hundred of fewer says nothing.
LEAST = 100
KS = (1, 10, 100)


def split(rows: DataFrame, queries: int, seed: int = 1337) -> tuple[DataFrame, DataFrame]:
    """Database and held-out queries: the ``queries`` rows whose hashed ids are least are the queries."""
    drawn = ranked(rows.withColumn("_draw", F.xxhash64(F.lit(seed), "id")), [], [F.col("_draw"), F.col("id")], "split")
    drawn = written(drawn.select("id", "vector", (F.col("rank") < queries).alias("_out")), "split")
    return drawn.filter(~F.col("_out")).select("id", "vector"), drawn.filter("_out").select(F.col("id").alias("query_id"), "vector")


def verify(rows: DataFrame, queries: DataFrame, m: int | None = None) -> DataFrame:
    """codec, recall_1, recall_10, recall_100, codes and aux (bytes). rows: id and vector, the database; queries: query_id and vector, none of its rows."""
    n = rows.count()
    if n < LEAST:
        raise AuditError(f"recall needs a database of {LEAST} vectors, not {n}")
    truth = written(top_k(rows, queries, inner, max(KS), False), "truth")
    sq8, pq = SQ8.fit(rows), PQ.fit(rows, m)
    code = lambda x: written(x.select("id", "code"), "codes")  # noqa: E731 - written once: all blocks of queries read the codes
    found = {
        "sq8": top_k(code(sq8.encode(rows)), queries, sq8.scorer, 100, False),
        "pq": rerank(top_k(code(pq.encode(rows)), queries, pq.scorer, tiers.spec_for("cold", "pq").rerank_depth, False), rows, queries, 100),
        "binary": rerank(top_k(code(Binary.encode(rows)), queries, Binary.words_scorer, tiers.spec_for("cold", "binary").rerank_depth, False), rows, queries, 100),
    }
    out = None
    for name, f in found.items():
        row = recalls(truth, written(f, name), KS).select(F.lit(name).alias("codec"), "*")
        out = row if out is None else out.unionByName(row)
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).select(tiers.codec_bytes(F.col("n"), F.col("d")).alias("x")).select("x.*")
    return out.join(sizes, "codec")


def sample_embeddings(n: int, d: int, seed: int = 1337, clusters: int = 200, rank: int = 16, near: float = 0.35) -> np.ndarray:
    """Unit vectors of a mixture of low-rank clusters, of Zipf's sizes, a share of which are near copies of others: [n, d], for demonstrations."""
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, clusters + 1) ** 1.05
    centre, basis = rng.normal(size=(clusters, d)), rng.normal(size=(clusters, min(rank, d), d)) / np.sqrt(d)
    own = rng.choice(clusters, n, p=weight / weight.sum())
    x = np.empty((n, d), np.float32)
    for at in range(0, n, 8192):
        some = own[at : at + 8192]
        x[at : at + 8192] = centre[some] / np.sqrt(d) + 0.5 * np.einsum("nr,nrd->nd", rng.normal(size=(len(some), basis.shape[1])), basis[some])
    copies = np.flatnonzero(rng.random(n) < near)
    copies = copies[copies > 0]
    x[copies] = x[(rng.random(len(copies)) * copies).astype(np.int64)] + 0.01 * rng.normal(size=(len(copies), d))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
