"""Approximate nearest neighbours by additive quantisation: beam-search codes, stored norms, lookup tables, exact reranking.

Whether codes find a table's neighbours is measured on some of its queries; where they don't, the vectors are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierloom.llm.common import ranked, written

#: Codebooks, words in each, states kept while encoding, and rows that the codebooks are fitted on at most.
BOOKS, WORDS, BEAM, SAMPLE = 16, 256, 8, 10_000
#: Queries that a scan has at most, queries and rows that are scored at once, and rows that a task should have at least.
BLOCK, TILE, ROWS, LEAST = 8192, 32, 1 << 16, 1 << 14
#: Candidates of a query, of all rows, that are ranked exactly.
DEPTH = 400
#: Queries (those with the least hashed ids) whose true neighbours are looked up, and the share of these that the codes must find.
PROBES, FLOOR = 256, 0.95
#: Rows that are compared at once when vectors are scanned, and queries.
SLICE, SIDE = 8192, 256


class Codebooks:
    """Full-dimensional codebooks: a vector is the sum of one word of each."""

    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 1):
        """Residual k-means first; then, in turn, codes by beam search, and all words at once by least squares."""
        rng, x = np.random.default_rng(seed), sample.astype(np.float32)
        words = max(1, min(words, len(x)))
        self.books = np.zeros((books, words, x.shape[1]), np.float32)
        rest = x.copy()
        for m in range(books):
            centre = rest[rng.choice(len(rest), words, replace=False)]
            for _ in range(8):
                own = ((centre**2).sum(axis=1) - 2 * rest @ centre.T).argmin(axis=1)
                n = np.bincount(own, minlength=words)
                total = np.stack([np.bincount(own, rest[:, j], words) for j in range(rest.shape[1])], axis=1).astype(np.float32)
                centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), words)])
            own = ((centre**2).sum(axis=1) - 2 * rest @ centre.T).argmin(axis=1)
            self.books[m], rest = centre, rest - centre[own]
        for _ in range(rounds):
            codes = np.concatenate([self.encode(x[at : at + 256])[0] for at in range(0, len(x), 256)]).astype(np.int64)
            rest = x - sum(self.books[m][codes[:, m]] for m in range(books))
            # the normal equations, from how often two words are used together; words that no code uses stay where they are
            gram = np.zeros((books * words, books * words), np.float32)
            right = np.zeros((books * words, x.shape[1]), np.float32)
            for m in range(books):
                own = slice(m * words, (m + 1) * words)
                right[own] = np.stack([np.bincount(codes[:, m], rest[:, j], words) for j in range(x.shape[1])], axis=1)
                for o in range(books):
                    gram[own, o * words : (o + 1) * words] = np.bincount(codes[:, m] * words + codes[:, o], minlength=words * words).reshape(words, words)
            gram[np.diag_indices(len(gram))] += 0.1
            self.books += np.linalg.solve(gram, right).reshape(self.books.shape)
            del gram

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes [n, books] and squared norms of the sums. Keeps the ``beam`` partial sums nearest the vector, book by book."""
        n, d = x.shape
        books, words = self.books.shape[:2]
        rest, codes = x[:, None, :].astype(np.float64), np.zeros((n, 1, 0), np.uint8)  # in double precision, ties don't depend on the batch
        for m in range(books):
            c = self.books[m].astype(np.float64)
            score = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ c.T + (c**2).sum(axis=1)
            keep = min(beam if m < books - 1 else 1, score.shape[1] * words)
            at = np.argpartition(score.reshape(n, -1), keep - 1, axis=1)[:, :keep]
            state, word = at // words, at % words
            rest = np.take_along_axis(rest, state[:, :, None], axis=1) - c[word]
            codes = np.concatenate([np.take_along_axis(codes, state[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0], ((x - rest[:, 0]) ** 2).sum(axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, book, word]: inner products."""
        return np.einsum("qd,mwd->qmw", q.astype(np.float32), self.books)


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: with an id, and a finite vector that isn't zero, of the commonest length."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("embedding") == (common["d"] if common else 0))


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def index(rows: DataFrame, books: int = BOOKS, words: int = WORDS, sample: int = SAMPLE) -> tuple[DataFrame, Codebooks | None]:
    """uid, code, stored norm and vec_id of every row (uid, vec_id, embedding); the codebooks are fitted on the ``sample`` rows whose hashed ids are least."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(some):
        return rows.select("uid", F.lit(b"").alias("code"), F.lit(0.0).cast("float").alias("norm"), "vec_id"), None
    model = Codebooks(_matrix(some), books, words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                codes, norms = model.encode(_matrix(part.column(1)))
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), code, pa.array(norms.astype(np.float32)), part.column(2)], ["uid", "code", "norm", "vec_id"])

    return written(rows.select("uid", "embedding", "vec_id").mapInArrow(encode, "uid bigint, code binary, norm float, vec_id bigint"), "codes"), model


def _search(model: Codebooks, queries: np.ndarray, q: np.ndarray, depth: int):
    """The function that finds, of a partition's codes, the ``depth`` rows that the tables say are nearest each query, ties to the smaller vec_id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)

        def scan(uid: np.ndarray, codes: np.ndarray, norms: np.ndarray, vec: np.ndarray) -> None:
            for lo in range(0, len(q), TILE):
                table = model.tables(q[lo : lo + TILE])
                near = np.broadcast_to(norms, (len(table), len(norms))).copy()
                for m in range(codes.shape[1]):
                    near -= 2 * table[:, m][:, codes[:, m]]
                for i, own in enumerate(near, lo):
                    own[uid == queries[i]] = np.inf
                    score = np.concatenate((held[i][0], own))
                    some = np.flatnonzero(score <= np.partition(score, depth - 1)[depth - 1]) if len(score) > depth else np.arange(len(score))
                    old, new = some[some < len(held[i][0])], some[some >= len(held[i][0])] - len(held[i][0])
                    score, at, of = score[some], *(np.concatenate((h[old], x[new])) for h, x in zip(held[i][1:], (uid, vec), strict=True))
                    keep = np.lexsort((at, of, score))[:depth]
                    held[i] = score[keep], at[keep], of[keep]

        parts: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                if part.num_rows:
                    codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    parts.append((part.column(0).to_numpy(), codes, part.column(2).to_numpy(), part.column(3).to_numpy()))
                if sum(len(p[0]) for p in parts) >= ROWS:
                    scan(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    parts = []
        if parts:
            scan(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        for lo in range(0, len(q), 256):
            some = held[lo : lo + 256]
            whose = np.repeat(queries[lo : lo + 256], [len(h[0]) for h in some])
            score, uid, vec = (np.concatenate([h[j] for h in some]) for j in range(3))
            own = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (whose, uid, score, vec)], ["query", "uid", "near", "vec_id"])

    return search


def _exact(queries: np.ndarray, q: np.ndarray, depth: int):
    """The function that finds, of a partition's rows (uid, vec_id, embedding), the ``depth`` that are nearest each query, ties to the smaller vec_id.

    Products of matrices tell which rows may be; within their rounding, distances are summed from differences.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        bound, own2 = np.full(len(q), np.inf), (q**2).sum(axis=1)
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                uid, vec, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), np.float64)
                x2 = (x**2).sum(axis=1)
                for lo in range(0, len(q), SIDE):
                    near = x2 - 2 * q[lo : lo + SIDE] @ x.T + own2[lo : lo + SIDE, None]
                    for i, d in enumerate(near, lo):
                        slack = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (x2.max() + own2[i])
                        d[uid == queries[i]] = np.inf
                        some = np.flatnonzero(~(d > bound[i] + slack))
                        if len(some) > depth:
                            some = some[~(d[some] > np.partition(d[some], depth - 1)[depth - 1] + slack)]
                        some = some[uid[some] != queries[i]]
                        if len(some):
                            score = np.concatenate((held[i][0], ((x[some] - q[i]) ** 2).sum(axis=1)))
                            of, at = np.concatenate((held[i][1], uid[some])), np.concatenate((held[i][2], vec[some]))
                            keep = np.lexsort((of, at, score))[:depth]
                            held[i] = score[keep], of[keep], at[keep]
                            bound[i] = score[keep[-1]] if len(keep) == depth else np.inf
        for lo in range(0, len(q), SIDE):
            some = held[lo : lo + SIDE]
            whose = np.repeat(queries[lo : lo + SIDE], [len(h[0]) for h in some])
            score, uid, vec = (np.concatenate([h[j] for h in some]) for j in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (whose, uid, score, vec)], ["query", "uid", "near", "vec_id"])

    return search


def _candidates(rows: DataFrame, codes: DataFrame, model: Codebooks | None, own: DataFrame, depth: int) -> DataFrame:
    """query and uid of the ``depth`` nearest rows of each query in ``own`` (uid, embedding): by the codes, or, without a model, by the vectors."""
    asked = own.select("uid", "embedding").orderBy("uid").toArrow()
    q, x = asked["uid"].to_numpy(), asked["embedding"].combine_chunks()
    if model is None:
        part = rows.mapInArrow(_exact(q, _matrix(x, np.float64), depth), "query bigint, uid bigint, near double, vec_id bigint")
    else:
        part = codes.mapInArrow(_search(model, q, _matrix(x), depth), "query bigint, uid bigint, near float, vec_id bigint")
    best = Window.partitionBy("query").orderBy("near", "vec_id", "uid")
    return written(part.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= depth).select("query", "uid"), "candidates")


def _ranks(found: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The candidates found, ranked by the distances of the vectors: query, query_id, vec_id, uid, score and rank."""
    asked = queries.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    both = found.join(rows, "uid").join(asked, "query")
    score = F.sqrt(F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    return both.select("query", "query_id", "vec_id", "uid", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "uid")))


def probed(rows: DataFrame, codes: DataFrame, model: Codebooks, queries: DataFrame, k: int, depth: int) -> float:
    """The share of the k true neighbours of PROBES queries that are among the candidates by codes; rows as far as the k-th count as true."""
    some = written(queries.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(PROBES), "probes")
    true, found = (_ranks(_candidates(rows, codes, m, some, n), rows, some).filter(F.col("rank") <= k) for m, n in ((None, k), (model, depth)))
    true = true.groupBy("query").agg(F.max("score").alias("far"), F.count("*").alias("n"))
    hits = true.join(found.select("query", "score"), "query", "left").groupBy("query").agg(F.first("n").alias("n"), F.count_if(F.col("score") <= F.col("far") * (1 + 1e-12)).alias("hits"))
    got = hits.agg(F.sum("hits"), F.sum("n")).first()
    return got[0] / got[1] if got[1] else 1.0


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """For each row whose vec_id ``every`` divides, the k nearest other rows found: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance of the vectors as given, in double precision; ties go to the smaller vec_id. Vectors
    that are null, zero, of another than the commonest length, or with a null or non-finite component take no part, nor
    do rows without an id. Rows that repeat an id are rows of their own: as queries, each with k rows of the result, and as
    candidates of others and of each other. With fewer candidates than k, all come. An empty table gives no rows. Columns but vec_id and
    embedding are not looked at, whatever their names; a vector has no text, but may be as long as it likes.

    All codes, without the vectors, are scanned for ``block`` queries at a time. Of all rows, a query's ``depth`` best by
    its tables are its candidates, however the rows are spread; those are joined with their vectors, and ranked exactly. A task
    sends ``depth`` rows a query, which is little next to the LEAST codes or more that it scores for it. If the codes find less
    than FLOOR of what brute force finds for PROBES of the queries, all queries' candidates come from a scan of the vectors instead.
    """
    spark, empty = vectors.sparkSession, "query_id bigint, rank int, vec_id bigint, score double"
    rows = written(taking_part(vectors).withColumn("uid", F.monotonically_increasing_id()), "vectors").select("uid", "vec_id", "embedding")
    codes, model = index(rows)
    if model is None:
        return spark.createDataFrame([], empty)
    codes = codes.coalesce(max(1, min(codes.count() // LEAST, 1 << 30)))
    queries = written(ranked(rows.filter(F.col("vec_id") % every == 0), [], [F.col("vec_id"), F.col("uid")], "queries").withColumn("block", F.floor(F.col("rank") / block)), "queries")
    last = queries.agg(F.max("block")).first()[0]
    if last is None:
        return spark.createDataFrame([], empty)
    if probed(rows, codes, model, queries, k, depth) < FLOOR:
        model = None
    found = None
    for i in range(last + 1):
        part = _candidates(rows, codes, model, queries.filter(F.col("block") == i), depth)
        found = part if found is None else found.unionByName(part)
    return _ranks(found, rows, queries).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
