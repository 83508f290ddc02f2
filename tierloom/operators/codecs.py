"""Vector codecs: scalar (SQ8), sign bits and product quantisation, as fit, encode, decode and scan over DataFrames.

Rows have ``id`` and ``vector`` (array<double>); a codec adds ``code``. What a fit learns is small (a few numbers a
dimension, 256 words a subspace) and comes to the driver; rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.functions.vectors import sign_words
from tierloom.operators import pq_train
from tierloom.operators.search import matrix
from tierloom.operators.tables import ranked, written


def _batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


class SQ8:
    """Eight bits a dimension between its least and largest value."""

    def __init__(self, mins: np.ndarray, scale: np.ndarray):
        self.mins, self.scale = mins.astype(np.float64), scale.astype(np.float64)

    @staticmethod
    def ranges(rows: DataFrame) -> DataFrame:
        """pos (from 0), mins and scale (floats): a partition sends one row a dimension."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = high = None
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0))
                    low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                    high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
            if low is not None:
                yield _batch(["pos", "low", "high"], np.arange(len(low), dtype=np.int32), low, high)

        got = rows.select("vector").mapInArrow(partial, "pos int, low double, high double").groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        return got.select("pos", F.col("low").cast("float").alias("mins"), ((F.col("high") - F.col("low")) / 255).cast("float").alias("scale"))

    @classmethod
    def fit(cls, rows: DataFrame) -> SQ8:
        got = cls.ranges(rows).orderBy("pos").toArrow()
        return cls(got["mins"].to_numpy(), got["scale"].to_numpy())

    def codes(self, x: np.ndarray) -> np.ndarray:
        flat = self.scale == 0
        return np.where(flat, 0, np.clip(np.rint((x - self.mins) / np.where(flat, 1, self.scale)), 0, 255)).astype(np.uint8)

    def values(self, codes: np.ndarray) -> np.ndarray:
        return codes * self.scale + self.mins

    def encode(self, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _batch(["id", "vector", "code"], *b.columns, pa.array([c.tobytes() for c in self.codes(matrix(b.column(1)))], pa.binary()))

        return rows.select("id", "vector").mapInArrow(run, "id bigint, vector array<double>, code binary")

    def add(self, coded: DataFrame, rows: DataFrame) -> DataFrame:
        """More rows, encoded by the same ranges, after those that there are; their ids go on from the last one's."""
        last = coded.agg(F.max("id")).first()[0]
        more = ranked(rows.select("id", "vector"), [], [F.col("id")], "added").select((F.col("rank") + (0 if last is None else last + 1)).alias("id"), "vector")
        return coded.select("id", "code").unionByName(self.encode(more).select("id", "code"))

    def scorer(self, q: np.ndarray):
        """Inner products with the decoded rows, without decoding them: (q * scale) @ codes + q @ mins."""
        scaled, offset = q * self.scale, q @ self.mins

        def score(b: pa.RecordBatch) -> np.ndarray:
            codes = np.frombuffer(b"".join(b.column(b.schema.get_field_index("code")).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            return scaled @ codes.T.astype(np.float64) + offset[:, None]

        return score


class Binary:
    """One bit a dimension: whether it is positive."""

    @staticmethod
    def encode(rows: DataFrame) -> DataFrame:
        return rows.select("id", "vector", sign_words(F.col("vector")).alias("code"))

    @staticmethod
    def scorer(q: np.ndarray):
        """Minus the number of differing bits."""
        own = np.packbits(q > 0, axis=1)

        def score(b: pa.RecordBatch) -> np.ndarray:
            bits = np.packbits(matrix(b.column(b.schema.get_field_index("vector"))) > 0, axis=1)
            return -np.array([np.bitwise_count(bits ^ o).sum(axis=1, dtype=np.int64) for o in own], np.float64).reshape(len(own), -1)

        return score


    @staticmethod
    def decode(coded: DataFrame) -> DataFrame:
        """id and vector, of ones and minus ones. coded: id, code and d, the dimensions."""
        bit = lambda i: F.getbit(F.get("code", F.floor(i / 63).cast("int")), i % 63)
        return coded.select("id", F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: (bit(i) * 2 - 1).cast("double")).alias("vector"))

    @staticmethod
    def words_scorer(q: np.ndarray):
        """The same from the codes alone, 63 bits a word."""
        bits = (q > 0).astype(np.uint64)
        own = np.stack([(bits[:, i : i + 63] << np.arange(min(63, q.shape[1] - i), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for i in range(0, q.shape[1], 63)], axis=1)

        def score(b: pa.RecordBatch) -> np.ndarray:
            words = matrix(b.column(b.schema.get_field_index("code")), np.int64).view(np.uint64)
            return -np.array([np.bitwise_count(words ^ o).sum(axis=1, dtype=np.int64) for o in own], np.float64).reshape(len(own), -1)

        return score


class PQ:
    """m subspaces of 256 words each; a row is the numbers of its words."""

    ETA = 8.0

    def __init__(self, words: np.ndarray):
        """words: [m, 256, d / m]"""
        if words.ndim != 3 or not 1 <= words.shape[1] <= 256:
            raise ValueError("words must be of m subspaces, 1 to 256 in each: a code has eight bits a subspace")
        self.words = words

    @staticmethod
    def subspaces(d: int, m: int | None = None, bits: int = 8) -> int:
        """The number of subspaces, by default a fourth of the dimensions, of which it must be a divisor; codes have eight bits."""
        if bits != 8:
            raise ValueError("codes have eight bits a subspace")
        m = max(1, d // 4) if m is None else m
        if m < 1 or d % m:
            raise ValueError(f"{m} subspaces don't divide {d} dimensions")
        return m

    @classmethod
    def from_rows(cls, rows: DataFrame, m: int, n: int = 256) -> PQ:
        """The subvectors of the n rows with the smallest ids as words: a codebook that needs no training."""
        x = matrix(rows.orderBy("id").limit(n).select("vector").toArrow()["vector"])
        return cls(x.reshape(len(x), m, -1).transpose(1, 0, 2))

    @classmethod
    def fit(cls, rows: DataFrame, m: int | None = None, sample: int = 120_000, seed: int = 1337) -> PQ:
        """Words of each subspace, trained in a task of its own, on the ``sample`` rows whose hashed ids are least."""
        some = written(rows.orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
        dims = some.agg(F.max(F.size("vector"))).first()[0]
        if not dims:
            raise ValueError("nothing to fit on")
        m, eta = cls.subspaces(dims, m), cls.ETA
        d = dims // m
        parts = some.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), "id", "vector")
        parts = parts.select("j", "id", F.slice("vector", F.col("j") * d + 1, F.lit(d)).alias("x"))

        def train(t: pa.Table) -> pa.Table:
            x, j = matrix(t.sort_by("id")["x"]), t["j"][0].as_py()
            words = pq_train.train(x, min(256, len(x)), eta, np.random.default_rng([seed, j]))
            return pa.table({"j": pa.array([j], pa.int32()), "words": pa.array([words.ravel().tolist()], pa.list_(pa.float64()))})

        got = parts.groupBy("j").applyInArrow(train, "j int, words array<double>").orderBy("j").toArrow()
        return cls(np.array([np.array(w).reshape(-1, d) for w in got["words"].to_pylist()]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The word with the least anisotropic cost: |c|^2 - 2 eta (x.c) + (eta - 1) (x.c)^2 / |x|^2, x the subvector."""
        m = len(self.words)
        parts = x.reshape(len(x), m, -1)
        return np.stack([pq_train.anisotropic_costs(parts[:, j], self.words[j], self.ETA).argmin(axis=1).astype(np.uint8) for j in range(m)], axis=1)

    def encode(self, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    yield _batch(["id", "vector", "code"], *part.columns, pa.array([c.tobytes() for c in self.codes(matrix(part.column(1)))], pa.binary()))

        return rows.select("id", "vector").mapInArrow(run, "id bigint, vector array<double>, code binary")

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[j][codes[:, j]] for j in range(len(self.words))], axis=1)

    def scorer(self, q: np.ndarray):
        """A table of each query's inner products with all words; a row's score is the sum of its words' entries."""
        m = len(self.words)
        table = np.einsum("qmd,mwd->qmw", q.reshape(len(q), m, -1), self.words)

        def score(b: pa.RecordBatch) -> np.ndarray:
            codes = np.frombuffer(b"".join(b.column(b.schema.get_field_index("code")).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            return sum(table[:, j, codes[:, j]] for j in range(m))

        return score


def recall_at(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: the mean share, over queries, of the k true rows that were found among the first k."""
    a = truth.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias("a"))
    b = found.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias("b"))
    hit = F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<bigint>")))) / k
    return a.join(b, "query_id", "left").agg(F.round(F.avg(hit), 6).alias("recall"), F.count("*").alias("queries"))


def recalls(truth: DataFrame, found: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row: recall_k for each k, from one join of the two rankings."""
    most = max(ks)
    a = truth.filter(F.col("rank") <= most).select("query_id", "id", F.col("rank").alias("a"))
    b = found.filter(F.col("rank") <= most).select("query_id", "id", F.col("rank").alias("b"))
    both = a.join(b, ["query_id", "id"], "left")
    hits = both.groupBy("query_id").agg(*[(F.count_if((F.col("a") <= k) & (F.coalesce("b", F.lit(most + 1)) <= k)) / k).alias(f"r{k}") for k in ks])
    return hits.agg(*[F.round(F.avg(f"r{k}"), 6).alias(f"recall_{k}") for k in ks])
