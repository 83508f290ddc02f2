"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a document."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import written

#: The share of the class covariance that stays when it is shrunk towards the pooled one, and of that towards its own diagonal.
OWN, FULL = 0.5, 0.9
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "bare_symbols", "ends", "repeated_words", "stutters", "repeated_lines", "line_words", "short_words", "odd_words", "shouted", "entropy",
)
D = len(FEATURES)
_LINE, _SYMBOL, _ENDS = re.compile(rb"[\r\n]+"), bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"), b".,;:?!"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOL)
_UPPER, _DIGIT, _END = (bytes(c for c in range(256) if c not in keep) for keep in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", _ENDS))


def _share(part: float, whole: float) -> float:
    """The log of a share, kept finite; a share of nothing is none, however short the text."""
    return float(np.log(part / max(whole, 1) + 0.02))


def statistics(text: bytes) -> list[float]:
    """The FEATURES of a text (UTF-8). An empty text has those of no words."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    lines = [x for x in _LINE.split(text) if x.strip()]
    counts, of_lines = Counter(words), Counter(lines)
    symbols = len(text.translate(None, _NOT_SYMBOL))
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256)
    p = letters[letters > 0] / size
    bare = sum(c for w, c in counts.items() if not w.translate(None, _SYMBOL))
    odd = sum(c for w, c in counts.items() if w[-1] in _SYMBOL)
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w[:1].isupper() and w.upper() == w)
    return [
        float(np.log1p(n)),
        float(np.log((len(text) - max(0, n - 1) + 1) / (n + 1))),
        _share(len(text.translate(None, _UPPER)), size),
        _share(len(text.translate(None, _DIGIT)), size),
        _share(symbols, size),
        _share(bare, n),
        _share(len(text.translate(None, _END)), n),
        _share(n - len(counts), n) - 0.2 * float(np.log1p(n)),  # a longer text repeats more words
        _share(sum(map(eq, words, islice(words, 1, None))), n),
        _share(len(lines) - len(of_lines), len(lines)),
        float(np.log((n + 1) / (len(lines) + 1))),
        _share(sum(c for w, c in counts.items() if len(w) <= 3), n),
        _share(odd, n),
        _share(shouted, n),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and x, the statistics, of every document and whole text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(b.num_columns - 1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*b.schema.names[:-1], "x"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(compute, "doc_id bigint, held_out boolean, x array<double>")


class Discriminant:
    """Per class: mean, inverse Cholesky factor of the shrunk covariance and log determinant, computed once and kept."""

    def __init__(self, n: np.ndarray, first: np.ndarray, second: np.ndarray, own: float = OWN, full: float = FULL):
        """n: [2] rows; first: [2, D] sums; second: [2, D, D] sums of products."""
        self.fit = bool((n > D + 1).all())
        self.prior = float(np.log(n[1] + 1) - np.log(n[0] + 1))
        if not self.fit:  # nothing to tell the classes apart by: the score is the prior
            return
        self.mean = first / n[:, None]
        scatter = second - n[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(axis=0) / n.sum()
        self.factor, self.logdet = [], []
        for k in (0, 1):
            c = own * scatter[k] / n[k] + (1 - own) * pooled
            c = full * c + (1 - full) * np.diag(np.diag(c)) + 1e-6 * np.eye(D)
            low = np.linalg.cholesky(c)
            self.factor.append(np.linalg.inv(low))
            self.logdet.append(2 * float(np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability-like score of class 1: the log odds are divided by the number of statistics, as these aren't independent."""
        odds = np.full(len(x), self.prior)
        if self.fit:
            for k, sign in ((0, 0.5), (1, -0.5)):
                odds += sign * ((((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) + self.logdet[k])
        return 1 / (1 + np.exp(-np.clip(odds / D, -30, 30)))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all labelled rows that aren't held out; each class is summed where the rows are, and D * (D + 1) + 1 sums a class come to the driver.

    A document labelled more than once has its labels' mean, rounded up from a half; rows without a label of 0 or 1, or without doc_id, teach nothing.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, D + 1, D + 1))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, D)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").filter("quality in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("y"))
    got = rows.filter(~F.col("held_out")).join(known, "doc_id").select("x", "y").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(2 * (D + 1) ** 2)
    for r in got.collect():
        total[r["at"]] = r["v"]
    total = total.reshape(2, D + 1, D + 1)
    return Discriminant(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: likelier of quality 1), predicted (1 if score >= 0.5).

    The scores come from the text alone. Null and empty texts are scored as texts of no words; repeated rows each get the
    same score; a null doc_id isn't held out and has no label. With fewer than D + 2 rows of either class the score is
    the classes' ratio. An empty table gives no rows.
    """
    rows = written(features(docs), "features")
    model = fit(rows, labels)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(2).to_pylist(), float).reshape(-1, D)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(apply, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted to be good, with all their columns. Only statistics are joined with labels; texts don't move."""
    model = fit(written(features(docs), "features"), labels)

    def good(text) -> pa.Array:
        x = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in text.cast(pa.large_binary())], float).reshape(-1, D)
        return pa.array(model.score(x) >= 0.5)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(good(b.column(b.schema.get_field_index("text"))))

    return docs.mapInArrow(keep, docs.schema)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
