"""A demonstration embedder: hashed words and word pairs, without a model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are sent at once; a text is read alone, and none of its words is kept.
TEXTS = 256
_WORD = re.compile(r"[a-z0-9]+")


def embed_text(text: str, dims: int) -> np.ndarray:
    """The sum of a signed unit for each word and pair of neighbours, over its norm; a text of no words is the zero vector."""
    out, last = np.zeros(dims), None
    for found in _WORD.finditer(text.lower()):
        word = found.group()
        for t in (word,) if last is None else (word, f"{last}_{word}"):
            h = int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little")
            out[(h >> 1) % dims] += 1 if h & 1 else -1
        last = word
    n = np.linalg.norm(out)
    return out / n if n else out


def embed(rows: DataFrame, dims: int) -> DataFrame:
    """id and vector of every row's text (null: the zero vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                x = np.concatenate([embed_text(t.as_py() or "", dims) for t in part.column(1)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dims, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "vector"])

    return rows.select("id", "text").mapInArrow(run, "id bigint, vector array<double>")
