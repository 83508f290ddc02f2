"""Costs of text functions that must not grow with the square of a text, or with a batch."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tierloom.functions import hashing
from tierloom.functions import text as ft
from tierloom.operators import dedup


def test_a_long_text_with_a_second_pass_takes_as_many_passes_as_change_it(spark):
    words = " ".join(f"word{chr(97 + i % 26)}" for i in range(10_000))
    one = spark.createDataFrame([(f"2020-01-01 1234567890 10:00 {words}",)], "text string")
    began = time.time()
    assert one.select(ft.normalize(F.col("text"))).first()[0] == words
    assert time.time() - began < 20


def _run_of(make):
    """The function that a frame would run over batches."""

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802 - Spark's name
            return f

    return make(Rows())


def _texts(n):
    rng = np.random.default_rng(6)
    texts = [None, "", "abcd", "abcde", *(" ".join(f"w{x}" for x in rng.integers(0, 900, 40 + i % 50)) for i in range(n - 4))]
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], ["id", "text"])


def test_signatures_of_a_batch_are_made_some_texts_at_a_time():
    batch = _texts(700)
    out = list(_run_of(dedup.signatures)(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 700
    rng = np.random.default_rng(1337)
    a = rng.integers(0, 2**63, 128, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    b = rng.integers(0, 2**63, 128, dtype=np.uint64)
    got = {i: s for o in out for i, s in zip(o.column(0).to_pylist(), o.column(1).to_pylist(), strict=True)}
    for i, text in enumerate(batch.column(1).to_pylist()):
        h = dedup.shingle_hashes((text or "").encode())
        assert got[i] == ((h[None] * a[:, None] + b[:, None]).min(axis=1) >> np.uint64(1)).tolist()


def test_embedding_holds_no_list_of_a_texts_words():
    batch = _texts(700)
    out = list(_run_of(lambda rows: hashing.embed(rows, 16))(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 700
    text = "some more words " * 20_000
    tracemalloc.start()
    hashing.embed_text(text, 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * len(text)
