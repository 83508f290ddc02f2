"""Training and searches hold no matrix of all rows by all words, or of all rows' outer products."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tierloom.operators import pq_train, search


def peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_training_holds_slices():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60_000, 8))
    words = x[:256]
    assert peak(lambda: pq_train.lloyd(x, words, 1))[1] < 80  # rows by words: 117 MB
    assert peak(lambda: pq_train.refine(x, words, 8.0, 1))[1] < 80


def test_outer_products_of_short_and_long_runs(monkeypatch):
    monkeypatch.setattr(pq_train, "NUMBERS", 90)
    u, starts = np.random.default_rng(3).normal(size=(100, 3)), np.array([0, 2, 5, 6, 60, 64, 99])
    want = [sum(np.outer(r, r) for r in u[a:b]) for a, b in zip(starts, [*starts[1:], 100], strict=True)]
    assert np.allclose(pq_train._outer(u, starts), want)


def test_search_sends_its_queries_in_parts():
    q = np.random.default_rng(4).normal(size=(600, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(np.resize(q, (900, 4)).tolist())], ["id", "vector"])
    out = list(search._scan(np.arange(600), q, search.inner, 3, True)(iter([batch])))
    assert [b.num_rows for b in out] == [768, 768, 264]
