import os

import numpy as np

from tests.llm.cases import documents
from tierloom.llm import ctw_text
from tierloom.operators.tables import shared_dir


def test_only_what_the_scores_are_made_of_stays_on_disk(spark):
    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    docs = documents(spark).limit(50)
    got = ctw_text.scored(docs)
    new = sorted(set(os.listdir(at)) - before)
    assert [n.rsplit("-", 1)[0] for n in new] == ["gathered", "rest", "scores"]
    assert [n for n in os.listdir(f"{at}/{new[0]}") if n.startswith("kind=")] == ["kind=2"]  # the texts
    assert got.count() == 50 == len(got.collect())  # twice: nothing that went is read again


def test_numbers_of_known_keys_by_tables():
    rng = np.random.default_rng(5)
    for n in (1, 256, 257, 5000, 100_000):
        near = rng.integers(0, 1 << 64, dtype=np.uint64) + np.arange(n // 2, dtype=np.uint64)  # keys that differ in their last bits
        key = np.unique(np.concatenate((near, rng.integers(0, 1 << 64, n, dtype=np.uint64), near << np.uint64(48))))
        units = rng.integers(0, (1 << 32) - 1, len(key), dtype=np.uint32)
        known, asked = ctw_text.Units(key, units), rng.integers(0, len(key), 3 * n)
        assert len(known.key) <= 256 and (known.of(key[asked]) == units[asked]).all()
        assert len(known.of(key[:0])) == 0
