"""Clusters of near duplicates are the components of all verified pairs, whoever leads a bucket."""

import numpy as np
import pytest

from tierloom.operators import dedup


def clustered(spark, monkeypatch, sigs):
    """doc_id: (cluster, size, links), for documents with the signatures given."""
    made = spark.createDataFrame([(i, s.tolist()) for i, s in sigs.items()], "id bigint, signature array<bigint>").cache()
    monkeypatch.setattr(dedup, "signatures", lambda rows: rows.select("id").join(made, "id"))
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    docs = spark.createDataFrame([(i, f"text of the document called {word(i)} " + "and so on " * 6) for i in sigs], "doc_id bigint, text string")
    return {r.doc_id: (r.cluster, r.size, r.links) for r in dedup.near_clusters(docs).collect()}


def brute(sigs):
    ids = sorted(sigs)
    same_band = lambda a, b: (a == b).reshape(dedup.BANDS, -1).all(axis=1).any()
    near = {i: [j for j in ids if j != i and same_band(sigs[i], sigs[j]) and (sigs[i] == sigs[j]).mean() >= 0.9] for i in ids}
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            root[i] = min([root[i], *(root[j] for j in near[i])])
    size = {r: sum(x == r for x in root.values()) for r in root.values()}
    return {i: (root[i], size[root[i]], len(near[i])) for i in ids if size[root[i]] > 1}


def test_link_that_the_leader_does_not_have(spark, monkeypatch):
    a = np.arange(128)
    x, y = a.copy(), a.copy()
    x[112:124] += 1000  # 116 of 128 as in a
    y[112:124] += 1000
    y[124:] += 1000
    y[96:104] += 1000  # 116 as in x, 104 as in a; all buckets that x and y share have a too
    assert clustered(spark, monkeypatch, {1: a, 2: x, 3: y}) == {1: (1, 3, 1), 2: (1, 3, 2), 3: (1, 3, 1)}


@pytest.mark.parametrize("block", [512, 3])
def test_drifting_copies_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    sigs = {}
    for f in range(4):
        s = rng.integers(0, 2**40, 128)
        for i in range(12):
            sigs[f * 100 + i] = s = s.copy()
            if i % 4:
                s[rng.choice(np.arange(16 if f else 0, 128), rng.integers(3, 15), replace=False)] = rng.integers(0, 2**40)
    assert clustered(spark, monkeypatch, sigs) == brute(sigs)
