import hashlib
import re

import numpy as np
import pytest

from tests.llm.cases import documents, hard
from tierloom.llm import exact_dedup, simhash


def brute_groups(rows):
    """rows: (doc_id, text). Per row: keep_id, group_size, sha, kept rows a group."""
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    out = []
    for i, n in enumerate(norm):
        own = [j for j, m in enumerate(norm) if m == n]
        best = min(own, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        out.append((rows[i][0], rows[best][0], len(own), hashlib.sha256(n.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("make", [hard, documents])
def test_exact_groups_against_brute_force(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = exact_dedup.exact_groups(docs).collect()
    key = lambda r: str(tuple(r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute_groups(rows), key=key)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.text_sha256 for r in got})


@pytest.mark.parametrize("leaves,rounds", [(1, 1), (2, 3), (7, 2), (64, 3)])
def test_tree_merge_does_not_depend_on_its_shape(spark, leaves, rounds):
    dig = exact_dedup.digests(documents(spark)).repartition(9).cache()
    got = exact_dedup.tree_merge(dig, leaves, rounds).collect()
    assert len({bytes(r.digest) for r in got}) == len(got) == dig.select("digest").distinct().count()
    assert sum(r.n for r in got) == dig.count()


def brute_links(fps, bits=4):
    fps = np.array(fps, np.uint64)
    return [np.flatnonzero(np.bitwise_count(fps ^ x) <= bits) for x in fps]


@pytest.mark.parametrize("make", [hard, documents])
def test_near_groups_against_brute_force(spark, make):
    docs = make(spark)
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_groups(docs).collect()
    fps = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    near = brute_links(fps)
    root = list(range(len(rows)))
    for _ in rows:
        for i, n in enumerate(near):
            root[i] = min(root[j] for j in n)
    ids = lambda i: [r.doc_id for r, x in zip(rows, root, strict=True) if x == root[i] and r.doc_id is not None]
    want = [(r.doc_id, f"{f:016x}", len(near[i]) - 1, min(ids(i), default=None)) for i, (r, f) in enumerate(zip(rows, fps, strict=True))]
    key = lambda r: str(tuple(r))
    assert sorted(((r.doc_id, r.fingerprint, r.n_near, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(set(root))
    assert simhash.drop_near_duplicates(docs).count() == len(set(root))


def test_fingerprint_by_its_definition():
    import xxhash

    text = "The quick Brown fox É jumps  over the lazy dog É the quick"
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_links_lose_none_even_in_crowded_parts(spark, m, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)  # values are split over several keys
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    some = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for x in base for _ in range(4)]
    some += [int(base[0]) & ~0xFFFF | int(x) for x in rng.integers(0, 2**16, 60)]  # one value of three quarters of the bits
    fps = sorted(set(some))
    nodes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), 1) for x in fps], "fp bigint, n bigint")
    got = simhash.links(nodes, 4, m).select("fp", "other").collect()
    assert len(got) == len(set(got))
    want = {(int(np.uint64(x).astype(np.int64)), int(np.uint64(fps[j]).astype(np.int64))) for x, near in zip(fps, brute_links(fps), strict=True) for j in near if fps[j] != x}
    assert {tuple(r) for r in got} == want


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(0)
    costs = [np.vstack([np.zeros(50), np.sort(rng.random((5, 50)), axis=0)]).astype(np.float32) for _ in range(3)]
    t = simhash.thresholds(costs, 2)
    assert (t.sum(axis=0) == 2).all()
    from itertools import product

    for i in range(50):
        cost = lambda e, i=i: sum(c[x + 1, i] for c, x in zip(costs, e, strict=True))
        least = min(cost(e) for e in product(range(-1, 5), repeat=3) if sum(e) == 2)
        assert abs(cost(t[:, i]) - least) < 1e-6


def test_empty_tables(spark):
    docs = hard(spark, empty=True)
    assert exact_dedup.exact_groups(docs).count() == 0 and exact_dedup.drop_exact_duplicates(docs).count() == 0
    assert simhash.near_groups(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0
