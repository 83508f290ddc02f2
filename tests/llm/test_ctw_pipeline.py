import re
import zlib
from collections import Counter
from math import lgamma, log, log10

import numpy as np
import pytest

from tests.llm.cases import SMALL, documents, hard
from tierloom.llm import bpe, ctw, exact_dedup, quality, simhash
from tierloom.operators.tables import table


class Brute:
    """Context-tree weighting by its definition: dictionaries of counts, and recursion."""

    def __init__(self, words):
        self.n = {}  # (depth, context, node): [zeros, ones]
        self.below = {}
        for word, c in words.items():
            for ctx, byte in self.steps(word):
                for k in range(8) if c else ():
                    node, bit = (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1
                    for d in range(ctw.DEPTH + 1):
                        self.n.setdefault((ctx[:d], node), [0, 0])[bit] += c
                        if d:
                            self.below.setdefault((ctx[: d - 1], node), set()).add(ctx[:d])
        self.log_w = {}

    @staticmethod
    def steps(word):
        data = word if word[1:] == ctw.END else word + b" "
        for i in range(1, len(data)):
            ctx = data[:i][::-1][: ctw.DEPTH]
            yield ctx + word[:1] * (ctw.DEPTH - len(ctx)), data[i]

    def kt(self, key):
        a, b = self.n[key]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(np.pi)

    def weighted(self, key):
        if key not in self.log_w:
            ctx, node = key
            own = self.kt(key)
            if len(ctx) < ctw.DEPTH:
                own = np.logaddexp(log(0.5) + own, log(0.5) + sum(self.weighted((c, node)) for c in self.below[key]))
            self.log_w[key] = own
        return self.log_w[key]

    def zero(self, ctx, node, d=0):
        """The probability of a zero below and at depth d."""
        a, b = self.n.get((ctx[:d], node), (0, 0))
        p = (a + 0.5) / (a + b + 1)
        if d == ctw.DEPTH or (ctx[: d + 1], node) not in self.n:
            return p
        w = np.exp(log(0.5) + self.kt((ctx[:d], node)) - self.weighted((ctx[:d], node)))
        return w * p + (1 - w) * self.zero(ctx, node, d + 1)

    def log10(self, word):
        total = 0.0
        for ctx, byte in self.steps(word):
            for k in range(8):
                p = self.zero(ctx, (1 << k) | byte >> (8 - k))
                total += log10(1 - p if byte >> (7 - k) & 1 else p)
        return total


def brute_scores(rows):
    """(doc_id, text): held out, tokens, known, N, base score and score of each."""
    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    tok = [[w.encode() for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [ctw.END] for _, t in rows]
    c = Counter(w for t, o in zip(tok, out, strict=True) if not o for w in t)
    names = [w for w, _ in sorted(((w, k) for w, k in c.items() if w != ctw.END and len(w) <= ctw.SHORT), key=lambda x: (-x[1], x[0]))][: len(ctw.CLASSES) - 1]
    classed = [ctw.classed(b" ".join(t[:-1]), names)[0] for t in tok]
    model = Brute(Counter(z + w for z, t, o in zip(classed, tok, out, strict=True) if not o for w in t))
    memo = {}
    for z, t in zip(classed, tok, strict=True):
        for w in t:
            if z + w not in memo:
                memo[z + w] = model.log10(z + w)
    n, v = sum(c.values()), len(c)
    return [
        (o, len(t), sum(w in c for w in t), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in t), sum(memo[z + w] for w in t) - log10(len(names) + 1))
        for o, z, t in zip(out, classed, tok, strict=True)
    ]


@pytest.mark.parametrize("sent", [150_000, 3])
def test_scores_against_brute_force(spark, sent, monkeypatch):
    monkeypatch.setattr(ctw, "SENT", sent)  # with few words sent, the others are joined
    docs = documents(spark).select("doc_id", "text").filter("n_chars < 400").unionByName(hard(spark).select("doc_id", "text").filter("doc_id not in (7, 8) or doc_id is null"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((str(r[0]), *(round(x, 6) for x in s)) for r, s in zip(rows, brute_scores(rows), strict=True))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ctw.scored(docs).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-5)


def test_probabilities_of_a_byte_sum_to_one():
    words = Counter({b"\xf5the": 50, b"\xf5then": 7, b"\xf6der": 20, b"\xf5" + ctw.END: 9})
    key, word = ctw.positions(list(words))
    k, n = ctw._summed(key, np.array(list(words.values()))[word])
    t = ctw.subtrees(k, n)[ctw.CUT]
    top = ctw.Top(*t[:4])
    for ctx in (key[1], key[5], key[-1], np.uint64(0x4142434445464700)):
        every = (ctx & np.uint64(0xFFFFFFFFFFFFFF00)) | np.arange(256, dtype=np.uint64)
        have = np.concatenate([k, every])
        lp = ctw.log10_bytes(have, np.concatenate([n, np.zeros(256, n.dtype)]), top)[len(k) :]
        assert abs((10**lp).sum() - 1) < 1e-9


def test_model_beats_the_unigram_on_held_out_texts(spark):
    got = [r for r in ctw.scored(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_nothing_to_score_or_to_learn(spark):
    assert ctw.scored(hard(spark, empty=True)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = ctw.scored(spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and abs(r.score - 32 * log10(0.5)) < 1e-9


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    docs = table(spark, SMALL, "documents")
    labels = table(spark, SMALL, "labels")
    at = dict(cp.STAGES)
    good = at["quality"](spark, docs, SMALL).cache()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.scored(docs, labels).collect() if r.predicted}
    exact = at["exact_dedup"](spark, good, SMALL).cache()
    assert {r.doc_id for r in exact.collect()} == {r.doc_id for r in exact_dedup.exact_groups(good).collect() if r.kept}
    near = at["near_dedup"](spark, exact, SMALL).cache()
    assert {r.doc_id for r in near.collect()} == {r.component_id for r in simhash.near_groups(exact).collect()}
    mixed = at["mix"](spark, near, SMALL).cache()
    assert mixed.count() and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in near.collect()}
    assert all(f.columns == cp.COLUMNS for f in (good, exact, near, mixed))
    text = {r.doc_id: r.text for r in docs.collect()}
    coded = at["encode"](spark, mixed, SMALL)
    decoded = coded.select("doc_id", "n_tokens", bpe.Tokenizer(spark).decode(coded["ids"]).alias("b")).collect()
    assert len(decoded) == mixed.count() and all(bytes(r.b).decode() == text[r.doc_id] for r in decoded)
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, SMALL).collect()) == sorted((r.doc_id, r.n_tokens) for r in decoded)
