import zlib
from collections import Counter
from math import log10

import numpy as np

from tests.llm.cases import SMALL, documents, hard
from tests.llm.test_ctw_pipeline import Brute, brute_scores
from tierloom.llm import ctw, ctw_text, queries
from tierloom.operators.tables import table


class Running(Brute):
    """The same trees, over whole texts: a "word" is a text, and contexts run through it."""

    @staticmethod
    def steps(text):
        data = ctw.END * ctw.DEPTH + text
        for i in range(ctw.DEPTH, len(data)):
            yield data[i - ctw.DEPTH : i][::-1], data[i]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    counts = brute_scores(rows)
    texts = [ctw_text.running(ctw.tokens((t or "").encode())) for _, t in rows]
    model = Running(Counter(t for t, c in zip(texts, counts, strict=True) if not c[0]))
    want = sorted((str(r[0]), *c[:4], round(c[4], 6), round(model.log10(t), 6)) for r, c, t in zip(rows, counts, texts, strict=True))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ctw_text.scored(docs).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6, atol=1e-5)


def test_running_text_against_brute_force(spark, monkeypatch):
    docs = documents(spark).select("doc_id", "text").filter("n_chars < 300").unionByName(hard(spark).select("doc_id", "text").filter("doc_id not in (7, 8, 11) or doc_id is null"))
    check(docs)
    monkeypatch.setattr(ctw_text, "SENT", 3)
    monkeypatch.setattr(ctw_text, "CHUNK", 20000)
    monkeypatch.setattr(ctw_text, "SLICE", 2000)
    monkeypatch.setattr(ctw_text, "PIECE", 50)
    check(docs)


def test_order_of_words_counts(spark):
    """A text with its words in another order has another score: contexts run across spaces."""
    text = "the cat sat on the mat and saw it"
    shuffled = "mat it the saw on cat and the sat"
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    a, b = next(i for i in range(100) if not held(i)), next(i for i in range(100) if held(i))
    rows = [(a, text)] * 9 + [(b, shuffled)]
    got = {r.doc_id: r for r in ctw_text.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[a].base_score == got[b].base_score and got[a].score > got[b].score + 1


def test_the_query_is_of_the_running_text(spark):
    key = lambda r: (r.doc_id, r.score)
    got = sorted(queries.op8_lm_score(spark, SMALL).collect(), key=key)
    want = sorted(ctw_text.scored(table(spark, SMALL, "documents")).collect(), key=key)
    assert np.allclose([r.score for r in got], [r.score for r in want])


def test_model_beats_the_unigram_on_held_out_texts(spark):
    got = [r for r in ctw_text.scored(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_nothing_to_score_or_to_learn(spark):
    assert ctw_text.scored(hard(spark, empty=True)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = ctw_text.scored(spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and abs(r.score - 32 * log10(0.5)) < 1e-5
