import hashlib
import random
import struct
from collections import Counter
from math import log

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tests.llm.cases import documents, hard
from tierloom.llm import bpe, token_counts

LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.RANKS), special_tokens={})


def test_digests_are_the_librarys(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(hard(spark).select("doc_id", "text"))
    texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()): r.text or "" for r in docs.collect()}
    got = bpe.digests(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id, r.decoded_sha256])  # the key: decoding gives the text back
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_words_that_are_not_cached_are_folded_in_place(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    got = bpe.Tokenizer(spark).encode(documents(spark).limit(40).select("doc_id", "text")).collect()
    assert all(r.ids == LIBRARY.encode_ordinary(r.text) for r in got)


def test_documents_go_to_one_python_worker_a_task_without_their_texts(spark):
    docs = documents(spark).select("doc_id", "text")
    plan = bpe.Tokenizer(spark).digests(docs, ids=True)._jdf.queryExecution().optimizedPlan()
    assert str(plan.nodeName()) == "MapInArrow" and not str(plan.child().toString()).count("MapInArrow")
    assert [a.name() for a in (plan.child().output().apply(i) for i in range(plan.child().output().size()))] == ["c0", "words", "rare", "folded"]


@pytest.mark.parametrize("filled", [1, 300])
def test_ids_are_whole_however_few_are_held_at_once(spark, monkeypatch, filled):
    """Nor do they depend on a filter that takes a rare word for a common one."""
    monkeypatch.setattr(bpe, "FILLED", filled)
    monkeypatch.setattr(bpe, "CACHED", 50)
    monkeypatch.setattr(bpe, "member", lambda hashes, n: lambda w: F.pmod(F.xxhash64(w), F.lit(2)) == 0)
    docs = documents(spark).limit(40).select("doc_id", "text").unionByName(hard(spark).select("doc_id", "text").filter("doc_id not in (7, 8, 11) or doc_id is null"))
    got = bpe.Tokenizer(spark).encode(docs).collect()
    assert len(got) == docs.count() and all(r.ids == LIBRARY.encode_ordinary(r.text or "") for r in got)
    only = bpe.Tokenizer(spark).digests(docs.select("text"))
    assert sorted(r.n_tokens for r in only.collect()) == sorted(len(r.ids) for r in got)


def test_long_words_merge_as_the_library_merges_them(spark):
    words = ["ab" * 2500, "x" * 300, "".join(chr(97 + i * i % 23) for i in range(1_000_000)), "é" * 3000, "z" * 256, "q" * 257]
    docs = spark.createDataFrame([(i, f"one {w} two {w[:50]}") for i, w in enumerate(words)], "doc_id bigint, text string")
    assert all(r.ids == LIBRARY.encode_ordinary(r.text) for r in bpe.Tokenizer(spark).encode(docs).collect())
    rank = bpe.ranks(bpe.RANKS)
    assert all(bpe.merge_long(w.encode(), rank) == LIBRARY.encode_ordinary(w) for w in words)


def test_fold_of_arbitrary_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aabbetno eß'1 ") for _ in range(rng.randrange(1, 40))).strip() or "a" for _ in range(3000)]
    t = bpe.Tokenizer(spark)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    single = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=bpe.ranks(bpe.RANKS), special_tokens={})
    got = df.select("w", bpe._fold(F.col("w"), t.merges).alias("ids")).collect()
    assert all(r.ids == single.encode_ordinary(r.w) == bpe.merge_long(r.w.encode(), bpe.ranks(bpe.RANKS)) for r in got)


def test_later_letters_are_letters(spark):
    """Letters and numbers that Java doesn't know are cut as the library cuts them."""
    text = "a\U00010570\U00031350b c\u1c89 1\U00010d40\u0660 \U0001fae0\u2c2fx \U0001e5f1"
    got = bpe.Tokenizer(spark).encode(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got.ids == LIBRARY.encode_ordinary(text)
    cut = spark.createDataFrame([(text,)], "text string").select(bpe.words_of(F.col("text"), public_tokenizers.PATTERN).alias("w")).first().w
    assert cut == regex.findall(public_tokenizers.PATTERN, text)


def test_columns_stay_and_empty_tables(spark):
    docs = hard(spark)
    assert bpe.Tokenizer(spark).encode(docs).columns == [*docs.columns, "ids"]
    assert bpe.digests(hard(spark, empty=True)).count() == 0
    assert token_counts.counted(hard(spark, empty=True)).count() == 0


def brute_cut(word, score, longest):
    """The likeliest cut of a word, of equal ones with the fewest tokens, of those with the earliest last token."""
    best = [(0.0, 0, [])]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + score[word[s:end]], -(best[s][1] + 1), -s) for s in range(max(0, end - longest), end) if word[s:end] in score]
        top, n, s = max(options)
        best.append((top, -n, [*best[-s][2], word[-s:end]]))
    return best[-1][2]


def brute_model(texts, rounds):
    score, longest = token_counts.vocabulary(token_counts.VOCABULARY)
    words = Counter(w.encode() for t in texts for w in regex.findall(public_tokenizers.PATTERN, t))
    for _ in range(rounds):
        n = Counter()
        for w, k in words.items():
            for t in brute_cut(w, score, longest):
                n[t] += k
        score = {t: log((n[t] + 1) / (n.total() + len(score))) for t in score}
    return score, longest


@pytest.mark.parametrize("sent", [token_counts.SENT, 20])
def test_token_counts_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(token_counts, "SENT", sent)
    find = regex.compile(public_tokenizers.PATTERN).findall
    docs = documents(spark).limit(30).select("doc_id", "text").unionByName(hard(spark).select("doc_id", "text").withColumn("text", F.when(F.col("doc_id") == 11, F.repeat(F.lit("ab"), 400)).otherwise(F.col("text"))))
    rows = docs.collect()
    score, longest = brute_model([r.text or "" for r in rows], token_counts.ROUNDS)
    cut = {w: len(brute_cut(w.encode(), score, longest)) for r in rows for w in find(r.text or "")}
    want = sorted((str(r.doc_id), len(find(r.text or "")), sum(cut[w] for w in find(r.text or "")), len((r.text or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens, r.n_bytes) for r in token_counts.counted(docs).collect()) == want


def test_a_very_long_pretoken_is_cut_whole(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(50_000))
    (r,) = token_counts.counted(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert (r.n_pretokens, r.n_bytes) == (1, 50_000) and 50_000 / 128 <= r.n_tokens <= 50_000


def test_learned_probabilities_sum_to_one_and_follow_the_counts(spark):
    words = spark.createDataFrame([(" the", 900), (" q", 1)], "w string, n bigint")
    p = np.exp(token_counts.learned(words))
    tokens = token_counts.tokens_of(token_counts.VOCABULARY)
    assert abs(p.sum() - 1) < 1e-9 and tokens[int(p.argmax())] == b" the"


def test_probabilities_sum_to_one():
    from math import exp

    assert abs(sum(exp(s) for s in token_counts.vocabulary(token_counts.VOCABULARY)[0].values()) - 1) < 1e-9
