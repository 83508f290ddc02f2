"""Token counts under a unigram model, by dynamic programming that shares the prefixes of a trie.

The tokens are those of a public vocabulary file; their probabilities are learned here, from the counts of all distinct
pre-tokens of all documents. They begin as a Zipf law over the ranks; in each of a few rounds every distinct pre-token is
cut into its likeliest tokens, these are counted as often as the pre-token occurs, and (count + 1) / (all + tokens) is the
new probability. A text is cut into pre-tokens, and a pre-token into the tokens whose log-probabilities have the largest
sum; of equal sums, into the fewest tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from math import log
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.bpe import AT_ONCE, sliced, words_of
from tierloom.llm.common import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Rounds of counting from which the probabilities come.
ROUNDS = 2
#: Pre-tokens, the commonest, whose counts every task has; the others are counted where they occur. This bounds a broadcast and changes no result.
SENT = 1 << 19


@cache
def tokens_of(path: str) -> list[bytes]:
    """The tokens by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return sorted(ranks, key=ranks.get)


def vocabulary(path: str) -> tuple[dict[bytes, float], int]:
    """The log-probabilities that the tokens begin with, and the longest token's length."""
    tokens = tokens_of(path)
    log_z = log(sum(1 / (r + 2) for r in range(len(tokens))))
    return {t: -log(r + 2) - log_z for r, t in enumerate(tokens)}, max(map(len, tokens))


def walk(words: list[bytes], score: dict[bytes, float], longest: int) -> Iterator[tuple[list[int], list[int]]]:
    """For each of the sorted, distinct ``words``: by prefix, the tokens of its best cut, and where the last of them begins.

    The words in order are a depth-first walk through their trie: what a word shares with the one before it are the nodes
    from the root that stay, with their forward scores; only the nodes below are computed, once each. A node's score
    is that of the best cut of its prefix; where a word ends, the node's number of tokens is the word's. The two lists are the
    walk's own, and change with the next word.
    """
    best, n, back, last = [0.0], [0], [0], b""
    get = score.get
    for word in words:
        shared, least = 0, min(len(last), len(word))
        while shared < least and last[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], n[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, fewest, at = float("-inf"), 0, 0
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    s += best[start]
                    if s > top or (s == top and n[start] < fewest):
                        top, fewest, at = s, n[start], start
            best.append(top)
            n.append(fewest + 1)
            back.append(at)
        yield n, back
        last = word


def terminal_counts(words: list[bytes], score: dict[bytes, float], longest: int) -> list[int]:
    """Tokens of the best cut of each of the sorted, distinct ``words``."""
    return [n[len(w)] for w, (n, _) in zip(words, walk(words, score, longest), strict=True)]


def _sorted_bytes(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    binary = words.cast(pa.binary())
    order = pc.sort_indices(binary)
    return order.to_numpy(), binary.take(order).to_pylist()


def learned(words: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> np.ndarray:
    """The log-probabilities of the tokens, by rank, from all distinct pre-tokens: w and n (how often they occur).

    What a task sends is one row a token that it has met; the driver gets one a token.
    """
    tokens, (first, longest) = tokens_of(path), vocabulary(path)
    values = np.array([first[t] for t in tokens])
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(values)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            score, number = dict(zip(tokens_of(path), sent.value.tolist(), strict=True)), {t: i for i, t in enumerate(tokens_of(path))}
            total = np.zeros(len(number), np.int64)
            for b in batches:
                order, some = _sorted_bytes(b.column(0))
                times = b.column(1).to_numpy()[order]
                for w, k, (_, back) in zip(some, times.tolist(), walk(some, score, longest), strict=True):
                    end = len(w)
                    while end:
                        total[number[w[back[end] : end]]] += k
                        end = back[end]
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["token", "n"])

        got = words.select("w", "n").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(tokens))
        counts[got["token"].to_numpy()] = got["n"].to_numpy()
        values = np.log((counts + 1) / (counts.sum() + len(tokens)))
    return values


def counted(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_pretokens, n_tokens, n_bytes of the whole text.

    A null or empty text has none of either. All single bytes are tokens, so every text can be cut, and very long texts and pre-tokens are cut
    whole. Repeated rows are counted each, and learned from each; a null doc_id stays null; an empty table gives no rows; other columns
    are not looked at, whatever their names.

    Distinct pre-tokens with their numbers are all that is shuffled. The commonest come back to every task, with their counts; the
    others of a batch form a trie of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(F.explode(words_of(text, pattern)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = written(words.sortWithinPartitions("w"), "pretokens")
    values = learned(words, path, rounds)
    longest = max(map(len, tokens_of(path)))
    spark = docs.sparkSession
    model, key = spark.sparkContext.broadcast(values), uuid4().hex

    def counts(some: pa.Array) -> np.ndarray:
        score = _scores(path, key, model.value)
        order, ordered = _sorted_bytes(some)
        out = np.zeros(len(some), np.int64)
        out[order] = terminal_counts(ordered, score, longest)
        return out

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts(b.column(0)))], ["w", "tokens"])

    graded = words.withColumn("class", F.floor(F.log2("n") * 16))
    held, least = 0, None
    for c in graded.groupBy("class").agg(F.count("*").alias("k")).orderBy(F.desc("class")).collect():
        held += c["k"]
        if held > SENT:
            break
        least = c["class"]
    common = graded.filter(F.col("class") >= least) if least is not None else graded.limit(0)
    got = common.select("w").mapInArrow(ends, "w string, tokens bigint").toArrow()
    known = spark.sparkContext.broadcast((got["w"].combine_chunks(), got["tokens"].to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, tokens = known.value
        if isinstance(common, pa.ChunkedArray):
            common = pa.concat_arrays(common.chunks) if common.num_chunks else pa.array([], pa.string())
        for b in (s for whole in batches for s in sliced(whole, whole.column(2).offsets.to_numpy(), AT_ONCE)):
            offsets = b.column(2).offsets.to_numpy().astype(np.int64)
            flat = b.column(2).values.slice(offsets[0], offsets[-1] - offsets[0])
            at = pc.index_in(flat, value_set=common)
            rare = at.is_null().to_numpy(zero_copy_only=False)
            n = np.zeros(len(flat), np.int64)
            n[~rare] = tokens[at.filter(pa.array(~rare)).to_numpy()]
            others = flat.filter(pa.array(rare)).dictionary_encode()
            if len(others):
                n[rare] = counts(others.dictionary)[others.indices.to_numpy()]
            sums = np.concatenate(([0], np.cumsum(n)))
            starts = offsets - offsets[0]
            cols = [b.column(0), pa.array(np.diff(starts)), pa.array(sums[starts[1:]] - sums[starts[:-1]]), b.column(1)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pretokens", "n_tokens", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), words_of(text, pattern).alias("words"))
    return rows.mapInArrow(count, "doc_id bigint, n_pretokens bigint, n_tokens bigint, n_bytes bigint")


_last: dict[tuple[str, str], dict[bytes, float]] = {}


def _scores(path: str, number: str, values: np.ndarray) -> dict[bytes, float]:
    """The tokens' scores, kept by a worker for the last model it was sent."""
    if (path, number) not in _last:
        _last.clear()
        _last[path, number] = dict(zip(tokens_of(path), values.tolist(), strict=True))
    return _last[path, number]
