"""LM scoring by context-tree weighting over bytes.

A text is its words (lower-cased), each with a space after it, and an end mark; so texts and token sequences are one to
one. A byte is eight binary decisions, each with a context tree of its own over the bytes of the same word before it, up
to DEPTH; before a word's start the context is the text's class, again and again. A text's class is the one of a few
commonest short words that it has most of, and is sent ahead of the text, at the cost of one even choice; so the trees
tell languages and styles apart where that pays. A node of a tree counts zeros and ones over all training
tokens; its Krichevsky-Trofimov estimate and the product of its children's weighted probabilities are mixed half and
half, at all depths from the leaves to the root. A prediction mixes the estimates along the context by the weights that
the counts have given them; contexts that training hasn't seen have no node, and the path ends above them.

Counts are gathered by distinct word, so that what moves is words, not texts. The trees are cut at the second byte of
the context: each task has whole subtrees, and the two levels above, of at most 256 * 256 nodes, are joined by the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import join_groups, written

#: Bytes of context; with the byte itself they fill 64 bits.
DEPTH = 7
#: The depth of the subtrees' roots.
CUT = 2
END = b"\n"
#: Bytes that no word has: one a class, the first for texts without any of the short words.
CLASSES = bytes([0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA, 0xFB, 0xFC, 0xFD, 0xFE, 0xFF, 0xC0, 0xC1, 9, 10, 11, 12, 13])
#: Bytes of the longest word that can name a class.
SHORT = 6
#: Words, the commonest, whose scores every task has; the others are joined. This bounds a broadcast and changes no result.
SENT = 150_000
_HALF = float(np.log(0.5))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0, by Stirling's series eight further on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


#: log gamma of a half more than whole numbers (less half of log pi), and of one more.
_HALVES, _WHOLE = lgamma(np.arange(1 << 14) + 0.5) - 1.1447298858494002 / 2, lgamma(np.arange(1 << 14) + 1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov estimate of a zeros and b ones; the a's and b's are whole numbers."""
    few = a + b < len(_WHOLE)
    out = np.empty(len(a)) if a.ndim == 1 else None
    if out is None or not few.any():
        return _log_kt(a, b)
    x, y = a[few].astype(np.int64), b[few].astype(np.int64)
    out[few] = _HALVES[x] + _HALVES[y] - _WHOLE[x + y]
    if not few.all():
        out[~few] = _log_kt(a[~few], b[~few])
    return out


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - 1.1447298858494002


def positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words and their ends: the context (nearest byte first) and the byte, in 64 bits; and the word's number.

    A word here begins with its class's byte, which is context and isn't predicted.
    """
    data = [w if w[1:] == END else w + b" " for w in words]
    size = np.fromiter(map(len, data), np.int64, len(data))
    text = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    start = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(text))
    key = text.copy()
    for j in range(1, DEPTH + 1):
        key |= text[np.maximum(at - j, start)] << np.uint64(8 * (DEPTH + 1 - j))
    own = at != start
    return key[own], np.repeat(np.arange(len(words)), size)[own]


def _summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums by key: keys in order, and the sums of each of ``values``."""
    if not len(key):
        return [key, *values]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return [key[first], *(np.add.reduceat(v[order], first) for v in values)]


def _at_depth(key: np.ndarray, d: int) -> np.ndarray:
    """Nodes' keys (context, then the binary node in the last byte) with the context cut to its nearest d bytes."""
    return key & np.uint64((~((1 << 8 * (DEPTH + 1 - d)) - 1) & (1 << 64) - 1) | 0xFF)


def _decisions(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th decision of each byte: its node's key and whether it is a one."""
    byte = key & np.uint64(0xFF)
    node = np.uint64(1 << k) | byte >> np.uint64(8 - k)
    return key & np.uint64(0xFFFFFFFFFFFFFF00) | node, (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)


def subtrees(key: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """By depth, from DEPTH to CUT: keys, zeros, ones, log weighted probability and weight of the own estimate."""
    seen = n > 0
    key, n = key[seen], n[seen].astype(float)
    parts = [(*_decisions(key, k), n) for k in range(8)]
    node, one, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    node, a, b = _summed(node, np.where(one, 0.0, n), np.where(one, n, 0.0))
    log_w = log_kt(a, b)
    out = {DEPTH: (node, a, b, log_w, np.ones(len(node)))}
    for d in range(DEPTH - 1, CUT - 1, -1):
        node, a, b, below = _summed(_at_depth(node, d), a, b, log_w)
        log_w, w = weighted(a, b, below)
        out[d] = (node, a, b, log_w, w)
    return out


def weighted(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = _HALF + log_kt(a, b)
    log_w = np.logaddexp(own, _HALF + below)
    return log_w, np.exp(own - log_w)


class Top:
    """The levels above the cut, for every node there is: what a path that ends there predicts for a zero, and what goes on below."""

    def __init__(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, log_w: np.ndarray):
        """The sums over the roots of the subtrees, by their context's nearest byte and node."""
        near, node = (key >> np.uint64(56)).astype(int), (key & np.uint64(0xFF)).astype(int)
        n1, z1, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        np.add.at(z1, (near, node), a)
        np.add.at(n1, (near, node), a + b)
        np.add.at(below, (near, node), log_w)
        log_1, w1 = weighted(z1, n1 - z1, below)
        log_1[n1 == 0] = 0
        n0, z0 = n1.sum(axis=0), z1.sum(axis=0)
        _, w0 = weighted(z0, n0 - z0, log_1.sum(axis=0))
        p0, p1 = (z0 + 0.5) / (n0 + 1), (z1 + 0.5) / (n1 + 1)
        rest = 1 - w0
        self.ends = np.where(n1 > 0, w0 * p0 + rest * p1, p0)  # of a path that ends at depth 1, or at the root
        self.sum, self.rest = w0 * p0 + rest * w1 * p1, rest * (1 - w1)


def log10_bytes(key: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 of each byte's probability in its context; ``key`` has whole subtrees, ``n`` their training counts (0: only to be scored)."""
    trees = subtrees(key, n)
    ends: dict[int, np.ndarray] = {}
    sums = rest = None
    for d in range(CUT, DEPTH + 1):
        node, a, b, _, w = trees[d]
        if d == CUT:
            near, i = (node >> np.uint64(56)).astype(int), (node & np.uint64(0xFF)).astype(int)
            before, left = top.sum[near, i], top.rest[near, i]
        else:
            up = np.searchsorted(trees[d - 1][0], _at_depth(node, d - 1))
            before, left = sums[up], rest[up]
        p = (a + 0.5) / (a + b + 1)
        ends[d] = before + left * p
        sums, rest = before + left * w * p, left * (1 - w)
    total = np.zeros(len(key))
    for k in range(8):
        node, one = _decisions(key, k)
        p = top.ends[(node >> np.uint64(56)).astype(int), (node & np.uint64(0xFF)).astype(int)].copy()
        open_ = np.arange(len(node))
        for d in range(DEPTH, CUT - 1, -1):
            if not len(open_) or not len(trees[d][0]):
                continue
            cut = _at_depth(node[open_], d)
            at = np.minimum(np.searchsorted(trees[d][0], cut), len(trees[d][0]) - 1)
            there = trees[d][0][at] == cut
            p[open_[there]] = ends[d][at[there]]
            open_ = open_[~there]
        total += np.log10(np.where(one, 1 - p, p))
    return total


def _whole_roots(batches: Iterator[pa.RecordBatch], least: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (k, n) rows in pieces that hold whole subtrees."""
    keys, counts, held = [], [], 0
    for b in batches:
        k = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(k):
            continue
        keys.append(k)
        counts.append(b.column(1).to_numpy(zero_copy_only=False))
        held += len(k)
        if held >= least:
            k, n = np.concatenate(keys), np.concatenate(counts)
            cut = int(np.searchsorted(k >> np.uint64(48), k[-1] >> np.uint64(48)))
            if cut:
                yield k[:cut], n[:cut]
            keys, counts, held = [k[cut:]], [n[cut:]], len(k) - cut
    if held:
        yield np.concatenate(keys), np.concatenate(counts)


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]  # of bytes: lowers A-Z and splits at \x20\x09-\x0D, no others


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.large_binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def class_words(docs: DataFrame) -> list[bytes]:
    """The commonest training words of at most SHORT bytes, one for each class but the first. docs: held_out and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Counter[bytes] = Counter()
        for b in batches:
            for out, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                if not out:
                    here.update(w for w in text.lower().split() if len(w) <= SHORT)
            if len(here) > 100_000:
                yield _batch("word c", pa.array(list(here), pa.binary()), pa.array(list(here.values()), pa.int64()))
                here.clear()
        yield _batch("word c", pa.array(list(here), pa.binary()), pa.array(list(here.values()), pa.int64()))

    words = docs.select("held_out", "text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    return [bytes(r["word"]) for r in words.orderBy(F.desc("c"), "word").limit(len(CLASSES) - 1).collect()]


def classed(text: bytes, names: list[bytes]) -> tuple[bytes, Counter[bytes]]:
    """The text's class, by the first of the words that it has most of; and its tokens, counted."""
    here = Counter(tokens(text))
    most = max((here.get(w, 0) for w in names), default=0)
    z = 1 + next(i for i, w in enumerate(names) if here.get(w, 0) == most) if most else 0
    return CLASSES[z : z + 1], here


def word_counts(docs: DataFrame, names: list[bytes]) -> DataFrame:
    """word (after its text's class) and c, its training tokens (0: only held-out texts have it). docs: held_out and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                by: dict[bytes, Counter[bytes]] = {}
                for out, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                    z, own = classed(text, names)
                    here = by.setdefault(z, Counter())
                    here.update(dict.fromkeys(own, 0) if out else own)
                rows = [(z + w, k) for z, here in by.items() for w, k in here.items()]
                yield _batch("word c", pa.array([w for w, _ in rows], pa.binary()), pa.array([k for _, k in rows], pa.int64()))

    return docs.select("held_out", "text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def byte_scores(words: DataFrame) -> DataFrame:
    """k (context and byte), lp (log10 of the byte's probability in the context), n (words that have it), for all bytes of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, word = positions(b.column(0).to_pylist())
            k, n, c = _summed(key, np.ones(len(key), np.int64), b.column(1).to_numpy(zero_copy_only=False)[word])
            yield _batch("k c n", k.view(np.int64), c, n)

    def order(pairs: DataFrame) -> DataFrame:
        root = F.shiftrightunsigned("k", 48)
        return pairs.repartition(root).sortWithinPartitions(root, F.shiftrightunsigned("k", 1), "k")

    pairs = words.select("word", "c").mapInArrow(count, "k bigint, c bigint, n bigint").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    pairs = written(pairs, "bytes")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _whole_roots(batches):
            node, a, b, log_w, _ = subtrees(key, n)[CUT]
            at, a, b, log_w = _summed(_at_depth(node, 1), a, b, log_w)
            yield _batch("at a b w", at.view(np.int64), a, b, log_w)

    got = order(pairs).mapInArrow(lambda x: roots(x), "at bigint, a double, b double, w double").groupBy("at").agg(*(F.sum(c).alias(c) for c in "abw")).toArrow()
    top = Top(got["at"].to_numpy().view(np.uint64), *(got[c].to_numpy() for c in "abw"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _whole_roots(batches):
            yield _batch("k lp", key.view(np.int64), log10_bytes(key, n, top))

    return order(pairs.select("k", "c")).mapInArrow(score, "k bigint, lp double").join(pairs.select("k", "n"), "k")


def scored(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score is the log10 probability of the whole text under the model, base_score that under the add-one unigram; bits_per_byte is
    score as a code length, per byte of the words and their ends. A null or empty text is its end mark alone. Texts are
    learned from unless held out; a document without doc_id isn't held out. Repeated rows count, and are scored, each. With
    nothing to learn from, every decision has probability one half. An empty table gives no rows.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    names = class_words(rows)
    words = written(word_counts(rows, names).withColumn("id", F.monotonically_increasing_id()), "words")
    plain = F.expr("substring(word, 2)")
    counts = words.groupBy(plain.alias("plain")).agg(F.sum("c").alias("all"))
    counts = written(counts, "counts")
    n, v = counts.agg(F.coalesce(F.sum("all"), F.lit(0)), F.count_if(F.col("all") > 0)).first()
    of_bytes = written(byte_scores(words), "scores")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, word = positions(b.column(0).to_pylist())
            yield _batch("id k", b.column(1).to_numpy(zero_copy_only=False)[word], key.view(np.int64))

    spelled = words.select("word", "id").mapInArrow(spell, "id bigint, k bigint")
    total = of_bytes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of_words = join_groups(spelled, of_bytes, ["k"], "n", total).groupBy("id").agg(F.sum("lp").alias("lp"))
    base = F.log10((F.col("all") + 1) / F.lit(float(n + v + 1)))
    words = words.join(of_words, "id").withColumn("plain", plain).join(counts, "plain")
    words = words.select("word", (F.col("all") > 0).alias("known"), base.alias("base"), "lp", F.floor(F.log2(F.greatest("c", F.lit(1))) * 16).alias("class"))
    words = written(words, "scored-words")
    held, least = 0, None
    for c in words.groupBy("class").count().orderBy(F.desc("class")).collect():
        held += c["count"]
        if held > SENT:
            break
        least = c["class"]
    often = (F.col("class") >= F.lit(least)) if least is not None else F.lit(False)
    got = words.filter(often).select("word", "known", "base", "lp").toArrow()
    common = dict(zip(got["word"].to_pylist(), zip(*(got[c].to_pylist() for c in ("known", "base", "lp")), strict=True), strict=True))

    class_cost = -float(np.log10(len(names) + 1))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sums, rare, rare_at, rare_n = [], [], [], []
                for i, text in enumerate(_texts(b.column(3))):
                    z, here = classed(text, names)
                    known, base_sum, lp_sum = 0, 0.0, class_cost
                    for w, k in here.items():
                        if (s := common.get(z + w)) is not None:
                            known += k * s[0]
                            base_sum += k * s[1]
                            lp_sum += k * s[2]
                        else:
                            rare.append(z + w)
                            rare_at.append(i)
                            rare_n.append(k)
                    sums.append((here.total(), known, base_sum, lp_sum, sum(k * (len(w) + (w != END)) for w, k in here.items())))
                fields, all_, none = "uid doc_id held_out n_tokens n_known base lp size word", len(sums), len(rare)
                cols = [pa.array(c, t) for c, t in zip(zip(*sums, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
                yield _batch(fields, *b.columns[:3], *cols, pa.nulls(all_, pa.binary()))
                uid = b.column(0).take(pa.array(rare_at, pa.int64()))
                empty = pa.nulls(none, pa.float64())
                yield _batch(fields, uid, pa.nulls(none, pa.int64()), pa.nulls(none, pa.bool_()), pa.array(rare_n, pa.int64()), pa.nulls(none, pa.int64()), empty, empty, pa.nulls(none, pa.int64()), pa.array(rare, pa.binary()))

    kind = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, lp double, size bigint, word binary"
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text")
    looked = written(rows.mapInArrow(look, kind), "looked")
    rest = looked.filter("word is not null").select("uid", "word", F.col("n_tokens").alias("k"))
    rest = rest.join(words.filter(~often).withColumnsRenamed({"base": "b", "lp": "l"}), "word").groupBy("uid").agg(
        F.sum(F.when(F.col("known"), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.col("b")).alias("b"), F.sum(F.col("k") * F.col("l")).alias("l")
    )
    zero = F.lit(0)
    out = looked.filter("word is null").join(rest, "uid", "left")
    score = F.col("lp") + F.coalesce("l", zero)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        score.alias("score"),
        (-score * float(np.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )
