"""SimHash near-dedup by the generalised pigeonhole principle.

Two fingerprints that differ in at most t bits, cut into m disjoint parts, differ in at most T_i bits of some part i,
for any thresholds T_i >= -1 with a sum of t - m + 1. So a fingerprint finds all its partners if it looks up, in every
part, the values within T_i bits of its own. Bits that go together are put into one part, so that the parts differ in
how crowded their values are; and every fingerprint has thresholds of its own, those whose estimated candidates
(from counts of the parts' values over the whole corpus) are fewest, found by dynamic programming over the parts.
A part with threshold -1 isn't looked up at all, which is how fingerprints keep out of crowded values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import components, fresh, join_groups, written

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Bits of a part whose values are counted; a wider part's further bits are taken as even.
COUNTED = 16
#: What a lookup costs, in candidates.
LOOKUP = 4.0
#: Fingerprints in one value of a part above which the value is split over several keys.
CROWD = 8192


def fingerprint(text: bytes) -> int:
    """The 64 bits of a text: a bit is 1 if it is set in over half the XXH64 values of its 4-word shingles."""
    words = text.lower().split()  # of bytes: lowers A-Z and splits at \x20\x09-\x0D, no others
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    whole, k = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = ends[-1:] if len(words) < SHINGLE else ends[SHINGLE - 1 :]
    starts = starts[:k].tolist()
    ends = ends.tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, k, 1 << 18):
        h = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[i : i + (1 << 18)], ends[i : i + (1 << 18)], strict=True)), np.uint64)
        bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > k, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(2).cast(pa.large_binary())
        fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in text], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["uid", "doc_id", "fp"])


def fingerprints(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """uid, doc_id, fp (64 bits as a signed integer) of every document; a null or empty text, or one of white space, has 0."""
    rows = docs.select((F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprints, "uid bigint, doc_id bigint, fp bigint")


def _parts(nodes: DataFrame, n: int, m: int) -> list[list[int]]:
    """The 64 bits in m parts, correlated bits together: a part starts with the most correlated bit that is left, and takes those most correlated with it."""

    def products(batches):
        total = np.zeros((65, 64), np.int64)
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total[:64] += np.rint(x.T @ x).astype(np.int64)
            total[64] += x.sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 64, dtype=np.int32)), pa.array(total.ravel())], ["at", "n"])

    sums = nodes.select("fp").mapInArrow(products, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(65 * 64)
    for r in sums:
        total[r["at"]] = r["n"]
    both, one = total.reshape(65, 64)[:64] / n, total.reshape(65, 64)[64] / n
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    r = np.abs((both - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    left, parts = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        free = sorted(left)
        part = [max(free, key=lambda b, f=tuple(free): r[b, list(f)].sum())]
        left.discard(part[0])
        while len(part) < width:
            part.append(max(sorted(left), key=lambda b, p=tuple(part): r[b, list(p)].sum()))
            left.discard(part[-1])
        parts.append(part)
    return parts


def _values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The counted bits of a part, as a number."""
    return reduce(lambda v, kb: v | ((fp >> np.uint64(kb[1])) & np.uint64(1)) << np.uint64(kb[0]), enumerate(part[:COUNTED]), np.zeros(len(fp), np.uint64)).astype(np.int64)


def _counts(nodes: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value of each part: at most 2**COUNTED numbers a part, over all fingerprints."""

    def count(batches):
        total = np.zeros((len(parts), 1 << COUNTED), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, part in enumerate(parts):
                total[i] += np.bincount(_values(fp, part), minlength=1 << COUNTED)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    got = nodes.select("fp").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(parts) << COUNTED, np.int64)
    counts[got["at"].to_numpy()] = got["n"].to_numpy()
    return counts.reshape(len(parts), -1)


def _estimates(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """[e, value]: fingerprints estimated within e = 0..most bits of the value, in this part."""
    s = min(width, COUNTED)
    layers = [counts[: 1 << s].astype(np.float64)] + [np.zeros(1 << s) for _ in range(most)]
    at = np.arange(1 << s)
    for b in range(s):
        layers = [x if k == 0 else x + layers[k - 1][at ^ (1 << b)] for k, x in enumerate(layers)]
    rest = width - s
    share = np.cumsum([comb(rest, j) / 2.0**rest for j in range(most + 1)])
    return np.array([sum(layers[k] * share[e - k] for k in range(e + 1)) for e in range(most + 1)], np.float32)


def thresholds(costs: list[np.ndarray], total: int) -> np.ndarray:
    """[part, fingerprint]: the thresholds, of sum ``total``, whose costs ([e + 1, fingerprint] a part, e from -1) are least."""
    n, m, top = costs[0].shape[1], len(costs), len(costs[0]) - 2
    best: dict[int, np.ndarray] = {0: np.zeros(n, np.float32)}
    chose: list[dict[int, np.ndarray]] = []
    for i, cost in enumerate(costs):
        new: dict[int, np.ndarray] = {}
        how: dict[int, np.ndarray] = {}
        for s, c in best.items():
            for e in range(-1, top + 1):
                t = s + e
                if not total - top * (m - i - 1) <= t <= total + (m - i - 1):
                    continue
                x = c + cost[e + 1]
                if t not in new:
                    new[t], how[t] = x, np.full(n, e, np.int8)
                else:
                    less = x < new[t]
                    new[t] = np.where(less, x, new[t])
                    how[t] = np.where(less, np.int8(e), how[t])
        best = new
        chose.append(how)
    out, at = np.zeros((m, n), np.int8), np.full(n, total)
    for i in range(m - 1, -1, -1):
        for t, e in chose[i].items():
            out[i] = np.where(at == t, e, out[i])
        at = at - out[i]
    return out


def _how_many_parts(n: int, most_bits: int) -> int:
    """Parts with the least lookups and candidates, were values even."""

    def cost(m: int) -> float:
        t = [(most_bits - m + 1) // m + (i < (most_bits - m + 1) % m) for i in range(m)]
        probes = [sum(comb(64 // m, j) for j in range(e + 1)) for e in t]
        return sum(p * (LOOKUP + n / 2.0 ** (64 // m)) for p in probes)

    return min(range(2, most_bits + 2), key=cost)


def links(nodes: DataFrame, most_bits: int = MOST_BITS, m: int | None = None) -> DataFrame:
    """All pairs, both ways, of different fingerprints at ``most_bits`` or fewer differing bits: fp, other, n (of the other).

    ``nodes``: fp (distinct) and n. Each fingerprint is listed once a part, and looks up its own values; a pair is
    taken only at the first part that finds it, so none comes twice. Values that many fingerprints share are split
    over several keys, at all of which one looks.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], "fp bigint, other bigint, n bigint")
    m = m or _how_many_parts(n, most_bits)
    parts = _parts(nodes, n, m)
    masks = np.array([sum(1 << b for b in p) for p in parts], np.uint64)
    counts = _counts(nodes, parts)
    top = most_bits
    near = [_estimates(counts[i], len(p), top) for i, p in enumerate(parts)]
    flips = [[np.array([sum(1 << b for b in c) for c in combinations(p, e)], np.uint64) for e in range(top + 1)] for p in parts]
    tried = [np.cumsum([len(x) for x in f]) for f in flips]
    total = most_bits - m + 1

    def crowds(fp: np.ndarray, i: int) -> np.ndarray:
        return 1 + (near[i][0][_values(fp, parts[i])] / CROWD).astype(np.int64)

    def listed(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(m):
                salt = ((fp ^ fp >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % crowds(fp, i)
                yield _rows(i, fp & masks[i], salt, fp, b.column(1).to_numpy(zero_copy_only=False))

    def looked(batches):
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                costs = []
                for i in range(m):
                    v = _values(fp, parts[i])
                    costs.append(np.concatenate([np.zeros((1, len(fp)), np.float32), near[i][:, v] + LOOKUP * tried[i][:, None].astype(np.float32)]))
                t = thresholds(costs, total)
                packed = reduce(lambda a, i: a | (t[i].astype(np.int64) + 1) << (4 * i), range(m), np.zeros(len(fp), np.int64))
                for i in range(m):
                    for e in range(top + 1):
                        if not (own := t[i] >= e).any():
                            continue
                        key = ((fp[own] & masks[i])[:, None] ^ flips[i][e][None, :]).ravel()
                        src, how = np.repeat(fp[own], len(flips[i][e])), np.repeat(packed[own], len(flips[i][e]))
                        split = crowds(key, i)
                        if (split > 1).any():
                            key, src, how = (np.repeat(x, split) for x in (key, src, how))
                            first = np.cumsum(split) - split
                            salt = np.arange(len(key)) - np.repeat(first, split)
                        else:
                            salt = np.zeros(len(key), np.int64)
                        yield _rows(i, key, salt, src, how)

    schema = "part int, key bigint, salt bigint, {} bigint, {} bigint"
    index = nodes.select("fp", "n").mapInArrow(listed, schema.format("other", "n"))
    probes = nodes.select("fp").mapInArrow(looked, schema.format("fp", "how"))
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    sooner = F.lit(False)
    for i in range(m - 1):
        limit = F.shiftright("how", 4 * i).bitwiseAND(15) - 1
        sooner = sooner | ((F.col("part") > i) & (F.bit_count(differ.bitwiseAND(F.lit(int(masks[i].view(np.int64))))) <= limit))
    found = probes.join(index, ["part", "key", "salt"]).filter((F.bit_count(differ) <= most_bits) & (F.col("fp") != F.col("other")) & ~sooner)
    return found.select("fp", "other", "n")


def _rows(i: int, key: np.ndarray, salt: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)), pa.array(salt), pa.array(a.view(np.int64)), pa.array(b)]
    return pa.RecordBatch.from_arrays(cols, ["part", "key", "salt", "a", "b"])


def near_groups(docs: DataFrame, most_bits: int = MOST_BITS, uid: str | None = None) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), n_near (other rows at ``most_bits`` or fewer differing bits),
    component_id (smallest doc_id reachable over links), kept (one row a component: smallest doc_id, then first), uid.

    Rows with the same fingerprint are one node and are linked to one another without being paired; so repeated rows and all
    empty texts (fingerprint zero, null texts too) are linked, and zero is linked to other fingerprints like any. A
    row with a null doc_id counts as any other, and names its component only if there is no doc_id in it. An empty
    table gives no rows. Other columns are not looked at; ``uid`` names a column that numbers the rows, if there is one.
    """
    fps = written(fingerprints(docs, uid), "fingerprints")
    n = fps.count()
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    nodes = written(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min(who).alias("who")), "nodes")
    pairs = written(links(nodes.select("fp", "n"), most_bits), "links")
    near = pairs.groupBy("fp").agg(F.sum("n").alias("others"))
    roots = components(pairs.filter("fp > other").select("fp", "other"), "fp", "other")
    nodes = nodes.join(near, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = written(nodes, "rooted")
    # only components of several fingerprints need to be brought together
    alone = F.col("others").isNull()
    first = nodes.filter(~alone).groupBy("root").agg(F.min("who").alias("first"))
    nodes = nodes.filter(alone).withColumn("first", F.col("who")).unionByName(nodes.filter(~alone).join(first, "root").select(*nodes.columns, "first"))
    nodes = nodes.select("fp", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "first")
    rows = join_groups(fps, written(nodes, "near"), ["fp"], "n", n)
    return rows.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "n_near",
        F.col("first.doc_id").alias("component_id"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        "uid",
    )


def drop_near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One document of each component, with all its columns. The documents are written with a row number first."""
    (row,) = fresh(docs, "_uid")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    kept = near_groups(docs, most_bits, row).filter("kept").select(F.col("uid").alias(row))
    return docs.join(kept, row, "left_semi").drop(row)
