"""Exact duplicate groups and near-duplicate clusters of text bodies (MinHash with banding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierloom.functions.text import normalize
from tierloom.operators.tables import components, written

SLOTS, BANDS, SHINGLE = 128, 8, 5
LEAST = 64
BASE = np.uint64(0x100000001B3)
#: Members of a bucket that are compared at once; larger buckets are split, and every two blocks meet.
BLOCK = 512
#: Texts that are taken from a batch at once, and hashes that are permuted at once, unless one text has more: both fit a core's cache.
TEXTS, HASHES = 256, 1 << 13


def exact_groups(bodies: DataFrame, body: str = "text", key: str = "doc_id") -> DataFrame:
    """sha, copies, first (least key) and saved bytes of each body that occurs at least twice."""
    g = bodies.groupBy(F.sha2(F.col(body), 256).alias("sha")).agg(F.count("*").alias("copies"), F.min(key).alias("first"), F.first(F.octet_length(body)).cast("bigint").alias("size"))
    return g.filter("copies > 1").select("sha", "copies", "first", ((F.col("copies") - 1) * F.col("size")).alias("saved"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: three rounds of shift and multiply."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's windows of SHINGLE bytes; a shorter text has one, of all it has and its length."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        if len(b) < SHINGLE:
            h = np.uint64(len(b) + 1)
            for x in b:
                h = h * BASE + x
            return _mixed(np.array([h], np.uint64))
        h = np.zeros(len(b) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            h = h * BASE + b[i : len(b) - SHINGLE + 1 + i]
        return np.unique(_mixed(h))


def signatures(rows: DataFrame, seed: int = 1337) -> DataFrame:
    """id and signature, SLOTS least values of permuted hashes. rows: id and text."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, SLOTS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    b = rng.integers(0, 2**63, SLOTS, dtype=np.uint64)

    def least(hashes: list[np.ndarray]) -> np.ndarray:
        """[text, slot]: one permutation at a time, over the hashes of some texts."""
        flat, ends = np.concatenate(hashes), np.cumsum([len(h) for h in hashes])
        starts, room, out = ends - [len(h) for h in hashes], np.empty_like(flat), np.empty((SLOTS, len(hashes)), np.uint64)
        for i in range(SLOTS):
            np.multiply(flat, a[i], out=room)
            np.add(room, b[i], out=room)
            np.minimum.reduceat(room, starts, out=out[i])
        return out.T >> np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out, held, n = [], [], 0
                for text in part.column(1).to_pylist():
                    h = shingle_hashes((text or "").encode())
                    if held and n + len(h) > HASHES:
                        out.append(least(held))
                        held, n = [], 0
                    held.append(h)
                    n += len(h)
                out.append(least(held))
                flat = pa.array(np.concatenate(out).astype(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SLOTS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "signature"])

    return rows.select("id", "text").mapInArrow(run, "id bigint, signature array<bigint>")


def _linked(sigs: np.ndarray, band: int, half: np.ndarray, threshold: float) -> np.ndarray:
    """Which members are linked: similar enough, and of all bands on which they agree this one is the first. half: 0 and 1, if
    only members of different halves are compared (those of one half meet elsewhere), else all 0."""
    n, width = len(sigs), SLOTS // BANDS
    link = np.zeros((n, n), bool)
    for i in range(n - 1):
        same = sigs[i + 1 :] == sigs[i]
        ok = same.sum(axis=1) >= threshold * SLOTS
        if half.any():
            ok &= half[i + 1 :] != half[i]
        if band:
            ok &= ~same[:, : band * width].reshape(-1, band, width).all(axis=2).any(axis=1)
        link[i, i + 1 :] = ok
    return link | link.T


def verified_links(signed: DataFrame, threshold: float) -> DataFrame:
    """id, other and links, from every pair of different signatures that agree on a band and are similar enough.

    Each pair is verified in one block. There, a member with links has one row: the number of documents it is linked to in the
    block, and the least id of what is connected there. signed: id, signature, copies (documents that have it).
    """
    width = SLOTS // BANDS
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("signature", i * width + 1, width)).alias("h")) for i in range(BANDS)])
    rows = signed.select("id", "signature", "copies", F.explode(bands).alias("x")).select("id", "signature", "copies", "x.band", "x.h")
    buckets = rows.groupBy("band", "h").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.join(buckets, ["band", "h"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "h", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), (F.col("own") > F.col("met")).cast("int").alias("half"), "id", "copies", "signature")
    rows = rows.repartition("band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j", "id")

    def block(keys: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        """keys: band, h, i, j, half, id and copies in columns."""
        half = keys[:, 4] if keys[0, 2] != keys[0, 3] else np.zeros(len(keys), np.int64)
        link = _linked(sigs, int(keys[0, 0]), half, threshold)
        root = np.full(len(keys), -1)
        for i in range(len(keys)):
            if root[i] >= 0:
                continue
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(link[front].any(axis=0) & (root < 0))
                root[front] = i
        has = link.any(axis=1)
        ids = keys[:, 5]
        return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[root][has]), pa.array((link @ keys[:, 6])[has])], ["id", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks(keys: np.ndarray, sigs: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero((keys[1:, :4] != keys[:-1, :4]).any(axis=1)) + 1
            ends = [*new.tolist(), *([len(keys)] if last else [])]
            at = 0
            for end in ends:
                yield block(keys[at:end], sigs[at:end])
                at = end
            held[:] = [(keys[at:].copy(), sigs[at:].copy())]

        for b in batches:
            if b.num_rows:
                keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(7)], axis=1)
                held.append((keys, b.column(7).flatten().to_numpy().reshape(-1, SLOTS)))
                if (held[0][0][0, :4] != keys[-1, :4]).any() if len(held[0][0]) else True:
                    yield from blocks(*(np.concatenate([x[i] for x in held]) for i in range(2)), False)
        if held and sum(len(k) for k, _ in held):
            yield from blocks(*(np.concatenate([x[i] for x in held]) for i in range(2)), True)

    return rows.mapInArrow(run, "id bigint, other bigint, links bigint")


def near_clusters(bodies: DataFrame, threshold: float = 0.9, body: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, cluster (least key), size and links of all bodies over LEAST characters that are in clusters of at least two.

    Bodies equal after normalization are one node, and nodes with equal signatures one more. Clusters are the connected
    components of all pairs that agree on a band and whose estimated similarity is at least the threshold; links is the number of
    other documents to which one is linked by such a pair.
    """
    rows = bodies.filter(F.char_length(body) > LEAST).select(F.col(key).alias("key"), normalize(F.col(body)).alias("text"))
    rows = written(rows.withColumn("sha", F.sha2("text", 256)), "normal")
    nodes = rows.groupBy("sha").agg(F.min("key").alias("node"), F.first("text").alias("text"), F.count("*").alias("copies"))
    nodes = written(nodes, "nodes")
    signed = signatures(nodes.select(F.col("node").alias("id"), "text")).withColumnRenamed("id", "node")
    signed = written(signed.join(nodes.select("node", "copies"), "node").withColumn("digest", F.sha2(F.array_join("signature", ","), 256)), "signatures")
    distinct = signed.groupBy("digest").agg(F.min("node").alias("id"), F.sum("copies").alias("copies"), F.first("signature").alias("signature"))
    distinct = written(distinct, "distinct")
    members = rows.select("sha", "key").join(nodes.select("sha", "node"), "sha").join(signed.select("node", "digest"), "node")
    members = written(members.join(distinct.select("digest", "id", "copies"), "digest").select("key", "id", "copies"), "members")
    found = written(verified_links(distinct, threshold), "links")
    roots = components(found.select("id", "other").filter("id != other").distinct(), "id", "other").select("id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    out = members.join(roots, "id", "left").join(links, "id", "left")
    out = out.select(F.col("key").alias(key), F.coalesce("root", "id").alias("cluster"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    sizes = out.groupBy("cluster").agg(F.count("*").alias("size")).filter("size > 1")
    return out.join(sizes, "cluster").select(key, "cluster", "size", "links")


def top_clusters(groups: DataFrame, most: int = 5) -> DataFrame:
    """The largest groups, ties to the least first member: a report."""
    return groups.orderBy(F.desc("copies"), "first").limit(most)


def jaccard_nearest(a: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """Each key's number of distinct 5-character shingles, and how many of them other keys have too; no pairs are formed."""
    w = Window.partitionBy("shingle")
    n = F.greatest(F.char_length(text) - 4, F.lit(1))
    parts = a.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(text), i, F.lit(5))))).alias("shingle"))
    counted = parts.withColumn("holders", F.count("*").over(w))
    return counted.groupBy(key).agg(F.count("*").alias("shingles"), F.count_if(F.col("holders") > 1).alias("shared"))
