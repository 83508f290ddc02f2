"""A made-up corpus: lanes of agent conversations merged by time into JSONL shards, and vectors with structure.

A lane is one session, made from its own seed, so that lanes are made where they are written. A small share of lines is
spaced otherwise than canonical ones, or isn't JSON at all.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierloom.operators.tables import ranked, written
from tierloom.plans.recall import sample_embeddings

SHARD, LANE, MALFORMED, SPACED = 48 << 20, 24, 0.02, 0.005
_SLOTS = {
    "file": ("main.py", "api/routes.ts", "lib/cache.rs", "README.md"), "verb": ("fix", "explain", "extend", "test", "profile"), "thing": ("the parser", "a flaky test", "the retry loop", "this query", "the cache"),
    "city": ("Lisbon", "Osaka", "Quito", "Turin"), "place": ("a quiet hotel", "two museums", "a rail pass", "a table for four"), "metric": ("latency", "error rate", "memory", "throughput"), "n": tuple(map(str, range(2, 60))),
}
_PERSONAS = {
    "coder": (("please {verb} {thing} in {file}", "why does {file} fail after {n} runs?"), ("I looked at {file}: {thing} runs {n} times.", "Done. {thing} is covered by {n} tests now.")),
    "traveller": (("find {place} in {city} for {n} days", "how far is {city} from {city}?"), ("There are {n} options for {place} in {city}.", "{city} is {n} hours away; {place} is free.")),
    "operator": (("what happened to {metric} at {n}:00?", "compare {metric} and {metric}"), ("{metric} rose by {n} percent.", "No change in {metric} over {n} hours.")),
}


def fill(template: str, rng: random.Random) -> str:
    """Each {slot} by one of its words."""
    out = template
    while "{" in out:
        name = out[out.index("{") + 1 : out.index("}")]
        out = out.replace("{" + name + "}", rng.choice(_SLOTS[name]), 1)
    return out


def _listing(rng: random.Random) -> str:
    return "\n".join(f"-rw-r--r-- 1 dev {rng.randrange(100, 90000)} {rng.choice(_SLOTS['file'])}" for _ in range(rng.randrange(2, 9)))


def _table(rng: random.Random) -> str:
    return json.dumps({"columns": ["t", "value"], "rows": [[i, round(rng.random() * 100, 2)] for i in range(rng.randrange(2, 12))]})


def _log(rng: random.Random) -> str:
    return "\n".join(f"2024-01-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}:00:00Z {rng.choice(('INFO', 'WARN'))} {fill('{metric} {n}', rng)}" for _ in range(rng.randrange(2, 9)))


def _page(rng: random.Random) -> str:
    return f"<html><body><h1>{rng.choice(_SLOTS['city'])}</h1><p>{fill('{place}, {n} reviews', rng)}</p></body></html>"


def _failure(rng: random.Random) -> str:
    return f"Traceback (most recent call last):\n  File \"{rng.choice(_SLOTS['file'])}\", line {rng.randrange(1, 400)}\nTimeoutError: gave up after {rng.randrange(2, 60)} s"


TOOLS = {"list_files": _listing, "query": _table, "read_log": _log, "fetch": _page, "run": _failure}


def spaced(event: dict) -> bytes:
    """The same event with spaces that canonical lines don't have."""
    return json.dumps(event, separators=(", ", ": "), ensure_ascii=False).encode()


def malformed(line: bytes, rng: random.Random) -> bytes:
    """A line that is no event: cut short, bare text, or bytes that aren't text; without a newline."""
    draw = rng.random()
    if draw < 0.4:
        return line[: max(1, len(line) // 2)]
    return fill("lost {metric} after {n}", rng).encode() if draw < 0.7 else rng.randbytes(24).replace(b"\n", b"\x00")


def lane(number: int, seed: int) -> Iterator[tuple[int, int, bytes]]:
    """ts, seq and line of one session."""
    rng = random.Random(f"{seed}:{number}")
    ask, answer = _PERSONAS[rng.choice(sorted(_PERSONAS))]
    ts = 1_700_000_000_000_000 + rng.randrange(86_400_000_000)
    for seq in range(LANE):
        ts += rng.randrange(1_000, 90_000_000)
        event = {"trace_id": f"lane-{number:08d}", "ts": ts, "role": "user" if seq % 3 == 0 else "assistant" if seq % 3 == 2 else "tool", "type": "tool_result" if seq % 3 == 1 else "message"}
        if seq % 3 == 1:
            event["tool_name"] = rng.choice(sorted(TOOLS))
            event["content"] = TOOLS[event["tool_name"]](rng)
        else:
            event["content"] = fill(rng.choice(ask if seq % 3 == 0 else answer), rng)
        line, draw = json.dumps(event, separators=(",", ":"), ensure_ascii=False).encode(), rng.random()
        yield ts, seq, malformed(line, rng) if draw < MALFORMED else spaced(event) if draw < MALFORMED + SPACED else line


def events(spark: SparkSession, size: int, seed: int = 1337) -> DataFrame:
    """raw and at (the bytes before a line, in order of time, lane and place): lines of at least ``size`` bytes in all, cut where that is reached."""
    mean = sum(len(x) + 1 for i in range(32) for _, _, x in lane(i, seed)) / 32
    lanes = int(size / mean * 1.2) + 2

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = [(ts, i, seq, line) for i in b.column(0).slice(at, 512).to_pylist() for ts, seq, line in lane(i, seed)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["ts", "lane", "seq", "raw"])

    made = spark.range(lanes).mapInArrow(make, "ts bigint, lane bigint, seq int, raw binary")
    rows = written(ranked(written(made, "made"), [], [F.col("ts"), F.col("lane"), F.col("seq")], "lanes").withColumn("block", F.floor(F.col("rank") / 65536)), "lines")
    sums = rows.groupBy("block").agg(F.sum(F.octet_length("raw") + 1).alias("bytes"))
    before = sums.select("block", F.coalesce(F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # one row for 65536 lines
    own = F.coalesce(F.sum(F.octet_length("raw") + 1).over(Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(before), "block").select("rank", "raw", (F.col("first") + own).alias("at")).filter(F.col("at") < size)


def generate(spark: SparkSession, path: str, gb: float = 0.01, vectors: int = 5000, dims: int = 64, seed: int = 1337) -> dict:
    """Writes ``traces`` (JSONL shards of about SHARD bytes) and ``embeddings`` (vectors.npy and ids.npy) below ``path``; returns what it wrote."""
    at = Path(path)
    for name in ("traces", "embeddings"):
        (at / name).mkdir(parents=True, exist_ok=True)
    rows = written(events(spark, int(gb * 1e9), seed).withColumn("shard", F.floor(F.col("at") / SHARD).cast("int")), "corpus")
    folder = str(at / "traces")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, counts = {}, {}
        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard not in files:
                    files[shard] = open(f"{folder}/traces-{shard:05d}.jsonl", "wb")  # noqa: SIM115 - a shard is in one task, all of it
                files[shard].write(raw + b"\n")
                counts[shard] = counts.get(shard, 0) + 1
        for f in files.values():
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["shard", "lines"])

    done = rows.repartition("shard").sortWithinPartitions("shard", "rank").select("shard", "raw").mapInArrow(save, "shard int, lines bigint")
    lines = done.agg(F.sum("lines")).first()[0] or 0
    if vectors:
        np.save(at / "embeddings" / "vectors.npy", sample_embeddings(vectors, dims, seed))
        np.save(at / "embeddings" / "ids.npy", np.arange(vectors, dtype=np.int64))
    return {"lines": lines, "vectors": vectors, "path": str(at)}
