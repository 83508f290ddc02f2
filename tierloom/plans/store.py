"""A store: a folder of tiers, each a set of parquet tables, under one manifest."""

from __future__ import annotations

import hashlib
import json
import os
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.errors import StoreError
from tierloom.functions.vectors import truncate
from tierloom.operators import traces
from tierloom.operators.codecs import PQ, SQ8, Binary
from tierloom.operators.search import inner, rerank, top_k
from tierloom.plans.tiers import spec_for
from tierloom.sources import canonical
from tierloom.sources.embeddings import read_embeddings
from tierloom.sources.lines import read_lines, trace_files

FORMAT = 1
CODECS = {"hot": (None,), "warm": ("sq8",), "cold": ("pq", "binary")}


class Store:
    """Opens or creates a store. Traces go to warm and cold, once each; vectors to hot, warm and cold, once each."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True):
        self.spark, self.path = spark, Path(path)
        self._manifest, self._closed, self._embed = self.path / "manifest.json", False, None
        if self._manifest.exists():
            self.manifest = json.loads(self._manifest.read_text())
            if self.manifest.get("format") != FORMAT:
                raise StoreError(f"{path}: unknown format {self.manifest.get('format')}")
        elif create:
            self.path.mkdir(parents=True, exist_ok=True)
            self.manifest = {"format": FORMAT, "created_at": int(time.time()), "traces": {}, "vectors": {}, "checksums": {}, "corpora": {}}
            self._save()
        else:
            raise StoreError(f"no store at {path}")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """The store can't be used after that; closing it again does nothing."""
        if not self._closed:
            self._save()
        self._closed = True

    def _open(self) -> None:
        if self._closed:
            raise StoreError("the store is closed")

    def _source(self, files: list[tuple[str, str]]) -> str:
        """The digest of a corpus, of its files' names and digests in order of the names; and the ledger's entry of it, one for each corpus."""
        h = hashlib.sha256()
        for name, path in sorted(files):
            h.update(f"{len(name)}:{name}:{_sha256(Path(path))}\n".encode("utf-8", "surrogateescape"))
        entry = self.manifest.setdefault("corpora", {}).setdefault(h.hexdigest(), {"files": []})
        entry["files"] = sorted({*entry["files"], *(n for n, _ in files)})
        return h.hexdigest()

    def _save(self) -> None:
        new = self._manifest.with_suffix(".new")
        new.write_text(json.dumps(self.manifest, indent=1, sort_keys=True))
        os.replace(new, self._manifest)

    def _write(self, df: DataFrame, at: Path, level: int | None = None) -> None:
        w = df.write.mode("overwrite")
        if level:
            w = w.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
        w.parquet(str(at))

    def _seal(self, at: Path) -> int:
        size = 0
        for f in sorted(p for p in at.rglob("*") if p.is_file() and not p.name.startswith(".")):
            self.manifest["checksums"][f.relative_to(self.path).as_posix()] = _sha256(f)
            size += f.stat().st_size
        return size

    def put_traces(self, path: str, tier: str = "cold") -> dict:
        """Shreds the JSONL files at ``path``; returns counts and the tier's bytes."""
        self._open()
        if tier not in ("warm", "cold"):
            raise StoreError(f"traces can't go to the {tier} tier")
        if tier in self.manifest["traces"]:
            raise StoreError(f"the {tier} tier has traces already")
        at = self.path / "traces" / tier
        level = spec_for(tier).zstd_level
        events = canonical.canonicalize(read_lines(self.spark, path))
        self._write(events, at / "_events")
        events = self.spark.read.parquet(str(at / "_events"))
        for name, df in traces.shred(events).items():
            # lines in order: within a file, neighbours are alike and compress; items likewise
            order = ["file", "line_index"] if name == "structured" else ["item"]
            self._write(df.repartitionByRange(*order).sortWithinPartitions(*order), at / name, level)
        stats = canonical.stats(events).first().asDict()
        self._write(canonical.quarantine(events), at / "quarantine")
        self._delete(at / "_events")
        self.manifest["traces"][tier] = stats | {"bytes": self._seal(at), "corpus": self._source(trace_files(path))}
        self._save()
        return self.manifest["traces"][tier]

    @staticmethod
    def _delete(at: Path) -> None:
        for p in sorted(at.rglob("*"), reverse=True):
            p.unlink() if p.is_file() else p.rmdir()
        at.rmdir()

    def bundle(self, tier: str) -> dict[str, DataFrame]:
        if tier not in self.manifest["traces"]:
            raise StoreError(f"no traces in the {tier} tier")
        return {n: self.spark.read.parquet(str(self.path / "traces" / tier / n)) for n in ("structured", "content", "extra", "residual")}

    def replay_raw(self, trace_id: str) -> list[bytes]:
        """The lines of one trace, in order; all tiers that have it must agree."""
        self._open()
        if not self.manifest["traces"]:
            raise StoreError("the store has no traces")
        found = {t: [bytes(r.raw) for r in traces.replay(self.bundle(t), trace_id).orderBy("file", "line_index").collect()] for t in self.manifest["traces"]}
        got = [x for x in found.values() if x]
        if not got:
            raise StoreError(f"unknown trace {trace_id}")
        if any(x != got[0] for x in got):
            raise StoreError(f"tiers disagree on trace {trace_id}")
        return got[0]

    def replay(self, trace_id: str) -> list[dict]:
        return [json.loads(x) for x in self.replay_raw(trace_id)]

    def put_embeddings(self, path: str, tier: str = "warm", codec: str | None = None, dims: int | None = None, m: int | None = None) -> dict:
        """Normalizes, cuts to ``dims`` and encodes the vectors at ``path``."""
        self._open()
        codec = codec or CODECS.get(tier, (None,))[0]
        if tier not in CODECS or codec not in CODECS[tier]:
            raise StoreError(f"codec {codec} doesn't go with the {tier} tier")
        if tier in self.manifest["vectors"]:
            raise StoreError(f"the {tier} tier has vectors already")
        rows = read_embeddings(self.spark, path)
        original = rows.agg(F.max(F.size("vector"))).first()[0]
        others = {v["original"] for v in self.manifest["vectors"].values()}
        if others and others != {original}:
            raise StoreError(f"vectors of {original} dimensions, not {others.pop()}")
        names, rows = rows.select("row", F.col("id").alias("name")), rows.select(F.col("row").alias("id"), "vector")
        if dims:
            rows = rows.withColumn("vector", truncate(F.col("vector"), dims))
        at = self.path / "vectors" / tier
        d, state = dims or original, {}
        if codec == "sq8":
            c = SQ8.fit(rows)
            state, coded = {"mins": c.mins.tolist(), "scale": c.scale.tolist()}, c.encode(rows).select("id", "code")
        elif codec == "pq":
            c = PQ.fit(rows, m or max(1, d // 4))
            state, coded = {"words": c.words.tolist()}, c.encode(rows).select("id", "code")
        else:  # hot keeps the vectors, and so does binary, in single precision: its scan reads signs
            coded = rows.select("id", F.col("vector").cast("array<float>").alias("vector")) if codec is None else Binary.encode(rows).select("id", "code", F.size("vector").alias("d"))
        self._write(coded, at / "codes")
        self._write(names, at / "names")
        (at / "state.json").write_text(json.dumps(state))
        self.manifest["vectors"][tier] = {"codec": codec, "dims": d, "original": original, "n": coded.count(), "ids": _same(names), "bytes": self._seal(at)}
        self._save()
        return self.manifest["vectors"][tier]

    def _codes(self, tier: str) -> tuple[DataFrame, dict, DataFrame]:
        at = self.path / "vectors" / tier
        read = self.spark.read.parquet
        return read(str(at / "codes")), json.loads((at / "state.json").read_text()), read(str(at / "names"))

    def search(self, queries: np.ndarray, k: int = 10, tier: str | None = None) -> DataFrame:
        """query, rank, id and score of the k nearest by inner product; without a tier, in the best one there is.

        PQ and binary results are scored again by warm or else hot vectors, if there are any of the same rows and dimensions.
        """
        self._open()
        if k < 1:
            raise StoreError("k must be at least 1")
        have = self.manifest["vectors"]
        tier = tier or next((t for t in ("hot", "warm", "cold") if t in have), None)
        if tier not in have:
            raise StoreError(f"no vectors in the {tier} tier" if tier else "the store has no vectors")
        meta = have[tier]
        q = np.atleast_2d(np.asarray(queries, float))
        if q.shape[1] != meta["original"] or not np.isfinite(q).all():
            raise StoreError(f"queries must be finite and of {meta['original']} dimensions")
        asked = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
        asked = asked.withColumn("vector", truncate(F.col("vector"), meta["dims"]))
        codes, state, names = self._codes(tier)
        depth = max(k, spec_for(tier, meta["codec"]).rerank_depth)
        if meta["codec"] == "sq8":
            found = top_k(codes, asked, SQ8(np.array(state["mins"]), np.array(state["scale"])).scorer, k, False)
        elif meta["codec"] is None:
            found = top_k(codes, asked, inner, k, False)
        else:
            scorer = PQ(np.array(state["words"])).scorer if meta["codec"] == "pq" else Binary.words_scorer
            again = next((t for t in ("warm", "hot") if t in have and all(have[t].get(x) == meta.get(x) for x in ("dims", "n", "ids"))), None)
            found = top_k(codes, asked, scorer, depth if again else k, False)
            if again:
                other, state, _ = self._codes(again)
                if again == "warm":
                    values = SQ8(np.array(state["mins"]), np.array(state["scale"])).values
                    other = _decoded(other, values)
                found = rerank(found, other, asked, k)
        found = found.join(names.select(F.col("row").alias("_row"), "name"), F.col("id") == F.col("_row"))
        return found.select(F.col("query_id").alias("query"), "rank", F.col("name").alias("id"), "score")

    def set_embedder(self, embed) -> None:
        """``embed``: a text's vector, for searches by text."""
        self._embed = embed

    def search_cli(self, query: str, k: int = 10, tier: str | None = None) -> DataFrame:
        """A search by a vector, if the query is one in JSON, else by a text."""
        try:
            vector = json.loads(query)
        except json.JSONDecodeError:
            vector = None
        if isinstance(vector, list) and vector and all(isinstance(x, int | float) and not isinstance(x, bool) for x in vector):
            return self.search(np.array(vector, float), k, tier)
        if self._embed is None:
            raise StoreError("a search by text needs an embedder")
        return self.search(np.asarray(self._embed(query), float), k, tier)

    def verify(self) -> list[str]:
        """Files whose bytes aren't those that were written, or that are gone."""
        return [f for f, sha in sorted(self.manifest["checksums"].items()) if not (self.path / f).exists() or _sha256(self.path / f) != sha]


def _same(names: DataFrame) -> str:
    """A digest of which row has which id: the same for two tiers only if their rows are the same, in the same order."""
    row = names.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", "name")).alias("x"), F.sum(F.pmod(F.xxhash64("name", "row"), F.lit(1 << 40))).alias("s")).first()
    return f"{row['n']}:{row['x']}:{row['s']}"


def _decoded(codes: DataFrame, values) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values(x).tolist(), pa.list_(pa.float64()))], ["id", "vector"])

    return codes.select("id", "code").mapInArrow(run, "id bigint, vector array<double>")


def _sha256(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()
