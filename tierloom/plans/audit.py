"""An audit: ingest a corpus, compress it in both tiers, look for duplicates, replay and compare, price, and report."""

from __future__ import annotations

import html
import json
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tierloom.errors import AuditError
from tierloom.operators import dedup, traces
from tierloom.operators.tables import written
from tierloom.plans import pricing, recall
from tierloom.plans.store import Store
from tierloom.plans.tiers import codec_bytes
from tierloom.sources import canonical
from tierloom.sources.corpus import locate
from tierloom.sources.embeddings import read_embeddings
from tierloom.sources.lines import read_lines


@dataclass
class Audit:
    """What an audit measured; ``text`` and ``page`` are its two reports."""

    stats: dict = field(default_factory=dict)
    tiers: dict = field(default_factory=dict)
    duplicates: dict = field(default_factory=dict)
    mismatches: int = 0
    monthly_usd: dict = field(default_factory=dict)
    seconds: dict = field(default_factory=dict)
    vectors: dict = field(default_factory=dict)
    near: dict = field(default_factory=dict)

    def rows(self) -> list[tuple[str, str]]:
        out = [(k.replace("_", " "), f"{v:,}") for k, v in self.stats.items()]
        out += [(f"{t} bytes", f"{v['bytes']:,} ({pricing.ratio(self.stats['bytes_read'], v['bytes'])})") for t, v in self.tiers.items()]
        out += [(f"duplicate {k}", f"{v:,}") for k, v in self.duplicates.items()]
        out += [(f"near duplicate {k}", f"{v:,}") for k, v in self.near.items()]
        out += [(f"{c} codes", f"{pricing.size(v['codes'])}, recall among ten {pricing.recall(v['recall'])}") for c, v in self.vectors.items()]
        out += [("lines that differ after replay", f"{self.mismatches:,}")] if self.stats else []
        return out + [(f"{t}, a month", pricing.usd(v)) for t, v in self.monthly_usd.items()]

    def text(self) -> str:
        return "\n".join(f"| {k} | {v} |" for k, v in [("Measure", "Value"), ("-", "-"), *self.rows()]) + "\n"

    def page(self) -> str:
        cells = "".join(f"<tr><td>{html.escape(k)}</td><td>{html.escape(v)}</td></tr>" for k, v in self.rows())
        return f"<!doctype html><title>Audit</title><table>{cells}</table>\n"

    def to_dict(self) -> dict:
        return asdict(self)


def _vectors(spark: SparkSession, path: str, queries: int) -> dict:
    """Per codec: bytes of its codes and recall among ten; the recall is None where there are too few vectors to hold any out."""
    rows = written(read_embeddings(spark, path).select(F.col("row").alias("id"), "vector"), "vectors")
    n = rows.count()
    if n < recall.LEAST + 1:
        sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).select(codec_bytes(F.col("n"), F.col("d")).alias("x")).select("x.*")
        return {r["codec"]: {"codes": r["codes"], "recall": None} for r in sizes.collect()}
    base, asked = recall.split(rows, max(1, min(queries, n - recall.LEAST, n // 10)))
    return {r["codec"]: {"codes": r["codes"], "recall": r["recall_10"]} for r in recall.verify(base, asked).collect()}


def run_audit(spark: SparkSession, path: str, store_path: str, report_dir: str | None = None, tiers: tuple[str, ...] = ("warm", "cold"), prices: str | None = None, queries: int = 200) -> Audit:
    """Seven stages over what there is of traces and vectors: ingest, compression, exact and near duplicates, round trips, recall, prices, reports.

    Lines that replay otherwise than they were raise an AuditError: a store that isn't exact is no store.
    """
    audit, store, corpus, usd = Audit(), Store(spark, store_path), locate(path), pricing.load_pricing(prices)

    def timed(name, f):
        began = time.time()
        out = f()
        audit.seconds[name] = round(time.time() - began, 3)
        return out

    if corpus.traces:
        lines = read_lines(spark, corpus.traces)
        events = timed("ingest", lambda: written(canonical.canonicalize(lines), "events"))
        audit.stats = canonical.stats(events).first().asDict()
        for tier in dict.fromkeys(tiers):  # each once, in the order asked for
            audit.tiers[tier] = timed(f"compress_{tier}", lambda t=tier: store.put_traces(corpus.traces, t))
        bodies = events.filter("content is not null").select(F.col("content").cast("string").alias("text"), F.xxhash64("file", "line_index").alias("doc_id"))
        bodies = written(bodies, "bodies")
        groups = timed("dedup", lambda: dedup.exact_groups(bodies).agg(F.count("*").alias("groups"), F.coalesce(F.sum("saved"), F.lit(0)).alias("bytes")).first())
        audit.duplicates = groups.asDict()
        near = timed("near_dedup", lambda: dedup.near_clusters(bodies).agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("bodies")).first())
        audit.near = near.asDict()
        for tier in audit.tiers:
            diff = timed(f"round_trip_{tier}", lambda t=tier: traces.differences(lines, traces.replay(store.bundle(t))).first())
            audit.mismatches += diff["mismatches"]
        if audit.mismatches:
            raise AuditError(f"{audit.mismatches} lines differ after replay")
        audit.monthly_usd = {"raw": audit.stats["bytes_read"] / 1e9 * usd["traces"], **{t: v["bytes"] / 1e9 * usd["traces"] for t, v in audit.tiers.items()}}
    if corpus.vectors:
        audit.vectors = timed("recall", lambda: _vectors(spark, corpus.vectors, queries))
        audit.monthly_usd |= {c: v["codes"] / 1e9 * usd["vectors"] for c, v in audit.vectors.items()}
    if report_dir:
        at = Path(report_dir)
        at.mkdir(parents=True, exist_ok=True)
        (at / "audit.md").write_text(audit.text())
        (at / "audit.html").write_text(audit.page())
        (at / "audit.json").write_text(json.dumps(audit.to_dict(), indent=1, default=str))
    return audit
