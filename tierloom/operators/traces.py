"""Shredding canonical events into columns and content-addressed payloads, and replaying the lines byte for byte."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.operators.tables import ranked
from tierloom.sources.canonical import line_of

FIELDS = ["trace_id", "ts", "role", "type", "model", "tool_name", "tokens_in", "tokens_out", "file", "line_index"]


def template(body: Column) -> Column:
    """The first 64 bytes of a payload's first 256, each run of ASCII white space a space: payloads of one template agree in it."""
    head = F.decode(F.substring(body, 1, 256), "ISO-8859-1")
    return F.substring(F.regexp_replace(head, r"[ \t\r\n\f\x0B]+", " "), 1, 64)


def intern(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """sha, copies, first (the least ``order``) and body of each distinct payload in ``column``; a null is none."""
    body = F.col(column)
    keyed = rows.filter(body.isNotNull()).select(F.sha2(body, 256).alias("sha"), F.struct(*order).alias("first"), body.alias("body"))
    return keyed.groupBy("sha").agg(F.count("*").alias("copies"), F.min("first").alias("first"), F.first("body").alias("body"))


def pack(payloads: DataFrame) -> DataFrame:
    """item (from 0), sha and body: payloads of one template side by side, ordered by template, first 96 bytes and sha."""
    order = [template(F.col("body")), F.substring("body", 1, 96), F.col("sha")]
    keyed = payloads.select("sha", "body", *(k.alias(f"_k{i}") for i, k in enumerate(order)))
    return ranked(keyed, [], [F.col(f"_k{i}") for i in range(3)], "packed").select(F.col("rank").alias("item"), "sha", "body")


def shred(events: DataFrame) -> dict[str, DataFrame]:
    """structured (13 columns), content, extra and residual (item and body each).

    Equal payloads are stored once; a row refers to them by item, or by null where it has none.
    """
    order = ["file", "line_index"]
    out = {name: pack(intern(events, name, order)) for name in ("content", "extra")}
    rows = events
    for name, store in out.items():
        refs = store.select(F.col("sha").alias("_sha"), F.col("item").alias(f"{name}_ref"))
        rows = rows.join(refs, F.sha2(F.col(name), 256) == F.col("_sha"), "left").drop("_sha")
    left = ranked(events.filter("residual is not null").select(*order, F.col("residual").alias("body")), [], [F.col(c) for c in order], "residual")
    refs = left.select(*order, F.col("rank").alias("residual_ref"))
    out["residual"] = left.select(F.col("rank").alias("item"), "body")
    out["structured"] = rows.join(refs, order, "left").select(*FIELDS, "content_ref", "extra_ref", "residual_ref")
    return out


def replay(bundle: dict[str, DataFrame], trace_id: str | None = None) -> DataFrame:
    """file, line_index and raw of all lines, or of those of one trace; the filter is applied before payloads are looked up."""
    rows = bundle["structured"]
    if trace_id is not None:
        rows = rows.filter(F.col("trace_id") == trace_id)
    for name in ("content", "extra", "residual"):
        store = bundle[name].select(F.col("item").alias(f"{name}_ref"), F.col("body").alias(name))
        rows = rows.join(store, f"{name}_ref", "left")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for r in b.to_pylist():
                if r["residual"] is None:
                    extra = json.loads(r.pop("extra") or b"{}")
                    r["content"] = (r["content"] or b"").decode()
                    raw.append(line_of(r | {"extra": extra}))
                else:
                    raw.append(r["residual"])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("file")), b.column(b.schema.get_field_index("line_index")), pa.array(raw, pa.binary())], ["file", "line_index", "raw"])

    return rows.select(*FIELDS, "content", "extra", "residual").mapInArrow(lines, "file string, line_index bigint, raw binary")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the lines of either side, and those that the other side lacks or has with other bytes."""
    x, y = a.select("file", "line_index", F.col("raw").alias("_a")), b.select("file", "line_index", F.col("raw").alias("_b"))
    both = x.join(y, ["file", "line_index"], "full_outer")
    return both.agg(F.count("_a").alias("left_lines"), F.count("_b").alias("right_lines"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"))


def block_offsets(items: DataFrame, block: int = 1 << 20) -> DataFrame:
    """item, block and offset: items in order, cut into blocks by the bytes before them; the sums run within partitions, not over all rows."""
    sized = ranked(items.select("item", F.octet_length("body").cast("bigint").alias("size")), [], [F.col("item")], "offsets")
    group = (F.col("rank") / 4096).cast("bigint")
    from pyspark.sql import Window

    sums = sized.groupBy(group.alias("g")).agg(F.sum("size").alias("s"))
    before = ranked(sums, [], [F.col("g")], "sums").withColumn("h", (F.col("rank") / 4096).cast("bigint"))
    upper = before.groupBy("h").agg(F.sum("s").alias("hs"))
    upper = upper.withColumn("h0", F.coalesce(F.sum("hs").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.join(upper.select("h", "h0"), "h")
    before = before.withColumn("g0", F.col("h0") + F.coalesce(F.sum("s").over(Window.partitionBy("h").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = sized.withColumn("g", group).join(before.select("g", "g0"), "g")
    own = F.coalesce(F.sum("size").over(Window.partitionBy("g").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", F.col("g0") + own)
    return rows.select("item", "size", "start", F.floor(F.col("start") / block).alias("block"))
