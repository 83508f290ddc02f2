"""Canonical trace events from raw lines, with their own reasons why some can't be read; and the way back to bytes.

JSON is read as Python reads it (NaN, repeated keys, key order, lone surrogates), which Spark's readers don't; so this runs in
Arrow workers, once a line.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.errors import IngestError

#: Names of each field, the first the canonical one, in order of priority.
ALIASES = {
    names.split()[0]: tuple(names.split())
    for names in (
        "trace_id traceid conversation_id session_id run_id",
        "ts timestamp time created_at",
        "role speaker author",
        "type event_type kind",
        "content text message output",
        "model model_name",
        "tokens_in prompt_tokens input_tokens",
        "tokens_out completion_tokens output_tokens",
        "tool_name tool name",
    )
}
TEXTS = ("trace_id", "role", "type", "model", "tool_name")
NUMBERS = ("ts", "tokens_in", "tokens_out")
SCHEMA = (
    "file string, line_index bigint, trace_id string, ts bigint, role string, type string, model string, tool_name string, "
    "tokens_in bigint, tokens_out bigint, content binary, extra binary, residual binary, error string, raw_bytes bigint"
)


def _epoch(x: int | float) -> int | None:
    if isinstance(x, float) and not math.isfinite(x):
        return None
    factor = 1_000_000 if abs(x) < 10**11 else 1_000 if abs(x) < 10**14 else 1
    return x * factor if isinstance(x, int) else round(x * factor)


def _when(x) -> int | None:
    if isinstance(x, bool) or not isinstance(x, int | float | str):
        return None
    if not isinstance(x, str):
        return _epoch(x)
    for kind in (int, float):
        try:
            return _epoch(kind(x.strip()))
        except ValueError:
            continue
    try:
        at = datetime.fromisoformat(x.strip())
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _count(x) -> int | None:
    if isinstance(x, bool):
        return None
    if isinstance(x, float):
        return int(x) if x.is_integer() else None
    if isinstance(x, str):
        try:
            return int(x.strip())
        except ValueError:
            return None
    return x if isinstance(x, int) else None


def compact(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _string(x) -> str:
    return x if isinstance(x, str) else str(x)


_READ = {"ts": _when, "tokens_in": _count, "tokens_out": _count, "content": lambda x: x if isinstance(x, str) else compact(x)}


def canonical(obj: dict) -> dict:
    """The nine fields of an event, and ``extra``: what no field took, in order.

    The first alias with a usable value wins; aliases before it that are null are taken and say nothing; values that can't be
    read stay in extra. ``name`` is a tool's name only in events whose type begins with tool.
    """
    by_name: dict[str, list[str]] = {}
    for key in obj:
        by_name.setdefault(key.lower(), []).append(key)
    gone: set[str] = set()
    out: dict = {}
    for field, aliases in ALIASES.items():
        if field == "tool_name" and not (out["type"] or "unknown").lower().startswith("tool"):
            aliases = aliases[:2]
        out[field] = None
        for key in (k for a in aliases for k in by_name.get(a, ())):
            if key in gone:
                continue
            if obj[key] is None:
                gone.add(key)
                continue
            value = _READ.get(field, _string)(obj[key])
            if value is not None:
                gone.add(key)
                out[field] = value
                break
    for field, default in (("trace_id", "unknown"), ("role", "unknown"), ("type", "unknown"), ("content", ""), ("ts", 0)):
        if out[field] is None:
            out[field] = default
    out["extra"] = {k: v for k, v in obj.items() if k not in gone}
    return out


def line_of(event: dict) -> bytes | None:
    """The canonical line of an event; None if it has characters that UTF-8 can't hold.

    Tool events without token counts name the tool before the content, all others last; extra keys come at the end, or in
    the place of the field whose name they have.
    """
    counted = event["tokens_in"] is not None or event["tokens_out"] is not None
    tool_first = event["tool_name"] is not None and not counted
    order = ["trace_id", "ts", "role", "type", *(["tool_name"] if tool_first else []), "content", "model", "tokens_in", "tokens_out", *([] if tool_first else ["tool_name"])]
    always = ("trace_id", "ts", "role", "type", "content")
    obj = {k: event[k] for k in order if k in always or event[k] is not None} | event["extra"]
    try:
        return compact(obj).encode()
    except (TypeError, ValueError):
        return None


def parse(raw: bytes) -> tuple[dict | None, str | None]:
    """The event of a line, or why there is none."""
    try:
        obj = json.loads(raw.decode("utf-8"))
    except UnicodeDecodeError as e:
        return None, f"invalid utf-8: {e}"
    except json.JSONDecodeError as e:
        return None, f"invalid json: {e}"
    except RecursionError:
        return None, "invalid json: nesting too deep"
    if not isinstance(obj, dict):
        return None, f"not a json object: {type(obj).__name__}"
    try:
        return canonical(obj), None
    except Exception as e:  # noqa: BLE001 - a line that can't be made sense of is set aside like any other
        return None, f"canonicalization failed: {e}"


def _safe(x: str | None) -> str | None:
    return None if x is None else x.encode("utf-8", "backslashreplace").decode()


def canonicalize(lines: DataFrame, on_malformed: str = "quarantine") -> DataFrame:
    """SCHEMA: a row a line. A line that its event gives back exactly has content and extra; any other, its bytes as residual.

    A malformed line has only residual and error. ``on_malformed``: quarantine keeps such rows, skip leaves them out, raise
    raises an IngestError if there is one.
    """
    if on_malformed not in ("quarantine", "skip", "raise"):
        raise ValueError(f"unknown policy: {on_malformed}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.strip().split()[0], kinds[x.strip().split()[1]]) for x in SCHEMA.split(",")])
        for b in batches:
            rows = []
            for file, at, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = raw or b""
                event, error = parse(raw)
                row = {"file": file, "line_index": at, "error": error, "raw_bytes": len(raw)}
                exact = event is not None and line_of(event) == raw
                if event is not None:
                    for k in NUMBERS:
                        fits = event[k] is None or -(2**63) <= event[k] < 2**63
                        row[k] = event[k] if fits else None
                        exact = exact and fits
                    row |= {k: _safe(event[k]) for k in TEXTS}
                if exact:
                    row["content"] = event["content"].encode() or None
                    row["extra"] = compact(event["extra"]).encode() if event["extra"] else None
                else:
                    row["residual"] = raw
                rows.append(row)
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=schema)

    out = lines.select("file", "line_index", "raw").mapInArrow(run, SCHEMA)
    if on_malformed == "quarantine":
        return out
    if on_malformed == "raise":
        bad = out.filter("error is not null").select("file", "line_index", "error").take(1)
        if bad:
            raise IngestError(f"{bad[0]['file']}:{bad[0]['line_index']}: {bad[0]['error']}")
        return out
    return out.filter(F.col("error").isNull())


def quarantine(events: DataFrame, most: int = 1000) -> DataFrame:
    """The first ``most`` malformed lines, for a report: file, line_index, error."""
    return events.filter("error is not null").select("file", "line_index", "error").orderBy("file", "line_index").limit(most)


def stats(events: DataFrame) -> DataFrame:
    """One row: files, events, malformed and bytes_read."""
    return events.agg(
        F.countDistinct("file").alias("files"),
        F.count_if(F.col("error").isNull()).alias("events"),
        F.count_if(F.col("error").isNotNull()).alias("malformed"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("bytes_read"),
    )
