import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tierloom.errors import IngestError, StoreError
from tierloom.operators import traces
from tierloom.plans.audit import run_audit
from tierloom.plans.store import Store
from tierloom.sources import canonical
from tierloom.sources.lines import read_lines

LINES = [
    b'{"trace_id":"t1","ts":1700000000000000,"role":"user","type":"message","content":"h\xc3\xa9 \xf0\x9f\x99\x82"}',
    b'{"trace_id": "t1", "ts": 1, "content": "spaced"}',
    b'{"trace_id":"t2","ts":5,"role":"tool","type":"tool_call","tool_name":"x","content":"y","k":1.50}\r',
    b"not json",
    b"\xff\xfe",
    b"[1,2]",
    b'{"trace_id":"t2","ts":99999999999999999999999,"role":"a","type":"b","content":""}',
    b'{"trace_id":"t2","ts":6,"role":"a","type":"b","content":"z","model":"m","tokens_in":1,"tokens_out":2,"extra":{"b":1,"a":[2.0]}}',
    b'{"a":"\\ud800"}',
    b"",
    b'{"trace_id":"t1","ts":7,"role":"user","type":"message","content":"last"}',
]


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(b"\n".join(LINES) + b"\n")
    (tmp_path / "in" / "_b.jsonl.1").write_bytes(b"\xef\xbb\xbf" + LINES[0] + b"\r\n" + LINES[-1])
    (tmp_path / "in" / "c.jsonl.gz").write_bytes(b"no")
    return tmp_path


def test_lines_are_read_byte_for_byte(spark, corpus):
    got = read_lines(spark, str(corpus / "in")).orderBy("file", "line_index").collect()
    assert [bytes(r.raw) for r in got if r.file == "a.jsonl"] == LINES
    assert [bytes(r.raw) for r in got if r.file == "_b.jsonl.1"] == [b"\xef\xbb\xbf" + LINES[0] + b"\r", LINES[-1]]
    with pytest.raises(Exception, match="no such file"):
        read_lines(spark, str(corpus / "none")).count()


def test_round_trip_of_every_line(spark, corpus):
    lines = read_lines(spark, str(corpus / "in"))
    events = canonical.canonicalize(lines).cache()
    assert canonical.stats(events).first().asDict() == {"files": 2, "events": 8, "malformed": 5, "bytes_read": lines.selectExpr("sum(length(raw))").first()[0]}
    bundle = traces.shred(events)
    assert traces.differences(lines, traces.replay(bundle)).first().asDict() == {"left_lines": 13, "right_lines": 13, "mismatches": 0}
    one = traces.replay(bundle, "t2").orderBy("line_index").collect()
    assert [bytes(r.raw) for r in one] == [LINES[2], LINES[6], LINES[7]]
    assert canonical.canonicalize(lines, "skip").count() == 8
    with pytest.raises(IngestError):
        canonical.canonicalize(lines, "raise")
    with pytest.raises(ValueError):
        canonical.canonicalize(lines, "what")


@pytest.mark.parametrize(
    "value,micros",
    [
        (1700000000, 1700000000000000), (1700000000.25, 1700000000250000), (1700000000123, 1700000000123000), (1700000000123456, 1700000000123456), ("1700000000", 1700000000000000),
        ("2023-11-14T23:13:20+01:00", 1700000000000000), ("2023-11-14T22:13:20", 1700000000000000), (float("nan"), 0), ("1e999", 0), ("not a date", 0), (True, 0), ([1], 0),
    ],
)
def test_times(value, micros):
    e = canonical.canonical({"ts": value})
    assert e["ts"] == micros and (micros != 0) == ("ts" not in e["extra"])


def test_aliases():
    e = canonical.canonical({"Session_ID": 5, "text": {"a": 1}, "name": "n", "kind": "Tool_x", "role": None, "speaker": "s", "prompt_tokens": "7", "output_tokens": 1.5, "z": 0})
    assert (e["trace_id"], e["content"], e["tool_name"], e["type"], e["role"], e["tokens_in"], e["tokens_out"]) == ("5", '{"a":1}', "n", "Tool_x", "s", 7, None)
    assert e["extra"] == {"output_tokens": 1.5, "z": 0}
    assert canonical.canonical({"name": "n"})["extra"] == {"name": "n"}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from([a for x in canonical.ALIASES.values() for a in x] + ["k", "Z"]), st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(max_size=5)), max_size=8), st.booleans())
def test_a_line_is_its_event_or_residual(obj, spaced):
    raw = json.dumps(obj, separators=(", ", ": ") if spaced else (",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")
    event, error = canonical.parse(raw)
    assert (event is None) == (error is not None)
    if event is not None and canonical.line_of(event) == raw:
        assert canonical.parse(canonical.line_of(event))[0] == event


def test_store(spark, corpus):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 32)).astype(np.float32)
    (corpus / "v").mkdir()
    np.save(corpus / "v" / "vectors.npy", x)
    np.save(corpus / "v" / "ids.npy", np.arange(1000, 1200))
    with pytest.raises(StoreError):
        Store(spark, str(corpus / "none"), create=False)
    store = Store(spark, str(corpus / "s"))
    for tier, codec in (("hot", None), ("warm", "sq8"), ("cold", "pq")):
        assert store.put_embeddings(str(corpus / "v"), tier, codec)["n"] == 200
    for bad in (("warm", "pq"), ("hot", "sq8"), ("warm", None), ("lukewarm", None)):
        with pytest.raises(StoreError):
            store.put_embeddings(str(corpus / "v"), *bad)
    q = x[17] + 0.02 * rng.normal(size=32)
    for tier in (None, "hot", "warm", "cold"):
        got = store.search(q, 3, tier).orderBy("rank").collect()
        assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["id"] == "1017"
    with pytest.raises(StoreError):
        store.search(q, 0)
    with pytest.raises(StoreError):
        store.search(q[:5], 1)
    audit = run_audit(spark, str(corpus / "in"), str(corpus / "s"), str(corpus / "report"))
    assert audit.mismatches == 0 and audit.stats["malformed"] == 5 and (corpus / "report" / "audit.html").exists()
    store = Store(spark, str(corpus / "s"), create=False)
    assert store.replay_raw("t2") == [LINES[2], LINES[6], LINES[7]] and store.replay("t1")[-1]["content"] == "last"
    with pytest.raises(StoreError, match="unknown trace"):
        store.replay("t9")
    with pytest.raises(StoreError):
        store.put_traces(str(corpus / "in"), "hot")
    assert store.verify() == []
    f = next((corpus / "s" / "vectors" / "hot" / "codes").glob("*.parquet"))
    f.write_bytes(f.read_bytes() + b"x")
    assert store.verify() == [f.relative_to(corpus / "s").as_posix()]
