"""A made-up corpus through the whole library: audit, store, search, replay, and the service."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import tierloom
from tierloom.errors import AuditError, StoreError
from tierloom.functions import zstd
from tierloom.operators.codecs import PQ, SQ8, Binary
from tierloom.operators.search import matrix
from tierloom.plans import pricing, recall, synth
from tierloom.service import Refused, answer
from tierloom.sources.corpus import locate


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    return at, tierloom.synth(spark, str(at), gb=0.0005, vectors=400, dims=16)


def test_lines_are_in_order_of_time_and_as_many_bytes_as_asked_for(corpus):
    at, made = corpus
    data = b"".join(p.read_bytes() for p in sorted((at / "traces").iterdir()))
    lines = data.removesuffix(b"\n").split(b"\n")
    assert len(lines) == made["lines"] and 500_000 <= len(data) < 510_000
    good = []
    for x in lines:
        try:
            good.append(json.loads(x)["ts"])
        except (ValueError, TypeError, KeyError):
            pass
    assert good == sorted(good) and 0.95 < len(good) / len(lines) < 1
    assert list(synth.lane(3, 1)) == list(synth.lane(3, 1)) != list(synth.lane(4, 1))


def test_audit_store_and_service(spark, corpus, tmp_path):
    at, made = corpus
    audit = tierloom.audit(spark, str(at), str(tmp_path / "store"), str(tmp_path / "report"))
    assert audit.stats["events"] + audit.stats["malformed"] == made["lines"] and audit.mismatches == 0 and audit.near["clusters"] > 0
    assert audit.vectors["sq8"]["recall"] > 0.9 and "recall among ten" in audit.text() and (tmp_path / "report" / "audit.json").exists()
    with tierloom.open(spark, str(tmp_path / "store")) as s:
        assert len(s.manifest["corpora"]) == 1  # two tiers of one corpus
        for tier in ("hot", "warm", "cold"):
            s.put_embeddings(str(at / "embeddings"), tier)
        x = np.load(at / "embeddings" / "vectors.npy")
        found = s.search_cli(json.dumps(x[7].tolist()), 3, "cold").orderBy("rank").collect()
        assert len(found) == 3 and found[0].score > 0.99  # reranked by the warm tier, whose ids are the same
        with pytest.raises(StoreError):
            s.search_cli("some words")
        s.set_embedder(lambda text: x[len(text)])
        assert s.search_cli("some words", 1).first().score > 0.99
    with pytest.raises(StoreError):
        s.search(x[0])
    ask = lambda *a: answer(spark, str(tmp_path / "store"), str(at.parent), *a)
    assert len(ask("GET", "/search?k=2&q=" + json.dumps(x[7].tolist()).replace(" ", ""))["found"]) == 2
    assert ask("GET", "/replay/lane-00000001")["lines"]
    for code, request in ((404, ("GET", "/nothing")), (400, ("POST", "/audit", b"[]")), (400, ("POST", "/audit", b'{"path": "/etc"}')), (404, ("POST", "/audit", b'{"path": "none"}'))):
        with pytest.raises(Refused) as e:
            ask(*request)
        assert e.value.code == code


def test_reranking_needs_the_same_ids(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(300, 16)).astype(np.float32)
    for name, y in (("a", x), ("b", x[::-1])):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "vectors.npy", y)
        np.save(tmp_path / name / "ids.npy", np.arange(300) if name == "a" else np.arange(300)[::-1].copy())
    with tierloom.open(spark, str(tmp_path / "store")) as s:
        s.put_embeddings(str(tmp_path / "a"), "hot")
        s.put_embeddings(str(tmp_path / "b"), "cold")
        assert s.manifest["vectors"]["hot"]["n"] == s.manifest["vectors"]["cold"]["n"] and s.manifest["vectors"]["hot"]["ids"] != s.manifest["vectors"]["cold"]["ids"]
        ids = [r.id for r in s.search(x[5], 10, "cold").orderBy("rank").collect()]
        assert "5" in map(str, ids)  # by the cold tier's own rows, not those of the hot tier in their places


def test_codecs(spark):
    x = np.random.default_rng(1).normal(size=(400, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    with pytest.raises(ValueError):
        PQ.subspaces(12, 5)
    with pytest.raises(ValueError):
        PQ.subspaces(12, 3, bits=4)
    assert PQ.subspaces(12) == 3 and PQ.fit(rows).words.shape == (3, 256, 4)
    sq8 = SQ8.fit(rows)
    coded = sq8.encode(rows).select("id", "code")
    more = sq8.add(coded, rows.limit(5))
    assert more.count() == 405 and sorted(r.id for r in more.filter("id >= 400").collect()) == [400, 401, 402, 403, 404]
    signs = {r.id: r.vector for r in Binary.decode(Binary.encode(rows).withColumn("d", F.size("vector"))).collect()}
    assert all(signs[i] == np.where(v > 0, 1.0, -1.0).tolist() for i, v in enumerate(x))
    import pyarrow as pa

    assert matrix(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
    for bad in ([[1.0, 2.0, 3.0, 4.0], None], [[1.0], [1.0, 2.0, 3.0]]):
        with pytest.raises(ValueError):
            matrix(pa.array(bad, pa.list_(pa.float64())))
    with pytest.raises(AuditError):
        recall.verify(rows.limit(50), rows.limit(1).withColumnRenamed("id", "query_id"))


def test_frames(spark):
    rows = spark.createDataFrame([(i, (f"payload {i % 7} " * 50).encode()) for i in range(300)] + [(300, None), (301, b"")], "id int, body binary")
    for d in (b"", zstd.train_dictionary(rows, "body")):
        small = zstd.compressed(rows, "body", 19, d, window_log=20, long_range=True)
        assert sorted(zstd.decompressed(small, "body", d).collect(), key=lambda r: r.id) == sorted(rows.collect(), key=lambda r: r.id)
        assert small.agg(F.sum(F.octet_length("body"))).first()[0] < rows.agg(F.sum(F.octet_length("body"))).first()[0] / 5
    assert zstd.train_dictionary(rows.limit(1), "body") == zstd.train_dictionary(rows.limit(0), "body") == b""


def test_prices_and_numbers(tmp_path):
    (tmp_path / "pricing.toml").write_text("[gb_month]\ntraces = 0.5\n")
    assert pricing.load_pricing(str(tmp_path)) == {"traces": 0.5, "vectors": 0.33} and pricing.load_pricing() == {"traces": 0.023, "vectors": 0.33}
    for bad in ("traces = -1", "traces = 'x'", "rent = 1", "traces ="):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(AuditError):
            pricing.load_pricing(str(tmp_path / "bad.toml"))
    assert (pricing.usd(-1234.5), pricing.size(999), pricing.size(1.5e9), pricing.ratio(0, 1), pricing.recall(None), pricing.percent(1, 3)) == ("-$1,234.50", "999 B", "1.5 GB", "n/a", "not measured", "33.33%")


def test_where_a_corpus_is(tmp_path):
    (tmp_path / "x.jsonl").write_text("{}\n")
    assert locate(str(tmp_path)).traces == str(tmp_path) and locate(str(tmp_path)).vectors is None
    np.save(tmp_path / "v.npy", np.ones((2, 2)))
    assert locate(str(tmp_path)).vectors == str(tmp_path / "v.npy") and locate(str(tmp_path / "v.npy")).traces is None
    (tmp_path / "embeddings").mkdir()
    assert locate(str(tmp_path)).traces is None
