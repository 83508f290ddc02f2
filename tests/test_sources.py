import json

import numpy as np
import pytest

from tierloom.errors import IngestError
from tierloom.sources.embeddings import read_embeddings
from tierloom.streaming.ingest import stream_lines, windowed_counts

X = np.array([[3.0, 4.0], [0.0, 0.0], [1.0, np.nan]], np.float32)


def got(spark, path, **kw):
    return [(r.row, r.id, [round(v, 6) for v in r.vector], r.zeroed) for r in read_embeddings(spark, str(path), **kw).orderBy("row").collect()]


def test_kinds_of_files(spark, tmp_path):
    np.save(tmp_path / "x.npy", X)
    want = [(0, "0", [0.6, 0.8], False), (1, "1", [0.0, 0.0], False), (2, "2", [0.0, 0.0], True)]
    assert got(spark, tmp_path / "x.npy") == want
    spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(X)], "id bigint, vec binary").coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    assert got(spark, tmp_path / "b.parquet") == want
    spark.createDataFrame([(float(v[0]), float(v[1])) for v in X], "a double, b double").coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    assert got(spark, tmp_path / "d.parquet", dims=2) == want
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps({"id": f"k{i}", "embedding": v}) for i, v in enumerate(([3, 4], [0, 0]))))
    assert got(spark, tmp_path / "e.jsonl") == [(0, "k0", [0.6, 0.8], False), (1, "k1", [0.0, 0.0], False)]


@pytest.mark.parametrize("name,text", [("a.jsonl", '{"vector": [1, 2]}\n{"vector": [1]}'), ("b.jsonl", '{"id": 1, "vector": [1, 2]}\n{"vector": [1, 3]}'), ("c.txt", "x")])
def test_what_cannot_be_read(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(IngestError):
        read_embeddings(spark, str(tmp_path / name))


def test_streamed_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(b'{"trace_id":"x","ts":1}\nbad\xff\n')
    q = stream_lines(spark, str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "good"), str(tmp_path / "bad"))
    q.awaitTermination(120)
    assert [r.trace_id for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["x"]
    assert [bytes(r.residual) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [b"bad\xff"]


def test_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg({"events": "sum"}).first()[0] == events.count()
