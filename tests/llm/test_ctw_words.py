import time
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.cases import documents
from tierloom.llm import ctw, ctw_text


class Frame:
    """Stands for a frame: keeps what would run in a task."""

    def mapInArrow(self, run, _):
        self.run = run
        return self


def gather(monkeypatch, batch, common):
    """The rows of one task. common: words, whether known, base."""
    monkeypatch.setattr(ctw_text, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 3)}))
    frame = ctw_text._gathered(Frame(), *common)
    return lambda: list(frame.run(iter([batch])))


ODD = [None, "", " ", "\x0b\x0c\r\n\t ", " Ab\x1fc  AB\tab ", "ÄÖ x y\u0085z", "İ ẞ K", "\x00 \x00\x00", "\n", "x" * 3000, "a " * 1000, "日本 語 🙂", " end"]


def test_words_of_a_batch_as_of_one_text_after_the_other():
    whole = pa.array(ODD * 3)
    bad = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 3, 7], np.int32)), pa.py_buffer(b"A\xff \xc3 \xc3B")])  # not UTF-8
    for column in (whole, whole.slice(5, 20), whole.slice(1, 1), whole.slice(0, 0), bad, bad.slice(1), pa.nulls(3, pa.string())):
        raw = [b.as_buffer().to_pybytes() if (b := x).is_valid else b"" for x in column.cast(pa.large_binary())]
        want = [ctw.tokens(t) for t in raw]
        spelled = ctw_text.split(column)
        assert ctw_text.joined(*spelled, len(column)) == [ctw_text.running(w) for w in want]
        words, at, of = ctw_text.numbered(*spelled, len(column))
        words = words.to_pylist()
        got = [Counter() for _ in want]
        for i, t in zip(at.tolist(), of.tolist(), strict=True):
            got[t][words[i]] += 1
        assert got == [Counter(w) for w in want]
        out = np.arange(len(column)) % 3 == 1
        here, times = ctw_text.counted(out, column)
        all_ = Counter(w for own, o in zip(want, out, strict=True) if not o for w in own)
        assert dict(zip(here.to_pylist(), times.tolist(), strict=True)) == {w: all_[w] for own in want for w in own}


def test_rows_of_a_task_in_pieces(monkeypatch):
    """The texts, words and counted keys of a task are the same, however it is cut into pieces, lots and chunks."""
    texts = [t for t in ODD if t != "x" * 3000] * 20
    held = [i % 4 == 1 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(held), pa.array(texts)], ["uid", "doc_id", "held_out", "text"])
    common = pa.array([b"ab", b"a"], pa.large_binary()), np.array([True, False]), np.array([-1.0, -2.0])
    running = [ctw_text.running(ctw.tokens((t or "").encode())) for t in texts]
    want = Counter()
    for t, o in zip(running, held, strict=True):
        for k in ctw_text.keys_of([t]).tolist():
            want[k] += not o
    for cut in ((20_000_000, 3_000_000, 8_000_000), (2000, 300, 700), (1, 1, 1), (5000, 10, 10)):
        for name, size in zip(("CHUNK", "SLICE", "SORTED"), cut, strict=True):
            monkeypatch.setattr(ctw_text, name, size)
        rows = [r for b in gather(monkeypatch, batch, common)() for r in b.to_pylist()]
        about = {r["uid"]: r for r in rows if r["part"] == -1}
        rest = {(r["uid"], r["data"]): r["n"] for r in rows if r["part"] == -2}
        for i, t in enumerate(texts):
            own = Counter(ctw.tokens((t or "").encode()))
            r = about[i]
            assert (r["doc_id"], r["held_out"], r["n"], r["known"], r["base"]) == (i, held[i], own.total(), own[b"ab"], -own[b"ab"] - 2.0 * own[b"a"])
            assert {w: n for (u, w), n in rest.items() if u == i} == {w: n for w, n in own.items() if w not in (b"ab", b"a")}
        slices = sorted((r for r in rows if r["part"] == -3), key=lambda r: (r["chunk"], r["uid"]))
        assert b"".join(pa.decompress(r["data"], decompressed_size=r["doc_id"], codec="zstd", asbytes=True) for r in slices) == b"".join(running)
        got = Counter()
        for r in rows:
            if r["part"] >= 0:
                key = ctw_text._keys(r["data"], r["n"]).tolist()
                assert len(key) == len(set(key))
                got.update(dict(zip(key, ctw_text.unpacked(r["counts"], r["n"], np.uint32).tolist(), strict=True)))
        assert got == want and got.keys() == want.keys()


def test_words_and_keys_cost_little_beside_their_spelling(spark, monkeypatch):
    """CPU time of the two passes over the texts, against that of cutting the same texts into words."""
    texts = [r.text for r in documents(spark).select("text").collect()] * 8
    column = pa.array(texts)
    raw = [(t or "").encode() for t in texts]
    common = [w for w, _ in Counter(w for t in raw for w in ctw.tokens(t)).most_common(2000)]
    common = pa.array(common, pa.large_binary()), np.ones(len(common), bool), np.full(len(common), -1.0)
    held = np.zeros(len(texts), bool)
    ids = pa.array(range(len(texts)), pa.int64())
    run = gather(monkeypatch, pa.RecordBatch.from_arrays([ids, ids, pa.array(held), column], ["uid", "doc_id", "held_out", "text"]), common)

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    one = least(lambda: [Counter(ctw.tokens(t)) for t in raw])
    both = least(lambda: ctw_text.counted(held, column)) + least(run)
    print(f"{both / one:.2f} times")
    assert both < 5.5 * one  # a text at a time, with rows as tuples: 7 to 8
