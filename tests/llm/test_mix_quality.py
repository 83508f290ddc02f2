import re
from collections import defaultdict

from tests.llm.cases import SMALL, documents, hard
from tierloom.llm import mixing, quality
from tierloom.operators.tables import table


def targets(sizes):
    """sizes by source, None last: water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(3.0 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 3.0 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def check(spark, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    own = defaultdict(int)
    for r in rows:
        own[r.source] += size(r.text)
    want = targets(own)
    got = mixing.mixed(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in rows)
    assert got and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs).collect()), key=str)  # reruns agree
    by = defaultdict(lambda: [0, 0])
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        by[r.source_size, r.target][0] += r.taken
        by[r.source_size, r.target][1] = max(by[r.source_size, r.target][1], r.size)
    assert sorted({round(v, 6) for v in want.values()}) == sorted({round(t, 6) for _, t in by})
    for (_, target), (taken, largest) in by.items():
        assert abs(taken - target) <= largest + 1e-6
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r.copies for r in got)


def test_mix_against_brute_force(spark):
    check(spark, documents(spark))
    check(spark, hard(spark))


def test_mix_of_nothing(spark):
    assert mixing.mixed(hard(spark, empty=True)).count() == 0
    only_empty = hard(spark).filter("doc_id in (4, 5, 6)")
    assert {(r.target, r.taken) for r in mixing.mixed(only_empty).collect()} == {(0.0, 0)}


def test_quality_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == quality.is_held_out(r.doc_id) for r in got.values())
    held = [(got[x.doc_id], x.quality) for x in labels.collect() if got[x.doc_id].held_out]
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.93
    good, bad = [r.score for r, y in held if y], [r.score for r, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.98


def test_quality_does_not_see_held_out_labels(spark):
    docs, labels = documents(spark), table(spark, SMALL, "labels")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) AS quality", "toxic")
    assert sorted(map(tuple, quality.scored(docs, labels).collect())) == sorted(map(tuple, quality.scored(docs, turned).collect()))


def test_quality_of_hard_cases(spark):
    docs = hard(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (7, 5)], "doc_id bigint, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(hard(spark, empty=True), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
