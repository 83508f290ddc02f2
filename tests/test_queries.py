"""Every query against its SQL in DuckDB, over the smallest tables; and the shape of those without SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tierloom.operators import dedup
from tierloom.operators.search import best
from tierloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def value(v):
    """Whole numbers exactly; other numbers to six digits; all that is missing alike."""
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float | np.floating) and np.isnan(v)):
        return "missing"
    if isinstance(v, float | np.floating) and not float(v).is_integer():
        return f"{v:.6g}"
    if isinstance(v, bool | np.bool_ | int | np.integer | float | np.floating):
        return str(int(v))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(value(v) for v in r) for r in zip(*(df[c].tolist() for c in cols), strict=True))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SMALL).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_near_duplicates_are_planted_ones(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    text = lambda seed, i: f"request 0a1b2c3d-0000-4000-8000-{i:012d} " + " ".join(words[(seed * 7 + j * j) % 16] + str(seed) for j in range(40)) + f" at 2024-01-0{i % 9 + 1}T10:00:00Z"
    made = [(f * 100 + i, text(f, i).upper() if i % 2 else text(f, i)) for f in range(6) for i in range(4)] + [(1000 + f, text(50 + f, 0)) for f in range(5)]
    got = dedup.near_clusters(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.cluster for r in got} == {d: d // 100 * 100 for d, _ in made if d < 1000}


def test_best_breaks_ties_by_id():
    scores, ids = np.array([1.0, 3.0, 3.0, 3.0, 2.0]), np.array([9, 8, 2, 5, 1])
    assert ids[best(scores, ids, 2)].tolist() == [2, 5] and ids[best(scores, ids, 9)].tolist() == [2, 5, 8, 1, 9]


def test_signatures_estimate_similarity(spark):
    a, b = "the same text " * 20, "the same text " * 19 + "but for its end"
    rows_ = spark.createDataFrame([(1, a), (2, b), (3, "nothing like it, at all: 12345 67890"), (4, "")], "id bigint, text string")
    got = {r.id: np.array(r.signature) for r in dedup.signatures(rows_).collect()}
    h = {i: set(dedup.shingle_hashes(t.encode()).tolist()) for i, t in ((1, a), (2, b), (3, "nothing like it, at all: 12345 67890"))}
    for i, j in ((1, 2), (1, 3)):
        assert abs((got[i] == got[j]).mean() - len(h[i] & h[j]) / len(h[i] | h[j])) < 0.15


def test_entry_points_work_with_and_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.setattr(e, "_llm", lambda: None)
    assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())
    assert e.entry(spark).count() == 1
