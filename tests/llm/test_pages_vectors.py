import json
import re
from html import unescape

import numpy as np
import pytest

from tests.llm.cases import SMALL
from tierloom.llm import ann, html_text, url_filter
from tierloom.operators.tables import table


def page(article, lead="Menu", foot="Imprint"):
    return f"<html><head><title>T</title></head><body><nav><a href='/'>{lead}</a></nav><div class=x>Always here</div><article>{article}</article><footer>{foot}</footer></body></html>"


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.selectExpr("*", "'clash' AS host", "'clash' AS wrapper", "'clash' AS text", "'clash' AS n", "'clash' AS rule")


def test_main_text_of_given_pages(spark):
    got = html_text.extracted(table(spark, SMALL, "pages")).collect()
    html = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    assert len(got) == len(html)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = " ".join(unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", body))).split())
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>T</h1><p>one<b>two</b>  three<p>x<br>y</article>tail", "T onetwo three x y"),
        ("<div class='page has-sidebar'><main><p>in</p><aside>out</aside></main></div>", "in"),
        ("<article><p>in</p><section id='comments'><p>out</p></section><div class='ad'>out</div><form>out</form></article>", "in"),
        ("<nav>out<p>out", ""),
        ("<p>a &lt;b&gt; &#233;</p><script>if (a < b) x('</p>')</script><style>p{}</style><!-- <p>out</p> -->", "a <b> é"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<div hidden>out</div><div style='display: none'>out</div><p title='x>y'>in", "in"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_a_templates_own_text_is_found_over_pages(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<h1>Title {i}</h1><p>Body {i}</p><div class=more>Read on</div>")) for i in range(8)]
    got = html_text.extracted(pages(spark, rows).repartition(3)).collect()
    assert {r.text for r in got} == {f"Title {i} Body {i}" for i in range(8)}
    copies = [(i, "http://h.example/", page("<p>The same</p>")) for i in range(8)]  # nothing varies: nothing is the template's
    assert {r.text for r in html_text.extracted(pages(spark, copies)).collect()} == {"The same"}


def test_wrapper_is_a_regular_expression_without_unions():
    w = html_text.shape(page("<h1>A</h1><p>x</p>"))
    for other in ("<h1>B</h1><p>y</p><p>z</p>", "<p>only</p>", "<h1>C</h1><p>x</p><dl><dt>a<dd>b<dt>c<dd>d</dl>"):
        w = html_text._merged(w, html_text.shape(page(other)))
    assert "( <h1> #TEXT </h1> )? ( <p> #TEXT </p> )+" in html_text.expression(w)
    assert json.loads(json.dumps(w)) == w


def test_hard_pages(spark):
    rows = [(1, None, page("<p>x</p>")), (2, "no host", None), (None, "http://a/", ""), (4, "http://a/", page("<p>" + "long " * 50000 + "</p>")), (4, "http://a/", page("<p>y</p>"))]
    got = html_text.extracted(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 1), ("2", 0), ("4", 1), ("4", 249999), ("None", 0)]
    assert html_text.extracted(pages(spark, rows).limit(0)).count() == 0


def test_urls(spark):
    rows = [
        ("http://EXAMPLE.com/en/71?x#y", "example.com", "/en/71", "example.com/en/7", "allow"),
        ("https://a.com/en/", "a.com", "/en/", "com/en/", "block"),
        ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        ("http://casino.net/de/", "casino.net", "/de/", "net/de/", "allow"),
        ("http://casino.net/fr/", "casino.net", "/fr/", None, "block"),
        ("http://casinorama.net/fr/", "casinorama.net", "/fr/", None, "allow"),
        ("http://a.org/free", "a.org", "/free", None, "allow"),
        ("http://a.org/free/free", "a.org", "/free/free", None, "allow"),
        ("http://a.org/free?deals", "a.org", "/free", None, "block"),
        ("http://a.org?es/", "a.org", "", None, "allow"),
        ("a.org/es/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    got = url_filter.judged(pages(spark, [(i, r[0], "") for i, r in enumerate(rows)])).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [r[1:] for r in rows]
    assert url_filter.judged(pages(spark, [(1, "x", "")]).limit(0)).count() == 0


def test_url_hits_against_brute_force(spark):
    a = url_filter.automaton()
    for r in table(spark, SMALL, "pages").collect():
        near = lambda words, u=r.url.lower(): sum(bool(re.search(f"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", u)) for w in words)
        assert url_filter.hits(r.url, a) == (near(url_filter.STRICT), near(url_filter.SOFT))


def brute_nearest(rows, k=10, every=100):
    """Per row whose id ``every`` divides: its id, and the distances and ids of the k nearest other rows."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = []
    for at in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((ids, d))[: k + 1] if j != at][:k]
        out.append((int(ids[at]), [(float(d[j]), int(ids[j])) for j in near]))
    return sorted(out)


def test_nearest_recall_and_scores_where_few_rows_are_ranked_exactly(spark):
    """At 50,000 rows a query's candidates are under one in a hundred of them; and no row depends on how the table is spread."""
    rows = table(spark, "/root/testdata/check_l", "embeddings")
    all_ = [(r.vec_id, r.embedding) for r in rows.collect()]
    assert ann.DEPTH * 100 < len(all_)
    want = dict(brute_nearest(all_))
    got = ann.nearest(rows).collect()
    score = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(i, j) in score for i, near in want.items() for _, j in near]
    assert np.mean(hits) >= 0.9
    assert all(abs(score[i, j] - s) < 1e-12 for i, near in want.items() for s, j in near if (i, j) in score)
    for i in want:
        own = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r.score, r.vec_id))


def test_nearest_does_not_depend_on_partitions(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = [sorted(map(tuple, ann.nearest(r, depth=50).collect())) for r in (rows.coalesce(1), rows.repartition(7), rows.repartition(3, "label"))]
    assert got[0] == got[1] == got[2]


def test_nearest_of_repeated_ids_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(0, 3, 4) + 1]) for i in rng.integers(0, 12, 60) * 25]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)).collect()
    want = [(i, r, j, s) for i, near in brute_nearest(rows) for r, (s, j) in enumerate(near, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_nearest_of_many_copies_takes_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0, float(i % 3 == 0)]) for i in range(1, 901)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5), depth=50).collect()
    assert sorted(map(tuple, got)) == sorted((i, r, j, s) for i, near in brute_nearest(rows) for r, (s, j) in enumerate(near, 1))


def test_nearest_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 2.0]), (8, [1.0]), (100, [2.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'clash' AS code", "'clash' AS norm", "'clash' AS score", "'clash' AS rank", "'clash' AS uid")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df).collect())
    far = 1.414214
    assert got == sorted([(0, 1, 0, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 2, 1.0), (0, 5, 100, 1.0)] * 2 + [(100, 1, 0, 1.0), (100, 2, 0, 1.0), (100, 3, 1, far), (100, 4, 2, far), (100, 5, 2, far)])
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id = 3")).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    books = ann.Codebooks(x, 4, 32)
    err = []
    for beam in (1, 8):
        codes, norms = books.encode(x, beam)
        y = sum(books.books[m][codes[:, m]] for m in range(4))
        assert np.allclose(norms, (y**2).sum(axis=1), rtol=1e-3, atol=1e-3)
        err.append(((x - y) ** 2).sum(axis=1).mean())
    assert err[1] <= err[0]


@pytest.mark.parametrize("kind", ["sizes", "groups"])
def test_nearest_where_the_codes_do_not_tell_neighbours_apart(spark, kind):
    """Vectors of very different sizes, and groups much smaller than what the codes leave: of the 20 nearest by code, few are true neighbours."""
    rng, n = np.random.default_rng(4), 3000
    x = rng.normal(size=(n, 32)) * (np.exp(2 * rng.normal(size=(n, 1))) if kind == "sizes" else 1)
    if kind == "groups":
        x[::2] = rng.normal(size=(3, 32))[rng.integers(0, 3, n // 2)] + 1e-3 * rng.normal(size=(n // 2, 32))
    all_ = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    got = ann.nearest(spark.createDataFrame(all_, "vec_id bigint, embedding array<float>").repartition(3), depth=20).collect()
    want = [(i, r, j) for i, near in brute_nearest(all_) for r, (_, j) in enumerate(near, 1)]
    assert np.mean([w in {(r.query_id, r.rank, r.vec_id) for r in got} for w in want]) >= 0.99
