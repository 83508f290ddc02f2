import random
import time

from tests.llm.cases import SMALL
from tests.llm.test_pages_vectors import page, pages
from tierloom.llm import html_text
from tierloom.operators.tables import table


def plain(i, k):
    """A page without any telling tag, class or id: only the slots say what is its own."""
    body = "".join(f"<div class=k>Text {i} {j} of the page</div>" for j in range(k))
    return f"<body><div class=a><span>Home</span> <span>About us</span></div><div class=b><div class=t>Title {i}</div>{body}</div><div class=c>All rights</div></body>"


def test_slots_decide_where_no_name_tells(spark):
    rows = [(i, f"http://h.example/{i}", plain(i, 1 + i % 3)) for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extracted(pages(spark, rows).repartition(2)).collect()}
    assert got == {i: " ".join([f"Title {i}", *(f"Text {i} {j} of the page" for j in range(1 + i % 3))]) for i in range(3)}
    changed = [i for i, _, h in rows if html_text.main_text(h) != got[i]]
    assert changed == [0, 1, 2]  # without the wrapper, the menu and the last line would be part of each


def test_near_copies_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<p>A long paragraph that both pages have, word for word</p><p>Seen {i}</p>")) for i in range(2)]
    got = {r.page_id: r.text for r in html_text.extracted(pages(spark, rows)).collect()}
    assert got == {i: f"A long paragraph that both pages have, word for word Seen {i}" for i in range(2)}


def test_deep_nesting(spark):
    n = 100_000
    began = time.time()
    assert html_text.main_text("<div>" * n + "in" + "</div>" * n + "<p>after") == "in after"
    assert time.time() - began < 30
    rows = [(i, "http://h.example/", "<i><div><b>" * n + f"in {i}" + "</b></div></i>" * n + f"<p>more {i}") for i in range(2)]
    assert {r.text for r in html_text.extracted(pages(spark, rows)).collect()} == {"in 0 more 0", "in 1 more 1"}
    assert html_text.main_text("<ul><li>" * 3000 + "x<li>y") == "x y"


def brute(x, y):
    """The length of the longest common subsequence."""
    if not x or not y:
        return 0
    return 1 + brute(x[1:], y[1:]) if x[0] == y[0] else max(brute(x[1:], y), brute(x, y[1:]))


def test_alignment_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        x, y = (rng.choices("abc", k=rng.randrange(8)) for _ in range(2))
        pairs = html_text._pairs(x, y)
        assert len(pairs) == brute(x, y) and all(x[i] == y[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        a, b = ([[k, False, False, 1, []] for k in row] for row in (x, y))
        out = html_text._aligned(a, b, 1)
        assert [k[0] for k in out if not k[1]] and len(out) == len(x) + len(y) - len([k for k in out if not k[1]]) if x and y and x[0] == y[0] else True


def test_long_rows_of_children_align(monkeypatch):
    monkeypatch.setattr(html_text, "CELLS", 10)
    assert html_text._pairs(list("abcab"), list("xaybcb")) == [(0, 1), (1, 3), (2, 4), (4, 5)]


def test_the_wrapper_matches_what_it_was_made_of(spark):
    """On the given pages every host's texts vary: templates are empty, and the pages' texts are those without a wrapper."""
    rows = table(spark, SMALL, "pages")
    html = {r.page_id: r.html for r in rows.collect()}
    got = {r.page_id: r.text for r in html_text.extracted(rows).collect()}
    assert got == {i: html_text.main_text(h or "") for i, h in html.items()}
