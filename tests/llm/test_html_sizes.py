import random

import pytest

from tests.llm.test_html_wrappers import plain
from tests.llm.test_pages_vectors import page, pages
from tierloom.llm import html_text


def texts(spark, htmls):
    rows = [(i, f"http://h.example/{i}", h) for i, h in enumerate(htmls)]
    return [r.text for r in sorted(html_text.extracted(pages(spark, rows).repartition(2)).collect(), key=lambda r: r.page_id)]


def short(i):
    return f"<body><div class=a><span>Home</span> <span>About us</span></div><div class=b>N{i}</div><div class=c>All rights</div></body>"


@pytest.mark.parametrize("others", [[], [plain(7, 400)]])
def test_how_much_text_the_pages_have_decides_nothing(spark, others):
    """Slots with less text than the template; and the same pages beside a long one."""
    assert texts(spark, [short(i) for i in range(3)] + others)[:3] == ["N0", "N1", "N2"]


@pytest.mark.parametrize("links", [3, 64, 65, 500])
def test_menus_of_any_length_are_template(spark, links):
    menu = "<div class=a>" + "".join(f"<span>Link {j}</span>" for j in range(links)) + "</div>"
    assert texts(spark, [f"<body>{menu}<div class=b>Title {i}</div></body>" for i in range(3)]) == [f"Title {i}" for i in range(3)]


def test_near_copies_of_an_article_keep_it_whatever_its_length(spark):
    for body in ("A", "A long text " * 50):
        got = texts(spark, [page(f"<h1>Title</h1><p>{body}</p><span class=date>Seen {i}</span>") for i in range(2)])
        assert got == [f"Title {body.strip()} Seen {i}" for i in range(2)]


def test_an_article_that_all_pages_share_stays(spark):
    assert texts(spark, [page("<div>The same</div>", lead=f"Menu {i}") for i in range(3)]) == ["The same"] * 3


def test_alignment_does_not_depend_on_the_size_of_its_table(monkeypatch):
    rng = random.Random(3)
    rows = [[rng.choices("abcd"[: rng.randrange(1, 5)], k=rng.randrange(1, 40)) for _ in range(2)] for _ in range(300)]
    want = [html_text._pairs(x, y) for x, y in rows]
    monkeypatch.setattr(html_text, "CELLS", 0)
    assert [html_text._pairs(x, y) for x, y in rows] == want
    x, y = list("abcabc") * 2000, list("cab") * 3000
    assert len(html_text._pairs(x, y)) == len(y)
