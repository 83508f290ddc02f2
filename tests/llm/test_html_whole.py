import pytest

from tests.llm.test_pages_vectors import page, pages
from tierloom.llm import html_text


@pytest.mark.parametrize("copies", [4, 5, 9])
def test_copies_of_a_page_keep_its_own_text(spark, copies):
    rows = [(i, f"http://h.example/{i}", page(f"<h1>Title {i}</h1><p>Body {i}</p><div class=more>Read on</div>")) for i in range(8)]
    rows += [(100 + i, f"http://h.example/{100 + i}", page("<h1>Other</h1><p>It</p><blockquote>Q</blockquote><div class=more>Read on</div>")) for i in range(copies)]
    got = {r.page_id: r.text for r in html_text.extracted(pages(spark, rows).repartition(3)).collect()}
    assert {got[100 + i] for i in range(copies)} == {"Other It Q"} and {got[i] for i in range(8)} == {f"Title {i} Body {i}" for i in range(8)}


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article class='post category-legal'><p>in</p></article><p>out", "in"),
        ("<article class='share-enabled'><p>in</p></article>", "in"),
        ("<article id='search-result-3'><p>in</p></article>", "in"),
        ("<article class='comment'><p>in</p></article>", "in"),
        ("<article class='post has-comments'><p>in</p><section id='comments'><article class='comment-body'>out</article></section></article>", "in"),
        ("<article><p>in</p></article><section id='comments'><article class='comment-body'>out</article></section>", "in"),
        ("<article hidden><p>out</p></article>", ""),
        ("<article><p>in</p><section id='discussion'><p>also in</p></section></article>", "in also in"),
        ("<div class='with-sidebar'><p>all of the page</p></div>", "all of the page"),
        ("<div class='with-sidebar'><p>all of the page</p><div class='sidebar'>out, whatever its size may be</div></div>", "all of the page"),
        ("<p>a long text that is the page's own</p><div class='promo-box'>out</div>", "a long text that is the page's own"),
        ("<article><p>in</p><div class='comment-list'><p>out, though it is most of the text</p></div></article>", "in"),
    ],
)
def test_names_do_not_drop_what_is_the_page_itself(html, text):
    assert html_text.main_text(html) == text
