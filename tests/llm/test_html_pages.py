import random

import pytest

from crossload.llm import html_text

W = {"p": -0.1, "div": -0.3, "a": -3.0, "li": -0.3, "ul": -0.5, "td": -0.1, "tr": -0.1, "table": -0.1, "em": -0.1, "article": -0.1, "section": -0.2}
PAGES = [
    ("<div class='page has-sidebar'><p>Real text of the page here.</p></div>", "Real text of the page here."),
    ("<article class='post comments-open'><p>Real text of the page.</p></article>", "Real text of the page."),
    ("<article><section class='no-banner'><p>One two three.</p></section><p class='related-work'>Four five six.</p></article>", "One two three. Four five six."),
    ("<article><p>Alpha beta one.<p class='ad'>Buy now<p>Gamma delta two.</article>", "Alpha beta one. Gamma delta two."),
    ("<article><ul><li>Alpha one two three<li class='promo'>Buy<li>Gamma four five six</ul></article>", "Alpha one two three Gamma four five six"),
    ("<main><article><p>First of two.</p></article><article><p>Second of two.</p></article></main>", "First of two. Second of two."),
    ("<body class='sidebar'><div class='sidebar'><p>All of the page is laid out so.</p></div></body>", "All of the page is laid out so."),
    ("<nav><a>Home</a></nav><article><p>Text <em>with</em> mark&amp;up.</p><aside>Aside</aside><p>More.</p></article><div class='comments'><p>I like it so very much.</p></div>", "Text with mark&up. More."),
    ("<aside><article><p>A card on the side.</p></article></aside><article><p>The article.</p></article>", "The article."),
    ("<article class='comment'><p>A reader said this and that.</p></article><article><p>The article.</p></article>", "The article."),
    ("<article><table><tr><td>One cell<td class='ad'>Buy<td>two cells<tr><td>next row</table></article>", "One cell two cells next row"),
    ("<article><div class='ad'>Buy <p>this <p>now</div><p>Text goes on.</article>", "Text goes on."),
    ("<article><p>Never closed", "Never closed"),
    ("<p>Repeated</p>" * 2, "Repeated Repeated"), ("", ""), (None, ""), ("<div class=ad>", ""), ("plain", "plain"),
    ("<article><p>" + "word " * 200_000 + "</p></article>", ("word " * 200_000).strip()),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_pages(page, want):
    assert html_text.extract(page, W) == want


def test_scan_finds_the_best_run():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randrange(12))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        most = max([0.0, *sums.values()])
        best, start, end = html_text.best_run(scores)
        assert best == most and (sum(scores[start:end]) == most)
        assert not most or end == min(b for (a, b), s in sums.items() if s == most)


def test_query_gives_the_article_of_every_page(spark):
    """The given pages mark their article; its text, without what stands apart in it, is the expected result."""
    import re
    import html

    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op7_html_extraction(spark, path).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        body = re.search(r"(?is)<article\b[^>]*>(.*?)</article>", page or "")
        assert body
        text = re.sub(r"(?is)<(script|style|aside|form|nav|figure)\b.*?</\1>|<(div|p) class=[\"']?ad\b.*?</\2>|<!--.*?-->", " ", body[1])
        text = re.sub(r"(?is)</?(?:p|h\d|div|ul|ol|li|br|blockquote|section|table|tr|td)\b[^>]*>", " ", text)
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", text)).split())
        assert got[k] == (text, len(text)), k


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "<p>a b</p>", "old", 9, "kept")], "page_id long, html string, text string, n_chars long, weights string")
    assert [tuple(r) for r in html_text.extract_text(df).collect()] == [(1, "<p>a b</p>", "a b", 3, "kept")]
    assert html_text.extract_text(df.limit(0)).count() == 0
