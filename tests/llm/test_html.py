"""Blocks of small pages, host repetition, and odd rows."""

import pytest

from codeloom.llm.html import blocks, main_text


def article(page):
    return "\n\n".join(t for t, a, d in blocks(page) if a and not d)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>T</h1><p><b>One &amp; two<br><p>three\n four</p></article><footer>f</footer>", "T\n\nOne & two\n\nthree four"),
        ('<article>a<div hidden>b</div>c<span class="ad">d</span>e</article>', "a\n\nce"),
        ('<article class="comment">bad</article><article>good <a title="a>b" href=x>l</a></article>', "good l"),
        ("<main><p>m<aside>n</aside>o</main>", "m\n\no"),
        ("<article><header><h1>T</h1>by</header><p>x<script>'</p>'</script> y<!-- c --></article>", "T\n\nx y"),
        ("<article><ul><li>1<li>2</ul><p>a < b &lt;p&gt; &#233;</p></article>", "1\n\n2\n\na < b <p> é"),
        ("<article><p>open <b>bold", "open bold"),
        ("<div class='ad'><article>inside an advert</article></div>", ""),
        ('<div class="layout no-sidebar"><article>kept</article></div>', "kept"),
        ('<article class="post"><div class="content-with-sidebar">kept</div><div class="site-footer box">gone</div></article>', "kept"),
        ('<article><section class="related-work">kept</section><ul class="related-posts"><li>gone</ul></article>', "kept"),
        ('<article><div class="post-header"><h1>T</h1>by us</div><p id="ad-slot-3">gone</p><p class="has-ads">kept</article>', "T\n\nkept"),
        ('<article><p>a<div class="cookie-banner--dark">gone</div><p class="header">b</article>', "a"),
        ("<article></i><p>a</i> <b><i>b</b> c</i></p></b><p>d</div>e", "a b c\n\nd\n\ne"),
        ("<article><p><b><i><u><s>a<div>b</div>c</article>", "a\n\nb\n\nc"),
    ],
)
def test_article(page, text):
    assert article(page) == text


def test_host_repetition_and_odd_rows(spark):
    menu = "<div>Home News Sport Weather Contact us</div>"
    rows = [(i, "http://h.example/%d" % i, f"{menu}<div>{'abc'[i]} stands here alone</div>") for i in range(3)]
    rows += [(3, "http://other.example/", menu), (4, None, None), (5, "http://h.example/x", ""), (None, None, "<p>q</p>")]
    rows += [rows[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted(((r.id if r.id is not None else -1), r.text, r.n_chars) for r in main_text(df).collect())
    said = lambda c: f"{c} stands here alone"
    assert [g[1] for g in got] == ["q", said("a"), said("a"), said("b"), said("c"), "Home News Sport Weather Contact us", "", ""]
    assert all(g[2] == len(g[1]) for g in got)
    assert main_text(df.limit(0)).count() == 0


def test_tag_soup_takes_linear_time():
    import time

    for soup in ("<b></i>", "<i><b>", "</p></div>", "<p><b>", "<li><b></i>", "<div><i></div>", "<a <", "<table><tr><td><b>"):
        page = "<article>" + soup * (1_000_000 // len(soup)) + "</i>" * 50_000 + "x</article>"
        begun = time.process_time()
        assert article(page).endswith("x")
        assert time.process_time() - begun < 8


def test_headings_of_a_host_stay(spark):
    pages = [f"<article><h1>Dish {i}</h1><h2>Ingredients</h2><p>{i} eggs</p><h2>Method</h2><p>Stir {i} times</p><p>Print this</p></article>" for i in range(6)]
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    got = {r.id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Dish {i}\n\nIngredients\n\n{i} eggs\n\nMethod\n\nStir {i} times" for i in range(6)}
