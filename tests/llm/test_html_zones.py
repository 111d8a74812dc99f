"""Articles within forms, layout classes and heads that are not closed."""

from seqloom.llm import html_text
from seqloom.llm.html_text import blocks, zones

ARTICLE = "<article><h1>T</h1><p>one</article>"


def test_a_head_left_open():
    head = "<html><head><meta charset=x><title>t</title><noscript><img src=x></noscript><script>a</script>"
    for page in (f"{head}<body>{ARTICLE}", f"{head}{ARTICLE}", f"{head}</head><body>{ARTICLE}"):
        assert blocks(page) == (["T", "one"], True)
    assert blocks(f"{head}<body><p>a") == blocks(f"{head} <b>a") == blocks(f"{head}a") == (["a"], False)
    assert blocks(f"{head}<noscript><link>") == ([], False)


def test_forms_and_classes_around_an_article():
    for around in ("form action=x", "form class=social", "div class='page no-comments'", "div id='social-main'", "div role=form", "section class='promo widget'", "div class='post comments-open has-ads'"):
        for page in (f"<body><{around}>{ARTICLE}</{around.split()[0]}>", f"<{around}><div class=menu>m</div><main>{ARTICLE}<form>f</form></main>"):
            assert blocks(page) == (["T", "one"], True), around
    for around in ("div class=comments", "nav", "footer", "div hidden", "div aria-hidden=true"):
        assert blocks(f"<{around}>{ARTICLE}</{around.split()[0]}><p>r") == (["r"], False)


def test_teasers_do_not_join_the_article():
    teaser = "<div class=related><article><p>teaser</p></article></div>"
    assert blocks(ARTICLE + teaser) == blocks(f"<form>{teaser}{ARTICLE}</form>") == (["T", "one"], True)


def test_without_text_in_an_article_the_page_is_undecided():
    assert blocks("<article> </article><div>x</div>") == (["x"], False)
    assert blocks("<form><p>x</p></form>") == blocks("<div class=page-widget><p>x</p></div>") == (["x"], False)
    assert blocks("<p>y</p><form><p>x</p></form>") == (["y"], False)


def test_comments_and_teasers_that_are_articles():
    assert blocks(ARTICLE + "<div id=discussion><article class=comment><p>c</article></div>") == (["T", "one"], True)
    assert blocks(ARTICLE + "<article class='post teaser'><p>t</article>") == (["T", "one"], True)
    assert blocks("<article><p>a<article class=comment>c</article><article class=card>d</article><p>b</article>") == (["a", "b"], True)
    assert blocks("<article class=teaser><p>only</article>") == (["only"], True)


def test_class_words_within_an_article_are_left_to_the_host():
    page = "<article><p>a<p class=related-work>b<div class=share-price>c</div><div class=notice>d</div><div class=ad>e</div><div class=cookie-notice>f</div><form>g</form><p>h</article>"
    assert zones(page) == ([("a", False), ("b", True), ("c", True), ("d", True), ("h", False)], True)


def test_the_host_decides_open_blocks_of_articles(spark):
    notice = " ".join(f"n{k}" for k in range(10))
    rows = [(i, "http://h.example/", f"<article><p>{notice} shared<p class=related-work>own{i} " + " ".join(f"u{i}x{k}" for k in range(9)) + f"<div class=notice>{notice}</div></article>") for i in range(4)]
    for n in (4, 2):
        got = {r.page_id: r.text.split("\n") for r in html_text.main_text(spark.createDataFrame(rows[:n], "page_id long, url string, html string")).collect()}
        assert all(t[0] == f"{notice} shared" and t[1].startswith(f"own{i} ") and t[2:] == ([] if n == 4 else [notice]) for i, t in got.items()) and len(got) == n


def test_broken_markup():
    assert blocks('<article><p class="abc>x</p><p>one</p></article>') == (["x", "one"], True)
    assert '"' not in "".join(blocks("<p class=\"abc>text")[0]) and blocks("<p class=\"abc>text") == (["text"], False)
    import time

    began = time.time()
    assert blocks("<div>" * 50_000 + "</b></section></p>" * 50_000 + "x")[0] == ["x"]
    assert blocks("<div><head>" * 50_000 + "x")[0] == ["x"]
    assert time.time() - began < 20
