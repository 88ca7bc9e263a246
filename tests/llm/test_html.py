"""Main text: the scan decides, on the registered query and on hard markup."""

import html
import re
import time

import pytest

from gradeloom.llm import html_extract as H


def articles(rows):
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        yield r, "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_registered_query_equals_articles(spark, sf):
    from gradeloom.llm import queries

    want = {r.page_id: (r.url, t, len(t)) for r, t in articles(spark.read.parquet(f"{sf}/pages.parquet").collect())}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.QUERIES["op1_html_extract"](spark, sf).collect()}
    assert got == want


def test_the_run_decides_and_not_the_names(spark, sf):
    """With the whole page for the best run every page changes; without any weight on marks none does."""
    weights = H.default_weights()
    unmarked = weights | {"w:out": 0.0, "w:clear": 0.0}
    for r, text in articles(spark.read.parquet(f"{sf}/pages.parquet").collect()):
        assert H.extract(r.html) == H.extract(r.html, unmarked) == text
        assert H.extract(r.html, choose=lambda scores: (0, len(scores))) != text


def test_best_run_of_pages_equals_brute_force(spark, sf):
    weights = H.default_weights()
    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(8).collect():
        scores = [round(s, 3) for s in H.score(H.Page(r.html[:3000]), weights)]
        a, z = H.region(scores)
        assert sum(scores[a:z]) == pytest.approx(max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)))


WORDS = "these are the words of a paragraph that is long enough"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<nav><a>x</a></nav><article><h1>Title</h1><p>{WORDS}</p><table>" + "".join(f"<tr><td>{i}</td><td>v{i}</td></tr>" for i in range(40)) + "</table><p>after it</p></article><footer>end</footer>", f"Title\n{WORDS}\n" + "\n".join(f"{i}\nv{i}" for i in range(40)) + "\nafter it"),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>", "let x=2 be"),
        (f'<nav><a>m</a></nav><div class="form-factor"><p>{WORDS}</p><p>two</p></div><footer>f</footer>', f"{WORDS}\ntwo"),
        (f'<article class="has-sidebar"><p>{WORDS}</p><p class="notice">we note</p><p>last</p></article>', f"{WORDS}\nlast"),
        (f'<body><div class="menu"><a>a</a> <a>b</a></div><h1>Heading one</h1><p>{WORDS}</p><div class="ad">' + "buy " * 60 + f"</div><p>{WORDS}</p><div class='footer'>all rights</div></body>", f"Heading one\n{WORDS}\n{WORDS}"),
        (f"<body><div><a>m</a></div><div><div><h1>Heading</h1><p>{WORDS}</p><p>{WORDS}</p></div><div><p>{WORDS}</p></div></div><div><a>m</a></div></body>", f"Heading\n{WORDS}\n{WORDS}\n{WORDS}"),
        (f'<div class="gdpr-notice"><p>{WORDS}</p></div><article><p>{WORDS}</p></article><div class="user-comments"><p>{WORDS}</p></div><div class="blog-sidebar"><p>{WORDS}</p></div>', WORDS),
        (f'<nav><a>m</a></nav><div class="main-content sidebar-right"><h1>Title</h1><p>{WORDS}</p></div>', f"Title\n{WORDS}"),
        (f'<header>site</header><div class="content"><header><h1>Big title</h1></header><p>{WORDS}</p></div>', f"Big title\n{WORDS}"),
        (f"<form id=aspnet><nav><a>m</a></nav><main><h1>T</h1><p>{WORDS}</p></main></form>", f"T\n{WORDS}"),
        (f"<article><p>{WORDS}</p></article><section class=comments><article class=comment><p>{WORDS}</p></article></section>", WORDS),
        (f"<article><p>{WORDS} <a href=x>see this</a></p><p><a href=y>only a link</a></p><p>end</p></article>", f"{WORDS} see this\nonly a link\nend"),
    ],
)
def test_markup(page, text):
    assert H.extract(page) == text


def site(main):
    return f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>{main}<footer>end of the page</footer></body></html>'


def links(n, word="link"):
    return "<ul>" + "".join(f'<li><a href="/{i}">{word} {i}</a></li>' for i in range(n)) + "</ul>"


LIST, LATER = "\n".join(f"link {i}" for i in range(60)), "and this is the end of what is told in the last paragraph"


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ('<div class="content">', "</div>"), ("<main>", "</main>"), ("<div>", "</div>")])
@pytest.mark.parametrize(
    "main, text",
    [
        (f"<h1>Heading</h1>{links(10)}<p>{WORDS}</p>", "Heading\n" + "\n".join(LIST.split("\n")[:10]) + f"\n{WORDS}"),
        (f"<p>{WORDS}</p>{links(60)}<p>{LATER}</p>", f"{WORDS}\n{LIST}\n{LATER}"),
        (f"<p>{WORDS}</p><p>{LATER}</p><h3>More</h3><ol><li>one <a href=x>x</a></li><li>two</li></ol>", f"{WORDS}\n{LATER}\nMore\none x\ntwo"),
    ],
)
def test_lists_of_links_in_an_article_stay(open_, close, main, text):
    assert H.extract(site(open_ + main + close)) == text


LONGER = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize("between", ["<aside>advert words</aside>", "<form><label>advert</label><input name=q></form>", f"<nav>{links(4, 'advert')}</nav>", '<div class="ads">advert, buy it</div>', '<div class="cookie-notice"><p>advert of cookies</p></div>'])
@pytest.mark.parametrize("shell", ["article", "div", "section", "div class=content"])
def test_an_article_in_several_parts_is_one_without_what_stands_between(between, shell):
    parts = [f"<{shell}><p>{t}</p></{shell.split()[0]}>" for t in (LONGER, LONGER + " last")]
    assert H.extract(site(between.join(parts))) == f"{LONGER}\n{LONGER} last"


@pytest.mark.parametrize("shell", ["article", "main", "div class=content"])
def test_readers_words_in_elements_without_names_go(shell):
    said = "".join(f"<div><p>reader {i}</p><p>so true, thanks a lot for this {i}</p></div>" for i in range(5))
    page = site(f"<{shell}><p>{WORDS}</p><p>{LATER}</p></{shell.split()[0]}><div><h3>What readers say</h3>{said}</div>")
    assert H.extract(page) == f"{WORDS}\n{LATER}"
    at_length = "".join(f"<div><p>reader {i}</p><p>{WORDS} {LATER} {LONGER}</p></div>" for i in range(3))
    assert H.extract(page.replace(said, at_length)) == f"{WORDS}\n{LATER}"
    assert H.extract(site(f"<div><p>{LONGER}</p><p>{LONGER} x</p></div><div>{said}</div>")) == f"{LONGER}\n{LONGER} x"


def test_a_menu_is_one_if_it_has_links():
    dishes = '<ul class="menu"><li>soup of the day</li><li>fish and bread</li></ul>'
    assert H.extract(site(f"<article><p>{WORDS}</p>{dishes}<p>{LATER}</p></article>")) == f"{WORDS}\nsoup of the day\nfish and bread\n{LATER}"
    pages = links(5, "advert").replace("<ul>", '<ul class="menu">')
    assert H.extract(site(f"<article><p>{WORDS}</p>{pages}<p>{LATER}</p></article>")) == f"{WORDS}\n{LATER}"


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "<p>some text</p>", "<b>" * 50_000 + "<p>some text</p>" * 20_000, "<i></b>" * 100_000 + "<p>some text</p>", "<table><tr><td>" * 50_000 + "some text", "<p " * 100_000 + ">some text"])
def test_hard_pages_take_linear_time(page):
    began = time.time()
    text = H.extract(page)
    assert time.time() - began < 20 and (text == "" or text.startswith("some text"))


def test_very_long_page():
    body = "".join(f"<p>word{i} and more words here</p>" for i in range(60_000))
    assert H.extract(f"<nav><a>a</a></nav><article>{body}</article><footer>x</footer>").count("\n") == 59_999
