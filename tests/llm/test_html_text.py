import re

import duckdb
import numpy as np
import pytest

from convene.llm import html_text, queries

MENU = "".join(f'<li><a href="/{i}">Entry number {i} of the menu</a></li>' for i in range(8))
BODY = "<h1>A title</h1><p>First &amp; second\n  words of the long paragraph, with <b>bold</b> and <a href='/x'>a link</a> inside it.</p><p>Short.<br>Next line"
WANT = "A title First & second words of the long paragraph, with bold and a link inside it. Short. Next line"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul>{MENU}</ul></nav><article>{BODY}</article><footer>&copy; all the rest of the site, with many words in it</footer>",
        f"<BODY><div class='site-header'><p>Welcome to a site with a long greeting to all of its readers</p></div><div id=main>{BODY}</div><div class='sidebar'><p>A sidebar with quite some text about other things</p></div>",
        f"<div><ul>{MENU}</ul></div><main>{BODY}</main><div id='comments'><p>A reader says many things about this article, at length.</p></div>",
        f"<div role=navigation><p>Some words that lead elsewhere</p></div><div>{BODY}</div><form><p>Your name please, and your address</p><textarea>text</textarea><input></form>",
        f"<script>var a = '<p>not text</p>';</script><div class='cookieNotice'><p>We use cookies to make this site work for you</p></div><!-- <p>comment of many words</p> --><article>{BODY}</article><p hidden>never seen</p>",
        f"<div class='layout no-sidebar has-comments'>{BODY}</div><div class='ad2'>Another thing that you ought to buy, cheap</div>",
        f"<article>{BODY}<aside>An aside that is not part of the article's text</aside><div class=\"ad\">Buy this thing now, it is very cheap</div></article>",
    ],
)
def test_furniture_goes(page):
    assert html_text.extract(page) == WANT


def test_edges():
    assert html_text.extract(None) == "" and html_text.extract("") == "" and html_text.extract("<nav>menu</nav>") == ""
    assert html_text.extract("<p>Les.") == "Les."
    assert html_text.extract("plain text & no markup < 3") == "plain text & no markup < 3"
    assert html_text.extract("<p>a<b>c</b>d</p><p>e&#233;&nbsp;f&lt;") == "acd eé f<"
    assert html_text.extract("<p>cut <a href='x") in ("cut", "cut ")
    assert html_text.extract("<article><p>one<script>x</article>") == "one"
    assert html_text.extract("<p title=it's id='a>b'>one</p><p>two's</p>") == "one two's"
    many = "<p>" + "word " * 20 + "</p>"
    assert len(html_text.extract(many * 5000).split()) == 100000


def test_test_pages(spark):
    """On the test pages the main text is the article's blocks."""
    rows = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries.op3_html(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    import html
    import re

    for page_id, page in rows:
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inner)]
        assert got[page_id].text == " ".join(b for b in blocks if b)
        assert got[page_id].n_chars == len(got[page_id].text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>x</p>", 2), (1, "u", None, 1)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_text.extract_pages(df).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1)]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_links_of_the_article_stay():
    link = "<a href='/x'>{}</a>"
    listed = "".join(f"<li>{link.format(f'Item {i}')}</li>" for i in range(5))
    page = f"<article><h1>{link.format('Linked title')}</h1><p>Words of the first part, which is long enough to be main text.</p><h2>{link.format('Section')}</h2><ul>{listed}</ul><p>Words of the second part, which is long enough as well, by far.</p><p>{link.format('Source')}</p></article>"
    want = "Linked title Words of the first part, which is long enough to be main text. Section Item 0 Item 1 Item 2 Item 3 Item 4 Words of the second part, which is long enough as well, by far. Source"
    assert html_text.extract(page) == want
    assert html_text.extract(page.replace("<article>", f"<ul>{MENU}</ul><article><nav>{link.format('Home')}</nav>")) == want
    body = f"<p>Words of the first part, long enough.</p><h2>{link.format('Section')}</h2><p>Words of the second part.</p>"
    assert html_text.extract(f"<ul>{MENU}</ul><div>{body}</div><ul>{MENU}</ul>") == "Words of the first part, long enough. Section Words of the second part."
    assert html_text.extract(f"<main><ul>{MENU}</ul>{body}</main>") == "Words of the first part, long enough. Section Words of the second part."
    assert html_text.extract("<article><p>one <button>Press</button> two</p></article>") == "one two"


@pytest.mark.parametrize("name", ["article", "main"])
def test_short_parts_of_the_article_stay(name):
    share, body = "".join(f"<li>Share {i}</li>" for i in range(3)), "Words of a long body, " * 30
    page = f"<p>Elsewhere</p><{name}><h1>Short title</h1><ul class=share>{share}</ul><p>{body}</p><ul class=share>{share}</ul><p>The end.</p></{name}><p>Elsewhere</p>"
    assert html_text.extract(page) == f"Short title {body.strip()} The end."


def test_passages_by_brute_force():
    """Sums, surge and dive points by loops over windows."""
    rng = np.random.default_rng(3)
    w = html_text.WINDOW
    for _ in range(3000):
        x = np.where(rng.random(n := rng.integers(0, 30)) < 0.4, 0, np.round(rng.random(n) * rng.choice([3, 50, 300]), 1))
        surge, low = rng.choice([1e-6, 5, 40]), 1e-6
        low = min(surge, rng.choice([1e-6, 4]))
        windows = [sum(x[max(0, i - w + 1) : i + 1]) for i in range(n + w - 1)]
        want, i = set(), 0
        while i < len(windows):
            if windows[i] < low:
                i += 1
                continue
            begin = i
            while i < len(windows) and windows[i] >= low:
                i += 1
            if max(windows[begin:i]) >= surge:
                want |= {k for k in range(max(0, begin - w + 1), min(n, i)) if x[k] > 0}
        assert set(np.flatnonzero(html_text.passages(x, surge, low))) == want


def unnamed(page):
    """A page whose names say nothing: plain divs, classes without a meaning."""
    page = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page)
    return page.replace('class="ad"', 'class="zq1"')


def test_windows_decide(monkeypatch):
    """On pages without article elements or known names the windows find the text; without windows, all is kept."""
    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    right = sum(html_text.extract(unnamed(page)) == html_text.extract(page) for (page,) in rows)
    kept = [html_text.extract(page) for (page,) in rows]
    monkeypatch.setattr(html_text, "passages", lambda weights, surge, low: np.ones(len(weights), bool))
    changed = sum(html_text.extract(page) != text for (page,), text in zip(rows, kept))
    assert right >= 0.9 * len(rows) and changed == len(rows), (right, changed)


def test_plain_pages():
    body = "".join(f"<p>Paragraph {i} of the text, with enough words that it is plainly one of the article's own paragraphs.</p>" for i in range(6))
    linked = f"<h2><a href='/t'>Linked title here</a></h2>{body}<p><a href='/s'>A paragraph that is one link to its source</a></p>"
    want = html_text.extract(f"<article>{linked}</article>")
    assert want.startswith("Linked title here Paragraph 0") and want.endswith("to its source")
    for page in (f"<div class=x><ul>{MENU}</ul></div><div><div>{linked}</div></div><div class=y><p>Some words at the end</p></div>", f"<table><tr><td>{MENU}</td></tr></table><section>{linked}</section><div><span>Words of a foot</span></div>"):
        assert html_text.extract(page) == want
    assert html_text.extract('<article><p id="share-prices">Prices of shares rose.</p><div class="related-work"><p>Work that is related.</p></div></article>') == "Prices of shares rose. Work that is related."


def test_very_long_page():
    page = "<article>" + "<p>one two three</p>" * 200_000 + "</article>"
    assert len(html_text.extract(page)) == 200_000 * 14 - 1
