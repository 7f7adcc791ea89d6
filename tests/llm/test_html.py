import html
import re

import pytest

from tallyweave.llm import html_text
from tallyweave.llm.queries import op6_html_text
from tallyweave.llm.shared import read_table

PAGES = {
    "<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>Head &amp; more</h1><p>One\n two <b>bold</b>text.</p><p>Two&nbsp;x</p></article><footer>Foot</footer></body></html>": "Head & more\nOne two boldtext.\nTwo x",
    "<main><p>a<script>var x = '<p>no</p>';</script>b</p><style>p{}</style><aside>s</aside><ul><li>one<li>two</ul></main>": "ab\none\ntwo",
    "<body><div class='cookie-notice'>We use cookies</div><p>Text &lt;3 &#233; &#x65E5;</p><div id=comments><p>nice!</p></div></body>": "Text <3 é 日",
    "<p>unclosed<p>paragraphs<div>inner</div>after": "unclosed\nparagraphs\ninner\nafter",
    "<p>a<br>b</p><!-- no <p>x</p> --><p hidden>h</p><form><p>f</p></form>": "a b",
    "": "",
    None: "",
    "plain text only": "plain text only",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "<article><p>" + "long " * 20_000 + "end</p></article>": "long " * 20_000 + "end",
}


@pytest.mark.parametrize(("source", "text"), list(PAGES.items()), ids=range(len(PAGES)))
def test_main_text(source, text):
    assert html_text.main_text(html_text.parse(source or "")) == text


def test_templates_go_and_articles_stay(spark):
    body = lambda host, i: f"<body><div><p>Buy our stuff at {host}</p></div><div><h1>Title {i}</h1><p>Text number {i} of {host}</p></div><div><p>All rights reserved {host}</p></div></body>"
    rows = [(i, f"http://{h}/p{i}", body(h, i), "x", "y") for i in range(60) for h in (["a.example", "b.example"] if i % 2 else ["a.example"])]
    rows += [(900, None, body("a.example", 900), "x", "y"), (901, "http://c.example/", body("a.example", 901), "x", "y"), (None, "not a url", None, "x", "y"), (902, "http://a.example/", None, "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string").repartition(4)
    found = html_text.extract(df).collect()
    # hosts cut into many parts lose the same templates
    assert sorted(html_text.extract(df, hot_pages=7).collect(), key=str) == sorted(found, key=str)
    for r in found:
        if r["url"] and r["page_id"] is not None and r["page_id"] < 900:
            host = r["url"].split("/")[2]
            assert r["text"] == f"Title {r['page_id']}\nText number {r['page_id']} of {host}"
        elif r["page_id"] in (900, 901):
            assert r["text"].startswith("Buy our stuff") and r["text"].endswith("All rights reserved a.example")
        else:
            assert r["text"] == ""
        assert r["n_chars"] == len(r["text"])
    assert html_text.extract(df.where("false")).isEmpty()


def test_templates_within_articles_go(spark):
    html = lambda i: f"<body><div class='w'><article><h1>Title {i}</h1><div class='x1'><p>Read more</p><p>of this</p></div><p>Text number {i}.</p><section>Written by staff</section></article></div></body>"
    rows = [(i, f"http://a.example/{i}", html(i)) for i in range(40)] + [(99, "http://b.example/", html(99))]
    texts = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert texts == {i: f"Title {i}\nText number {i}." for i in range(40)} | {99: "Title 99\nRead more\nof this\nText number 99.\nWritten by staff"}


@pytest.mark.parametrize("name", ["has-sidebar", "layout-sidebar", "no-banner", "has-navbar", "share-price", "social-science", "sidebar", "site-footer"])
def test_names_do_not_drop_the_article(name):
    for tag in ("main", "article"):
        source = f"<body><div class='{name}'><div class=ad>buy</div><{tag}><p>text</p></{tag}></div><div class=comments>no</div></body>"
        assert html_text.main_text(html_text.parse(source)) == "text"
    kept = name not in ("sidebar", "site-footer")
    assert html_text.main_text(html_text.parse(f"<body><p>a</p><div class='{name}'>b</div></body>")) == ("a\nb" if kept else "a")


def test_named_articles_beside_the_article_go():
    source = "<body><article><p>text</p></article><div id=comments><article>comment</article></div></body>"
    assert html_text.main_text(html_text.parse(source)) == "text"
    assert html_text.main_text(html_text.parse(source.replace("article>", "div>", 2))) == "text"


@pytest.mark.parametrize("depth", [450, 20_000])
def test_deep_pages_are_whole(depth):
    deep = "<div>" * depth
    source = f"<body><div><article><p>first</p>{deep}<nav>menu</nav><div>one</div><div>two</div>{'</div>' * depth}<p>last</p></article></div><p>outside</p></body>"
    assert html_text.main_text(html_text.parse(source)) == "first\none\ntwo\nlast"
    # never closed, with a list of which each item looks for the one before it
    items = "".join(f"<li>{i}</li>" for i in range(depth))
    assert html_text.main_text(html_text.parse(f"<li><ul>{deep}{items}")) == "\n".join(map(str, range(depth)))


def test_templates_do_not_depend_on_the_size_of_the_host(spark):
    html = lambda i: f"<body><p>Text number {i}.</p>" + ("<div>Section menu</div>" if i < 12 else "") + "</body>"
    # 12 of 400 pages have the menu; one article is on 20 pages and stays
    rows = [(i, f"http://a.example/{i}", html(i)) for i in range(400)] + [(1000 + i, f"http://a.example/c{i}", "<article><p>The same</p><p>article</p></article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for hot in (500, 3):
        texts = {r["page_id"]: r["text"] for r in html_text.extract(df, hot_pages=hot).collect()}
        assert texts == {i: f"Text number {i}." for i in range(400)} | {1000 + i: "The same\narticle" for i in range(20)}


def test_whole_table(spark, sf):
    pages = {r["page_id"]: r for r in read_table(spark, sf, "pages").collect()}
    rows = op6_html_text(spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert all(x == " ".join(x.split()) and x for x in r["text"].split("\n")) or r["text"] == ""
        assert r["text"] == _plain(pages[r["page_id"]]["html"])


def _plain(source):
    """The articles of these plainly built pages: the paragraphs and headings, tags taken out."""
    inner = "\n".join(re.findall(r"<article>(.*?)</article>", source or "", re.S))
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|table|tr|td)\b[^>]*>", re.sub(r"<br */?>", " ", inner))
    lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_short_text_that_recurs_by_chance_stays(spark):
    """Paragraphs, headings and cells of a few words are in many articles of a large host; a box of such is a template."""
    box = "<div><p>Share</p><ul><li>Mail</li><li>Print</li></ul></div>"
    html = lambda i: f"<article><h2>Yes.</h2><p>Text number {i}.</p><p>The end.</p>{box}<table><tr><td>0</td><td>no</td></tr></table></article>"
    rows = [(i, f"http://a.example/{i}", html(i)) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "page_id long, url string, html string").repartition(3)
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(df).collect())
    # a line in most articles of the host goes, one that a fifth of them quote stays
    line = lambda i: f"<article><p>Text number {i}.</p><p>You are reading our news</p>{'<p>This work is licensed freely</p>' if i % 5 == 0 else ''}</article>"
    made = spark.createDataFrame([(i, f"http://b.example/{i}", line(i)) for i in range(60)], "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html_text.extract(made).collect()} == {i: f"Text number {i}." + ("\nThis work is licensed freely" if i % 5 == 0 else "") for i in range(60)}
    assert got == sorted((i, f"Yes.\nText number {i}.\nThe end.\n0\nno") for i in [*range(60), 3, 3])


def test_formulas_stay():
    assert html_text.main_text(html_text.parse("<article><p>if <math><mi>x</mi><annotation>\\x</annotation></math> is</p></article>")) == "if x is"


def test_ids_and_names_of_running_text_lose_nothing_within_the_article():
    cases = {
        "<article><h2 id='search'>Search</h2><p>body</p></article>": "Search\nbody",
        "<article><section id='navigation'><h2>Navigation</h2><p>by stars</p></section><p>end</p></article>": "Navigation\nby stars\nend",
        "<article><section class='related'><p>work</p></section><p class='alert'>Mind the gap</p><div id='comments'>on style</div><output>42</output></article>": "work\nMind the gap\non style\n42",
        "<main><ul class='menu'><li>soup</li></ul><table class='search'><tr><td>x</td></tr></table></main>": "soup\nx",
        "<article><p>a</p><div class='share-bar'>Share</div><nav>n</nav><form>f</form></article><div id='comments'>c</div>": "a",
        "<body><div id='sidebar'>s</div><p class='notice'>n</p><p>text</p></body>": "text",
    }
    assert {source: html_text.main_text(html_text.parse(source)) for source in cases} == cases
