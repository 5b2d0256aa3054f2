import html as h
import re
import time

import pytest

from rheospark.llm import html as x


def test_pages_equal_their_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in x.op8_wrapper_text(spark, sf).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<html><head><title>t</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content{n}"><h1>Title {n}</h1><p>First &amp; <b>bold</b>
text {n}<p>Second&nbsp;one<br>next line<ul><li>item a<li>item b</ul><div class="ad">Buy</div><form><p>Name</p></form></div>
<aside><p>Side</p></aside><div class="comments"><p>Nice {n}</p></div><footer>foot</footer></body>"""


@pytest.mark.parametrize("n", [1, 2])
def test_wrapper_of_a_site_without_article_tags(n):
    trees = [x.fold(x.parse(PAGE.replace("{n}", str(i)))[0]) for i in (1, 2, 3)]
    w = x.merge(x.merge(trees[0], trees[1]), trees[2])
    text = x.extract(PAGE.replace("{n}", str(n)), x.mark_article(w))
    assert text.split("\n\n") == [f"Title {n}", f"First & bold text {n}", "Second one next line", "item a", "item b"]


def both(*pages):
    """Each page by the wrapper of all."""
    w = x.fold(x.parse(pages[0])[0])
    for page in pages[1:]:
        w = x.merge(w, x.fold(x.parse(page)[0]))
    x.mark_article(w)
    return [x.extract(page, w) for page in pages]


@pytest.mark.parametrize("outer", ["<article class='post has-sidebar'>{}</article>", "<div class='site-wrapper cookie-enabled'><article>{}</article></div>", "<div class='banner-page sidebar'><article class='newsletter'>{}</article></div>",
                                   "<div class='content comment'>{}</div>", "<main class='search'>{}</main>", "<div class='x7'>{}</div>"])
@pytest.mark.parametrize("count", [1, 3])
def test_names_around_the_article_do_not_matter(outer, count):
    page = lambda n: f"<body><nav><a href=x>Home</a> and more</nav>{outer.format(f'<p>Words {n} of it.<p>Same on all.<div class=ad>Buy</div>')}<div class='footer-links'>Imprint</div></body>"
    assert both(*map(page, range(count))) == [f"Words {n} of it.\n\nSame on all." for n in range(count)]


def test_slots_tell_the_article_from_constant_parts():
    page = lambda n: f"<body><article class=intro>Always the same words, many of them, on each page</article><article class=piece><h1>T{n}</h1><p>Text {n}</article></body>"
    assert both(page(1), page(2)) == ["T1\n\nText 1", "T2\n\nText 2"]


def test_comments_in_article_tags_are_left_out():
    page = lambda n: f"<body><article><p>Main text {n} of some length</p><section class=comments><article><p>Nice {n}</article></section></article><div class=comments><article>Me {n}</article></div></body>"
    assert both(page(1), page(2)) == ["Main text 1 of some length", "Main text 2 of some length"]


def test_optional_and_repeated_parts_are_followed():
    page = lambda n: "<body><div class=content>" + "".join(f"<h2>H{n}{i}</h2><p>P{n}{i}</p>" for i in range(n)) + ("<ul><li>a<li>b</ul>" if n % 2 else "") + f"<p>End {n}</div><form>Mail</form></body>"
    want = ["\n\n".join([*(x for i in range(n) for x in (f"H{n}{i}", f"P{n}{i}")), *(["a", "b"] if n % 2 else []), f"End {n}"]) for n in (1, 4, 7)]
    assert both(page(1), page(4), page(7)) == want


def test_odd_pages_end():
    assert both("<div>" * 5000 + "deep <nav>menu</nav>" + "</div>" * 5000 + "<p>end")[0].startswith("deep")
    began = time.perf_counter()
    assert "b" in both("<p>b" + "<a '" * 100_000)[0]
    assert "b" in both("<p>b" + '<a ">' * 50_000)[0] and "b" in both("<p>b<" * 20_000)[0] and both("<p>x" + "<div" * 50_000)[0].startswith("x")
    many = "<p>b" + "".join(f"<div class={'abcdefgh'[i * i % 7]}{'xyz'[i % 3]}>t{i}</div>" for i in range(3000))
    assert both(many, many[:-2000])[0].count("t") == 3000
    assert time.perf_counter() - began < 60
    assert x.extract('<p title="a > b">c</p><p>it\'s <b class=\'x>y\'>d</b></p>', x.mark_article(x.fold(x.parse("")[0]))) == "c\n\nit's d"


def test_alignment_makes_optional_and_repeated_groups():
    one = x.fold(x.parse("<div><p>a</p><p>b</p><h2>c</h2><dl><dt>1<dd>2<dt>3<dd>4</dl></div>")[0])
    two = x.fold(x.parse("<div><p>a</p><h2>d</h2></div>")[0])
    assert x.expression(x.merge(one, two)) == "<div>(<p>#</>)+<h2>#</>(<dl>(<dt>#</>)+(<dd>#</>)+</>)?</>"


def test_edges(spark):
    rows = [(1, None, None), (2, "http://a.b/c", ""), (3, "no url", "plain &lt; text"), (3, "no url", "plain &lt; text"), (None, "http://a.b/d", "<p>a<p>" + "word " * 50_000), (5, "HTTP://A.b", "<!-- x --><article><p>t</article")]
    out = x.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS Text")).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == 6 and by[1].text == "" and by[2].n_chars == 0 and by[3].text == "plain < text" and by[None].n_chars == 249_999 + 3
    assert x.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_formulas_and_objects_keep_their_text():
    page = "<body><nav><a href=x>menu {n}</a></nav><article><h1>Energy {n}</h1><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here {n}.</p><object><p>A drawing of {n}</p></object><svg><text>no</text></svg></article></body>"
    out = both(*[page.replace("{n}", str(i)) for i in (1, 2, 3)])
    assert out[0] == "Energy 1\n\nEnergy is E=m here 1.\n\nA drawing of 1"
