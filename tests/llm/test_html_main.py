import html
import re

from comparing import same

from orrery.llm import queries
from orrery.llm.html_main import blocks, extract, main_text

LONG = "The house of the old man is on the hill and it was built by the people that came from the north with all of the things they had. "


def test_query_against_the_marked_article(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op9_main_text(spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)
        spaced = re.sub(r"<(/?(p|h1|ul|li)|br)\b[^>]*>", " ", body[1]) if body else ""
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", spaced)).split())
        assert r["n_chars"] == len(r["text"])


def test_query_against_sql(spark, sf_dir, duck):
    assert same(queries.op9_main_text(spark, sf_dir).toPandas(), duck.sql(queries.SQL["op9_main_text"]).df())


def test_boilerplate_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
    <header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>{LONG}</p></div>
    <article><header><h1>A &amp; B</h1></header><p>{LONG}<br>Next&nbsp;line</p><p>Short.</p><div class="ad">Buy the thing</div><p><b>{LONG}</b></p></article>
    <section id="comments"><p>{LONG}</p></section><aside><p>{LONG}</p></aside><form><p>Mail</p><select><option>x</option></select></form><footer>&copy; me</footer></body></html>"""
    text = " ".join(LONG.split())
    assert main_text(page) == f"A & B {text} Next line Short. {text}"


def test_block_rules_without_a_marked_article():
    link = "<a href=x>one more link of the many</a> "
    page = f"<body><div>{link * 5}</div><div>Short head</div><p>{LONG * 2}</p><div>tiny</div><p>{LONG * 2}</p><div>{link * 6}</div><p>xq zw vb kl mn pr st xq zw vb kl mn pr st xq zw vb kl mn pr st xq zw vb kl mn pr</p></body>"
    text = " ".join((LONG * 2).split())
    assert main_text(page) in (f"{text} tiny {text}", f"Short head {text} tiny {text}")


def test_broken_markup():
    assert main_text(None) == main_text("") == ""
    assert main_text("<p>unclosed <b>bold") == ""  # a short block alone decides nothing
    assert main_text("<article><p>one<p>two<li>three") == "one two three"
    assert main_text("<article>a<script>if (1 < 2) x()") == "a"
    assert main_text("<article>5 < 6 & 7 &lt; 8</article>") == "5 < 6 & 7 < 8"
    assert main_text('<article><p title="a > b">kept</p></article>') == "kept"
    assert main_text('<div class="site-header">no</div><article><div class="entry-header"><h1>Title</h1></div><div class="comments">no</div></article>') == "Title"
    assert main_text("<article><!-- <p>no</p> -->yes</article></article></div>after") == "yes"
    assert [b.text for b in blocks("a<br>b<i>c</i>d")] == ["a bcd"]
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<article>x</article>"), (1, "u", ""), (1, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract(pages).collect()
    assert len(got) == 4 and {(r["page_id"], r["text"]) for r in got} == {(1, ""), (None, "x")}
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_markup_that_must_not_swallow_text():
    """Unclosed or self-closed elements, and names that only look like those of boilerplate."""
    keep = "<p>one</p>{}<p>two</p><p>three</p>"
    for odd in ("<a name=x>", "<a href='y'/>", "<svg/>", "<svg viewBox='0'>", "<iframe src='x' />", "<iframe src=x>", "<select><option>no</select>", "<select><option>no<option>no</select>", "<canvas>", "<object/>", "<span class='share'/>"):
        assert main_text(f"<article>{keep.format(odd)}</article>") == "one two three", odd
        assert main_text(f"<article><p>one {odd}</p><p>two</p><p>three</p></article>") == "one two three", odd
    for odd in ("<p class='share'>", "<p id='search-for-truth'>", "<h2 class='header'>", "<div id='search-for-truth'>", "<div class='loading'>", "<section class='radical-menu-art'>"):
        assert main_text(f"<article>{odd}one</article>") == "one", odd
    for odd in ("<div class='ad'>", "<div id='cookie-bar'>", "<section class='x relatedLinks'>", "<ul class=share-list>", "<div role=search>"):
        assert main_text(f"<article>{odd}no</div></section></ul></article>") == "", odd
    assert main_text("<article><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p></article>") == "a x=1 b"
    assert main_text("<article><p>a <svg><title>no</title></svg>b <select><option>no</option></select>c</p></article>") == "a b c"
    assert main_text("<article><p>" + "<a href=x>link " * 30 + f"</p><p>{LONG * 2}</p></article>") == " ".join((LONG * 2).split())


def test_rules_alone_find_the_article(spark, sf_dir):
    """Pages without the mark of their article: what the rules take against the marked part."""
    overlap = equal = n = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        whole = main_text(r["html"])
        bare = main_text(re.sub(r"</?article>", "", r["html"]))
        a, b = whole.split(), bare.split()
        overlap += len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
        equal += whole == bare
        n += 1
    assert overlap / n > 0.85 and equal / n > 0.85, (overlap / n, equal / n)
