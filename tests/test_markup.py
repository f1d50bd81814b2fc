"""Elements of pages: ends that are left out, odd quotes, depth, and time that grows with the page."""

import time

import pytest
from pyspark.sql import functions as F

from matchloom.functions.markup import Page, Selector
from matchloom.sources.pages import job_cards


def texts(source, selector):
    return Page(source).all_texts(Selector(selector))


@pytest.mark.parametrize("source, selector, want", [
    ("<ul><li>java<li>sql<li>go</ul>after", "li", ["java", "sql", "go"]),
    ("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>", "li", ["abcd", "b", "c", "e"]),
    ("<ul><li><div>a<li>b</ul>", "li", ["a", "b"]),
    ("<p>one<p>two<div>three</div>", "p", ["one", "two"]),
    ("<p>one<b>bold<p>two", "p", ["onebold", "two"]),
    ("<p>a<button><p>b</button>c", "p", ["abc", "b"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "td", ["1", "2", "3"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "tr", ["12", "3"]),
    ("<table><tr><td><table><tr><td>in</table>out<td>next</table>", "td", ["inout", "in", "next"]),
    ("<select><option>a<option>b<optgroup><option>c</select>", "option", ["a", "b", "c"]),
    ("<dl><dt>k<dd>v<dt>k2<dd>v2</dl>", "dd", ["v", "v2"]),
    ("<h2>a<h3>b</h3>", "h2", ["a"]),
    ("<a>one<a>two</a>", "a", ["one", "two"]),
    ("<article>a<article>b<article>c", "article", ["a", "b", "c"]),
    ("<article>a<article>inner</article>b</article>", "article", ["ainnerb", "inner"]),
    ("<div>a<table><tr><td></div>b</table></div>c", "div", ["ab"]),
    ("<div><span>x</div>y</span>z", "span", ["x"]),
    ("<i>a<div></i>b</div>", "div", ["b"]),
    ("<a title=it's href=x>T</a> don't <b>B</b>", "b", ["B"]),
    ("<a title = \"a > b\" x='<b>'>T</a>", "a", ["T"]),
    ("<p>2 < 3 and a<b>c</b>", "p", ["2 < 3 and ac"]),
    ("<title>a <b> &amp; c</title><b>d</b>", "b", ["d"]),
    ("<script>if (a<b) '</b>'</script><b>d</b><style>b{}", "b", ["d"]),
    ("<!-- <b>no</b> --><b>yes</b><!-- <b>no</b>", "b", ["yes"]),
    ("<!doctype html><?x?></ ><b>yes</b>", "b", ["yes"]),
    ("</div></b><b>yes", "b", ["yes"]),
    ("<B CLASS=X>yes</B>", "b.X", ["yes"]),
    ("<br/>a<br>b", "br", ["", ""]),
    ("", "b", []),
    ("a < b", "b", []),
    ("<b", "b", [""]),
])
def test_elements(source, selector, want):
    assert texts(source, selector) == want


def test_attributes():
    element, = Page("""<a href=a/b?c=1&amp;d=2 title=it's data-x="1'2" data-x=3 checked / Y = 'q"r' =z>T</a>""").elements
    assert element.attributes == {
        "href": "a/b?c=1&d=2", "title": "it's", "data-x": "1'2", "checked": "", "y": 'q"r', "=z": ""}
    assert Page("<a href='x>T</a>").elements[0].attributes["href"] == "'x"  # a quote that nothing closes is a character


def test_cards_without_end_tags_and_apostrophes(spark):
    rows = ("<div class=list><article><a class=title href=a-1 title=it's>T1</a><ul class=tags-gt><li>java<li>sql</ul>"
            "<article><a class=title href=b-2>T2</a><p>don't<article><span class=title>T3</span></div>")
    found = job_cards(spark.createDataFrame([(rows,)], "html string"), F.current_timestamp()).orderBy("card_no").collect()
    assert [(r["title"], r["job_id"], r["skills"]) for r in found] == [
        ("T1", "1", ["java", "sql"]), ("T2", "2", []), ("T3", "", [])]


def test_many_unclosed_cards(spark):
    n = 100_000
    page = "<div class=list>" + "".join(f"<article class=a><b class=title>{i}</b><li>x" for i in range(n))
    start = time.time()
    cards = job_cards(spark.createDataFrame([(page,)], "html string"), F.current_timestamp())
    row = cards.agg(F.count("*").alias("n"), F.max(F.col("title").cast("int")).alias("last")).first()
    assert (row["n"], row["last"]) == (n, n - 1) and time.time() - start < 60


@pytest.mark.parametrize("part", ["<b>", "<div>", "<p>", "</i>", "<", "<a x='", "<!--", "<li>", "<td>", "<a href=x", "<title>",
                                  "<article>", "<article></div>", "<i></article>", "&amp;", "<script>", "a='b' "])
def test_time_grows_with_the_page(part):
    start = time.time()
    page = Page(part * 40_000)
    page.first_text(Selector(".none b"))
    assert time.time() - start < 8
    for e in page.elements:
        assert e.index < e.end <= len(page.elements) and 0 <= e.first <= e.last <= len(page.texts)


def test_deep_elements_become_siblings():
    page = Page("<div>" * 2000 + "x")
    depth, most = {}, 0
    for e in page.elements:
        depth[e] = 1 + (depth[e.parent] if e.parent else 0)
        most = max(most, depth[e])
    assert most == 512 and len(page.elements) == 2000
