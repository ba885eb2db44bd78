"""Main texts: known pages, wrappers, and pages of all kinds of damage."""

import html
import os
import random
import re

import pytest

from plumbline.llm.catalogue import QUERIES
from plumbline.llm.pages import Element, align, extract, infer_wrappers, main_texts, merge, read, rule_of

ROOT = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")

PLAIN = """<html><head><title>x</title><style>p{}</style></head><body><div class="site-header">Shop</div><div id=wrap>
<div class="menu"><a href=1>one</a><a href=2>two</a></div><div class="post"><h2>Title %d</h2><p>Body &amp; %s text<br>line</p>
<ul><li>first<li>second %d</ul><div class="comments"><p>bad!</p></div><p>end</p></div><div class="sidebar">side</div></div>
<form><input name=q><button>Go</button></form><script>var a="</p>";</script><div class="foot">Always the same</div></body>"""


def pages(n):
    return [PLAIN % (k, "lorem ipsum " * (k + 5), k) for k in range(n)]


def wrapper(own):
    out = None
    for page in own:
        root = read(page).root
        out = merge(out, root) if out else root
    return out


@needs_tables
def test_query_gives_each_article(spark):
    got = {r.page_id: r for r in QUERIES["op12_main_text"](spark, ROOT).collect()}
    table = spark.read.parquet(f"{ROOT}/pages.parquet").collect()
    assert len(got) == len(table)
    for r in table:
        body = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", body.replace("<br>", " ")))
        want = "\n\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_wrapper_of_pages_without_an_article_element():
    own = wrapper(pages(5))
    assert own.met == 5
    assert own.expression() == (
        "(div.site-header('text') div.wrap(div.menu('text') div.post(h2(#) p(#) ul(li(#)+) div.comments(p('text')) p('text')) div.sidebar('text')) "
        "form(button('text')) div.foot('text'))"
    )
    assert rule_of(own)["take"] == [("div.wrap", "div.post")]
    assert extract(read(pages(2)[1]), rule_of(own)).split("\n\n") == ["Title 1", "Body & " + "lorem ipsum " * 6 + "text line", "first", "second 1", "end"]


def test_alignment_resolves_mismatches():
    def row(text):
        return read(text).root

    one, two = row("<h1>a</h1><p>b</p><p>c</p><table><tr><td>d</table>"), row("<h1>a</h1><h2>x</h2><p>b</p>")
    both = merge(one, two)
    assert both.expression() == "(h1('text') h2('text')? p(#)+ table(tr(td('text')))?)"
    groups = merge(row("<dl><dt>a<dd>1<dt>b<dd>2</dl>"), row("<dl><dt>c<dd>3</dl>"))
    assert groups.expression() == "(dl((dt(#) dd(#))+))"
    assert [e.label for e in align([], [Element("p")])] == ["p"]


def test_wide_rows_become_one_repeated_group():
    rng = random.Random(2)
    row = "".join(f"<{n}>{k}</{n}>" for k, n in enumerate(rng.choice(["p", "h2", "h3", "table", "ul"]) for _ in range(400)))
    own = wrapper([f"<article>{row}</article>", "<article><p>x</p></article>"])
    assert own.size() < 40
    assert extract(read(f"<article>{row}</article>"), rule_of(own)).split("\n\n") == [str(k) for k in range(400)]


def test_merging_in_any_grouping_gives_the_same_rule():
    own = pages(9)
    whole = rule_of(wrapper(own))
    parts = [wrapper(own[k : k + 3]) for k in (0, 3, 6)]
    packed = [Element.unpack(p.pack()) for p in parts]
    assert rule_of(merge(packed[0], merge(packed[1], packed[2]))) == whole


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p", ""), ("a<b>c</b>d<div>e", "acd\n\ne"), ("<table><tr><td>x<td>y</table>", "x\n\ny"),
    ("<p>&am &amp &quot; &#8364;&#x41; &nbsp;x</p>", '&am & " €A x'), ("<!-- gone <p>x</p>", ""), ("<script>gone", ""), ("<p>a<!-- b -->c</p>", "ac"),
    ("<article><p>t</p><nav>n</nav><aside>s</aside><div class='ad-slot'>ad</div></article><footer>f</footer>", "t"),
    ("<main class=with-sidebar><p>a  b\n c<p>d</main>", "a b c\n\nd"), ("<p title='a>b'>x</p>", "x"), ("<a href=x>only links</a>", "only links"), ("1 < 2 <p>3", "1 < 2\n\n3"),
])
def test_single_pages(page, want):
    assert extract(read(page), None) == want


def test_deep_and_long_pages():
    assert extract(read("<div>" * 20_000 + "deep" + "</div>" * 20_000), None) == "deep"
    assert len(extract(read("<article>" + "<p>word</p>" * 50_000 + "</article>"), None)) == 50_000 * 6 - 2


def test_edges(spark):
    rows = [(1, "http://A.example/x", PLAIN % (1, "long text " * 9, 1)), (1, "http://A.example/x", PLAIN % (1, "long text " * 9, 1)), (2, None, "<p>no address</p>"), (3, "nonsense", None), (None, "http://a.example", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS id", "'x' AS host", "'x' AS rule", "'x' AS text")
    got = main_texts(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text[:7], r.n_chars > 0) for r in got.collect()) == [(0, "", False), (1, "Title 1", True), (1, "Title 1", True), (2, "no addr", True), (3, "", False)]
    assert main_texts(table.limit(0)).collect() == []
    found = {r.host: r.n_pages for r in infer_wrappers(table.repartition(5)).collect()}
    assert found == {"a.example": 3, "": 2}


def test_a_hot_host_is_combined_in_steps(spark):
    table = spark.range(300).selectExpr("id AS page_id", "'http://hot.example/' AS url", "concat('<article><p>text ', id, '</p></article><footer>f</footer>') AS html").repartition(90)
    own = infer_wrappers(table).collect()
    assert [(r.host, r.n_pages, r.expression) for r in own] == [("hot.example", 300, "(article(p(#)) footer('text'))")]
