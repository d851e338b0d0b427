from fixtures import rows
from parcelscope.llm import dom
from parcelscope.llm import wrapper_induction as W

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>First <i>bold</i>.<br>Same block<p>Sec&eacute;nd
   para<div class="share">Share me</div><ul><li>one<li>two</ul><form><input value="x">Search</form>
<section class="comments"><p>Nice!</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def text(html):
    return "\n".join(t for _, t, _ in dom.parse(html)[1])


def test_blocks_of_a_page():
    assert text(PAGE) == "Head & tail\nFirst bold. Same block\nSecénd para\none\ntwo"
    assert text("") == "" and text("plain &lt;text&gt;") == "plain <text>"
    assert text("<p>open <article><p>a<p>b") == "a\nb"
    assert text("<article><p>a <!-- never closed <p>b") == "a"
    assert text("<article><script>x<p>y") == ""
    assert text("<article><table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert text('<article><p title="a > b">x</p><p hidden>no</p><span class="cookie-banner">no</span>y</article>') == "x\ny"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<article>" + "<p>x" * 20_000 + "</article>").count("x") == 20_000


def test_words_of_a_class_never_drop_the_article():
    page = "<html class='{}'><body class='{}'><div id='{}'><article class='{}'><h1 class='{}'>T</h1><p>x</article></div></body></html>"
    for word in ("no-sidebar", "has-sidebar comments-open", "post with-comments", "article-header", "header", "social", "comments"):
        for k in range(5):
            assert text(page.format(*(word if i == k else "c" for i in range(5)))) == "T\nx"
    assert text("<div class=widget><div role=main>x<section class=comments><article>no</article></section></div></div>") == "x"
    assert text("<article>x<nav><article>no</article></nav><p hidden>no</p><div class='cookie-banner'>no</div></article>") == "x"
    assert text("<body class='no-sidebar'><p>x<div class='sidebar'>no</div>") == "x"
    assert text("<div class='social'><p>all there is</div><nav>no</nav>") == "all there is"


def test_simple_tree_matching():
    a, b = dom.read("r(a,b(c,d),e)"), dom.read("r(b(d),x,e)")
    n, pairs = dom.matching(a, b)
    assert n == 4 and [(x.label, y.label) for x, y in sorted(pairs, key=lambda p: p[0].label)] == [
        ("b", "b"), ("d", "d"), ("e", "e"), ("r", "r")]
    assert dom.matching(a, dom.read("q"))[0] == 0
    wrapper, to = dom.aligned(["r(a,b(c,d),e)", "r(b(d),x,e)", "r(a,e,z)"])
    assert wrapper == "r(a,b(c,d),x,e,z)"
    labels = [n.label for n in dom.numbered(dom.read(wrapper))]
    assert [[labels[i] for i in t] for t in to] == [["r", "a", "b", "c", "d", "e"], ["r", "b", "d", "x", "e"], ["r", "a", "e", "z"]]
    assert dom.aligned(["a(b)", "c(b)"])[0] == "any(a(b),c(b))"


def test_repeated_siblings_fold():
    top = dom.parse("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>")[0]
    dom.collapsed(top)
    assert dom.written(top) == "page(ul(li(ul(li))))"


def site(n):
    """Pages without an article element: the same notice, a menu of links, and a text of their own."""
    return [(i, f"http://Shop.example/p{i}", f"<body><div class=m><p><a href=/a{i}>menu {i} a</a> <a href=/b>b</a></p></div>"
             f"<div class=top><p>Terms apply to everything</p></div><div class=x><h2>Title {i}</h2><p>Own text {i}<p>Shared line</div></body>", 0)
            for i in range(n)]


SCHEMA = "page_id long, url string, html string, text int"


def extracted(spark, pages, **kw):
    return rows(W.extract(spark.createDataFrame(pages, SCHEMA).repartition(3), **kw), "page_id", "text")


def test_constant_nodes_are_template_and_varying_ones_content(spark):
    want = [(i, f"Title {i}\nOwn text {i}\nShared line") for i in range(12)]
    assert extracted(spark, site(12)) == sorted(want, key=repr)


def test_few_pages_and_copies_lose_nothing(spark):
    few = extracted(spark, site(3))
    assert few == [(i, f"Terms apply to everything\nTitle {i}\nOwn text {i}\nShared line") for i in range(3)]
    copies = [(i, "http://c/", "<article><h1>One</h1><p>same</article>", 0) for i in range(30)]
    assert {t for _, t in extracted(spark, copies)} == {"One\nsame"}


def test_copies_of_one_page_beside_others_lose_nothing(spark):
    others = [(i, "http://h/", f"<article><h1>H{i}</h1><p>text {i}</article>", 0) for i in range(8)]
    copies = [(100 + i, "http://h/", "<article><h1>Own</h1><p>words<ul><li>one<li>two</ul><h2>More</h2></article>", 0) for i in range(10)]
    got = extracted(spark, others + copies)
    assert got == sorted([(i, f"H{i}\ntext {i}") for i in range(8)] + [(100 + i, "Own\nwords\none\ntwo\nMore") for i in range(10)], key=repr)


def test_lines_that_articles_share_stay(spark):
    pages = [(i, "http://h/", f"<article><h1>H{i}</h1><p>text {i}<p>The same line</p></article><footer>f</footer>", 0) for i in range(20)]
    assert extracted(spark, pages) == sorted(((i, f"H{i}\ntext {i}\nThe same line") for i in range(20)), key=repr)


def test_awkward_rows(spark):
    pages = [(1, None, None, 0), (None, "not a url", "", 0), (2, "http://u@h:80/x", "<p>x", 0), (2, "http://u@h:80/x", "<p>x", 0),
             (3, "http://h/", "<<<>>> & &amp;amp", 0)]
    got = extracted(spark, pages)
    assert [g for g in got if g[0] != 3] == [(1, ""), (2, "x"), (2, "x"), (None, "")] and len(got) == 5
    assert W.extract(spark.createDataFrame([], SCHEMA)).count() == 0
