"""Main-text extraction on hand-made pages, and alignment against a recursive count."""

import random
import time

import pytest

from gridspark.llm import html


def plain(source):
    return html.extract(source, None, frozenset())


@pytest.mark.parametrize(("source", "want"), [
    ("", ""),
    ("just text", "just text"),
    ("<p>a<p>b", "a\nb"),
    ("<body><nav>x</nav><article><h1>T &amp; t</h1><p>a  b\n c<br>d</p></article><footer>f</footer></body>", "T & t\na b c d"),
    ("<article><p>one<p>two<script>var t='</p>';</script>three</article>", "one\ntwothree"),
    ("<article><p>keep<div class='ad'>no</div><section id=comments><p>no</section><p>end", "keep\nend"),
    ("<div class=comments><article>no</article></div><main><p>yes</main>", "yes"),
    ("<style>p{}</style><!-- <p>no --><p>a&nbsp;b &#39;c&#39; &copy;", "a b 'c' ©"),
    ("<body class='no-sidebar'><p>yes</p></body>", "yes"),
    ("<article>a <b>bold</b>er <i>x</b> y</article> tail", "a bolder x y"),
    ("<article><form>no<p>no</form><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
    ("<article><p>a < b & c", "a < b & c"),
    ("<script>never closed <p>x", ""),
])
def test_text(source, want):
    assert plain(source) == want


def count(a, b):
    if a.label != b.label:
        return 0
    m, n = a.children, b.children
    table = [[0] * (len(n) + 1) for _ in range(len(m) + 1)]
    for i in range(len(m)):
        for j in range(len(n)):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + count(m[i], n[j]))
    return table[-1][-1] + 1


def test_alignment_is_largest():
    rng = random.Random(3)

    def tree(depth):
        return html.Frame(rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randrange(0, 4))] if depth else [])

    for _ in range(200):
        a, b = tree(3), tree(3)
        b.label = a.label
        same = [c.label for c in a.children] == [c.label for c in b.children]
        got = html.align(a, b)
        assert html.match(a, b, {}) == count(a, b)
        assert same or len(got) <= count(a, b)
        assert html.dump(html.restore(html.dump(a))) == html.dump(a)


def page(body, menu="Home About Contact"):
    return f"<html><head><title>t</title></head><body><div id=top>{menu}</div><div id=body>{body}</div><div>All pages end so</div></body></html>"


def test_constant_slots_are_template(spark):
    rows = [(i, f"http://a.b/{i}", page(f"<p>story {i}</p><p>shared line</p>"), "x") for i in range(9)]
    rows += [(100, "http://lone.host/", page("<p>only page</p>"), "x"), (101, None, "<p>no url", "x"), (102, "http://a.b/x", None, "x"),
             (None, "bad url", "<article>" + "<div>" * 3_000 + "deep", "x"), (5, "http://a.b/5", page("<p>story 5</p>"), "x"),
             (103, "http://long/", "<article>" + "<p>word</p>" * 5_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text) for r in html.main_texts(df).collect()}
    assert {(i, f"story {i}\nshared line") for i in range(9)} <= got
    assert (5, "story 5") in got and (101, "no url") in got and (102, "") in got and (None, "deep") in got
    assert (103, "\n".join(["word"] * 5_000)) in got
    assert (100, "Home About Contact\nonly page\nAll pages end so") in got
    assert len(html.main_texts(df).collect()) == len(rows)
    assert all(r.n_chars == len(r.text) for r in html.main_texts(df).collect())
    assert html.main_texts(df.limit(0)).count() == 0


def test_given_pages(spark):
    """Every article's own blocks, and nothing else, on the given pages."""
    import re
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split())
                 for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_constant_text_beside_varying_children(spark):
    rows = [(i, f"http://a.b/{i}", f"<body><a href=#c>Skip to content</a><div id=wrap>Share: <div id=post>story {i}</div></div></body>")
            for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in html.main_texts(df).collect()} == {(i, f"story {i}") for i in range(5)}


@pytest.mark.parametrize(("source", "want"), [
    ("<article><h2 id='search-and-rescue'>a</h2><p class='notice-period'>b<p><span class=menu>c</span></article>", "a\nb\nc"),
    ("<article><section aria-label='Menu of the royal court'>a</section><section class=related-work>b</section></article>", "a\nb"),
    ("<div class='content with-sidebar'><article>a</article></div>", "a"),
    ("<div class=sidebar><article>a</article></div>", "a"),
    ("<div>post</div><div class=comments><article>no</article></div>", "post"),
    ("<article>x <math><mi>a</mi><mo>+</mo><mn>1</mn></math> y<div class=comment-list>no</div></article>", "x a+1 y"),
])
def test_names_of_parts(source, want):
    assert plain(source) == want


def test_constant_slots_inside_articles(spark):
    rows = [(i, f"http://a.b/{i}", f"<main><p>story {i}</p><div id=x>Join our club</div><article class=teaser>more {i}</article>"
             f"<article class=comment>no {i}</article></main>") for i in range(5)]
    rows += [(9, "http://copy/1", "<article>same</article>"), (9, "http://copy/2", "<article>same</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in html.main_texts(df).collect()]
    assert sorted(got) == [(i, f"story {i}\nmore {i}") for i in range(5)] + [(9, "same")] * 2


def test_several_templates_on_a_host(spark):
    def body(i):
        post = f"<div id=post>story {i}</div>"
        return (f"<div class=a>Menu A</div>{post}<div class=a2>x</div><ul><li>1</ul>" if i < 8 else
                f"<table><tr><td>Menu B</table><section>{post}</section>" if i < 14 else
                f"<dl><dd>Menu C</dl><details>Help</details><div class=c><div>{post}</div></div>")

    rows = [(i, "no host", f"<html><body>{body(i)}</body></html>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert got == {i: f"story {i}" for i in range(20)}


def test_articles_keep_their_headings_lists_and_licences(spark):
    def body(i):
        return (f"<article><h2 id='summary'>Summary</h2><p>story {i}</p><h3 class=sub>References</h3><p>ref {i}</p>"
                "<div class=licence>This text may be copied</div><ul class=tags><li>spark<li>data</ul>"
                "<div class=box>Subscribe to our newsletter</div></article>")

    df = spark.createDataFrame([(i, f"http://a.b/{i}", f"<body><div>Menu</div>{body(i)}</body>") for i in range(6)],
                               "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert got == {i: f"Summary\nstory {i}\nReferences\nref {i}\nThis text may be copied\nspark\ndata" for i in range(6)}


def test_many_templates_on_a_host(spark):
    rows = [(4 * t + i, "http://many.com/", f"<body><div class=m{chr(97 + t)}>Menu {t}</div><div id=p{chr(97 + t)}>story {t} {i}</div>"
             f"<section class=end{chr(97 + t)}>End {t}</section></body>") for t in range(20) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert got == {4 * t + i: f"story {t} {i}" for t in range(20) for i in range(4)}


def test_content_outside_a_small_article(spark):
    rows = [(i, f"http://a.b/{i}", f"<body><div class=top>Menu</div><div class=story><p>{'long story ' * 9}{i}</p></div>"
             f"<article>teaser {i}</article></body>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert got == {i: f"{'long story ' * 9}{i}\nteaser {i}" for i in range(4)}


@pytest.mark.parametrize("row", ["<tr class=r{0}><td>{0}</td></tr>", "<div class=r><section>{0}</section></div>",
                                 "<div class=r{1}><p>{0}</p></div>"])
def test_wide_pages_take_little_time(row):
    def wide(n, skip):
        return "<body><div id=menu>Menu</div>" + "".join(
            row.format(i, "abc"[i % 3] * (1 + i // 3 % 7)) for i in range(n) if i != skip) + "<div id=end>End</div></body>"

    a, b = (html.frame_of(html.parse(wide(20_000, skip))) for skip in (7_000, 13_000))
    start = time.time()
    found = html.align(a, b)
    assert time.time() - start < 10
    assert len(found) > 0.95 * html.extent(b)[0]


def test_large_frames_align_like_small_ones(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(html, "EXACT_PAIRS", 0)
    for _ in range(200):
        labels = [rng.choice("abcdefghij") for _ in range(rng.randrange(30))]
        other = [x for x in labels if rng.random() < 0.8]
        for k in range(rng.randrange(4)):
            other.insert(rng.randrange(len(other) + 1), f"new{k}")
        a, b = (html.Frame("r", [html.Frame(x, []) for x in part]) for part in (labels, other))
        pairs = [(x, y) for x, y in html.anchored(a.children, b.children)]
        ids = {id(f): n for side in (a, b) for n, f in enumerate(side.children)}
        places = sorted((ids[id(x)], ids[id(y)]) for x, y in pairs)
        assert all(x.label == y.label for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:]))
        assert len(html.align(a, b)) == len(pairs) + 1 or [x for x in labels] == other
        assert len(pairs) >= 0.5 * (count(a, b) - 1)


def test_deep_pages():
    deep = "<div>" * 3_000 + "text"
    a, b = (html.frame_of(html.parse(f"<body><div class={c}>x</div>{deep}")) for c in "ab")
    assert len(html.align(a, b)) > 3_000


def test_frames_of_any_size_align_the_largest():
    rng = random.Random(6)
    labels = [rng.choice("abcdefghij") for _ in range(700)]
    other = [x for x in labels if rng.random() < 0.7] + [rng.choice("abcdefghij") for _ in range(200)]
    a, b = (html.Frame("r", [html.Frame(x, [html.Frame(y, []) for y in x * (n % 3)]) for n, x in enumerate(part)])
            for part in (labels, other))
    assert html.extent(a)[0] * html.extent(b)[0] > 1_000_000
    assert len(html.align(a, b)) == count(a, b)
    assert html.match(a, b, {}) == count(a, b)
