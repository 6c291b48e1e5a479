import pytest

from sparkloom.llm import html_tree as t


def text(source):
    return t.parsed(source).text()


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        (None, ""), ("", ""), ("plain < text", "plain < text"), ("<p>a &amp; b&nbsp;&eacute;&#65;</p>", "a & b éA"), ("<p>un<p>closed", "un\nclosed"), ("<p>a<br>b  <b>c</b>\n d</p>", "a b c d"),
        ("<article><h1>T</h1><p>x</p></article><footer>f</footer>", "T\nx"), ("<header><h1>Site</h1></header><main><p>x</p><aside>s</aside></main>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p><section class='comments'><p>bad</p></section></article>", "T\nx"), ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>x</p>", "x"),
        ("<div class='ad-box'>buy</div><div id='cookie_notice'>ok</div><div><p>x</p></div>", "x"), ("<form><p>no</p></form><p>x</p>", "x"), ("<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><p>x</p>", "x"),
        ("<div class='layout has-sidebar'><div class='sidebar'>s</div><article><p>x</p></article></div>", "x"), ("<div class='menu-page'><h1>T</h1><p>x</p></div>", "T\nx"),
        ("<main><p>x</p><section class='comments'><article class='comment'><p>one</p></article><article class='comment'><p>two</p></article></section></main>", "x"),
        ("<article><p><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></p></article>", "one two three"), ("<p><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></p><p>x</p>", "x"),
        ("<!-- <p>no</p> --><p>x</p><!-- open", "x"), ("<p title='a > b'>x</p>", "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<div hidden>no</div><p>x</p>", "x"), ("<p><b>a<br><p>b</p>", "a\nb"), ("<p>x</p></div></p>y", "x\ny"),
        ("<article><h1>T</h1><section id='discussion'><p>d</p></section><section class='related-work'><p>r</p></section><p class='notice'>n</p><section class='form'><p>f</p></section></article>", "T\nd\nr\nn\nf"),
        ("<main><h1>T</h1><p>intro of the page</p><article>card</article></main>", "T\nintro of the page\ncard"), ("<article><p>x</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></article>", "x\na\nb\nc"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "so x=1 holds"), ("<article><p>x</p><div class='comments'><p>no</p></div><div class='ad'>no</div></article>", "x"),
        ("<body><div class='ad'>no</div><article><p>x</p></article></body>", "x"), ("<main><article><p>the whole text</p></article><div>teaser</div></main>", "the whole text"),
    ],
)
def test_text(source, expected):
    assert text(source) == expected


def test_odd_pages_end_soon():
    assert text("<div>" * 5000 + "deep") == "deep"
    assert text("<" * 3000).startswith("<")
    assert len(text("<p>" + "word " * 100_000)) == 499_999
    text('<div a="' * 3000)


def test_branches_that_repeat_on_a_host_go(spark):
    pages = [(k, f"http://A.com/{k}", f"<body><div class='x'><p>same promo</p></div><div class='y'><p>text {k}</p></div></body>") for k in range(12)]
    pages += [(100, "http://b.com/1", "<body><div class='x'><p>same promo</p></div></body>"), (101, None, "<p>q</p>"), (102, "nohost", None), (None, "http://a.com/z", "<p>z</p>"), (3, "http://a.com/3", pages[3][2])]
    frame = spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, text int")
    found = sorted(((r.page_id if r.page_id is not None else -1, r.url, r.text, r.n_chars) for r in t.extract_text(frame).collect()), key=str)
    expected = [(k, u, f"text {k}" if k is not None and k < 12 else {100: "same promo", 101: "q", 102: "", -1: "z"}[-1 if k is None else k]) for k, u, _ in pages]
    assert found == sorted(((-1 if k is None else k, u, x, len(x)) for k, u, x in expected), key=str)


def test_articles_stay_even_if_they_repeat(spark):
    pages = [(k, f"http://a.com/{k}", f"<body><div>{k}</div><article><p>same</p><p>lines</p></article></body>") for k in range(9)]
    assert {r.text for r in t.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {"same\nlines"}


def test_empty_table(spark):
    assert t.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_boilerplate_inside_articles_goes_and_their_own_text_stays(spark):
    pages = [(k, f"http://a.com/{k}", f"<article><h1>Title {k}</h1><p>text {k}</p><p>Read more on our site.</p><p>{'odd' if k % 2 else 'even'}</p></article>") for k in range(12)]
    pages += [(100 + k, "http://b.com/", f"<article><p>same on two of four</p><p>{'x' * (k // 2)}</p><p>{k}</p></article>") for k in range(4)]
    found = {r.page_id: r.text for r in t.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[3] == "Title 3\ntext 3\nodd" and found[4] == "Title 4\ntext 4\neven"
    assert found[100] == "0" and found[103] == "x\n3"  # what all four pages have goes


def brute_tree(pages):
    """(host, path, content) of the branches below LEAST, from the definition, in plain Python."""
    import math
    from collections import defaultdict

    styles, contents = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for ident, url, source in pages:
        host = url.split("://")[1].split("/")[0].lower() if url and "://" in url else ""
        if not host or ident is None:
            continue
        page = t.parsed(source)
        for path, style, content in page.branches():
            styles[host, path][style].add(page.text())
            contents[host, path][content].add(page.text())
    out = set()
    for key, own in contents.items():
        m = len(set().union(*own.values()))
        if m < t.PAGES:
            continue
        sizes = [len(x) for x in styles[key].values()]
        n = sum(sizes)
        style = -sum(x / n * math.log(x / n) for x in sizes) / math.log(max(n, 2))
        out |= {(*key, c) for c, held in own.items() if len(held) > 1 and t.PRESENTATION * style + (1 - t.PRESENTATION) * (1 - math.log(len(held)) / math.log(m)) < t.LEAST}
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_against_a_brute_force_tree(spark, monkeypatch, most):
    """The same branches, and so the same texts, whether they are broadcast or joined."""
    import random

    monkeypatch.setattr(t, "MOST", most)
    rng = random.Random(4)
    part = lambda: rng.choice(["<p>{}</p>", "<div class='box'><p>{}</p></div>", "<section id='s'><h2>{}</h2><div>{}</div></section>", "<ul><li>{}<li>{}</ul>", "<blockquote>{}</blockquote>"]).replace("{}", rng.choice(["alpha", "beta", "gamma", "once %d" % rng.randint(0, 999)]))  # noqa: E731, UP031
    pages = [(k, f"http://{rng.choice('ab')}.com/{k}", f"<body>{'<div class=promo2>fixed</div>' if rng.random() < 0.9 else ''}<article>{''.join(part() for _ in range(rng.randint(1, 6)))}{'<p>closing words</p>' if rng.random() < 0.97 else ''}</article></body>") for k in range(80)]
    pages += [(3, pages[3][1], pages[3][2]), (200, None, "<p>q</p>"), (None, "http://a.com/", "<article><p>closing words</p></article>")]
    removed = brute_tree(pages)
    assert removed
    expected = []
    for ident, url, source in pages:
        host = url.split("://")[1].split("/")[0] if url and ident is not None else ""
        expected.append((str(ident), t.parsed(source).text({(p, c) for h, p, c in removed if h == host})))
    found = [(str(r.page_id), r.text) for r in t.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert sorted(found) == sorted(expected)
    assert sum(t.parsed(x).text() != y for (_, _, x), (_, y) in zip(pages, expected, strict=True)) > 40


def test_the_tree_judges_every_element():
    page = t.parsed("<body><div><h1>T</h1></div><article><p>a</p><ul><li>b</ul></article><nav>n</nav></body>")
    assert len(list(page.branches())) == 7  # body, div, h1, article, p, ul, li
