from kinweave.llm import htmltext

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Menu{i}</a></ul></nav>
<div class="ad">Buy {i}</div><div class="top-strip">All the same strip</div><article><h1>Title&nbsp;{i} &amp; more</h1><p><b>First
   words{i}<br>again<p>Second &lt;p{i}&gt;</p><div class="comments"><p>A reader {i}</p></div><form><input>x</form></article>
<aside>side</aside><footer>&copy; foot</footer><script>var t="</p><p>no";</script><!-- gone <p>x</p> --></body></html>"""


def test_parser_rules():
    text = htmltext.Parser().text
    assert text(PAGE.format(i=1)) == "Title 1 & more\nFirst words1 again\nSecond <p1>"
    assert text(None) == text("") == text("<nav>x</nav>") == ""
    assert text("<p>plain<p>two") == "plain\ntwo"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert text("<p>open <!-- never closed <p>x") == "open"
    assert text('<p title="a>b">in</p><p hidden>no</p><div role=navigation>no</div><div style="display: none">no</div>') == "in"
    assert text("1 < 2 & 3 > 2") == "1 < 2 & 3 > 2"
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert len(text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4
    assert text("<article>" + "<p>word</p>" * 20000 + "</article>").count("\n") == 19999


def test_style_tree_removes_what_repeats(spark):
    rows = [(i, "http://a.example/x", PAGE.format(i=i).replace("<article>", "<div class=body><p>Story {0} tells {0}</p><h2>H{0}</h2>{1}</div><article>".format(i, "<p>more</p>" * (i % 5))).replace("article", "section"), "t") for i in range(40)]
    rows += [(900, None, None, None), (901, "", "", "x"), (902, "b", "<p>alone</p>", "x"), (902, "b", "<p>alone</p>", "x"), (None, "http://a.example/", "<p>no id</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    tree = {(r.host, r.path): r for r in htmltext.style_tree(pages).collect()}
    assert all(0 <= r.importance <= 1.0001 for r in tree.values())
    random = [(i, "http://r.example/", f"<body><div class={'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}><p>x{i}</p></div></body>") for i in range(60)]
    found = htmltext.style_tree(spark.createDataFrame(random, "page_id long, url string, html string")).collect()
    assert len(found) <= 3  # names made up at random are no nodes of the tree
    got = {r.page_id: r for r in htmltext.extract(pages).collect()}
    assert "All the same strip" not in got[3].text and "Story 3 tells 3" in got[3].text
    assert "Menu" not in got[3].text and "reader" not in got[3].text and "Buy" not in got[3].text
    assert (got[900].text, got[900].n_chars, got[901].text) == ("", 0, "")
    assert got[902].text == "alone" and got[None].text == "no id"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.extract(pages).count() == len(rows)
    assert htmltext.extract(pages.where("false")).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><div><h1>Head</h1>" + "".join(f"<p>Paragraph {i}</p>" for i in range(10)) + "</div></body>"
    rows = [(i, "http://c.example/x", page) for i in range(200)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Head\n" + "\n".join(f"Paragraph {i}" for i in range(10))
    low = frozenset([htmltext.Parser()._id(1, "div.x")])
    assert htmltext.Parser().text("<div class=x><p>only</p></div>", low) == "only"
    assert htmltext.Parser().text("<div class=x><p>only</p></div><p>rest</p>", low) == "rest"


def _neutral(i):
    """No tag, role or name tells: a strip, a box of links and a line at the end that the site repeats, and a story."""
    story = "".join(f"<p>Story {i} paragraph {k} <em>tells</em> {i * 31 + k}</p>" for k in range(3 + i % 3))
    return f"""<body><div class="kx"><p>Welcome to our place</p></div><div class="mm"><div class="zq"><h1>Head {i}</h1>{story}</div>
<div class="bb"><p>Read this next</p><ul><li><a href=1>One thing</a><li><a href=2>Other thing {i % 2}</a></ul></div></div><div class="yy">All rights {i % 3}</div></body>"""


def test_the_tree_alone_tells_story_from_frame(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "http://n.example/x", _neutral(i)) for i in range(60)], "page_id long, url string, html string")
    want = {i: "\n".join([f"Head {i}", *(f"Story {i} paragraph {k} tells {i * 31 + k}" for k in range(3 + i % 3))]) for i in range(60)}
    assert {r.page_id: r.text for r in htmltext.extract(pages).collect()} == want
    monkeypatch.setattr(htmltext, "SMALL_NODES", 0)  # joined by host and salt
    assert {r.page_id: r.text for r in htmltext.extract(pages).collect()} == want
    # Without the tree nothing tells.
    assert all(htmltext.Parser().text(_neutral(i)) != want[i] for i in range(60))


def test_names_outweigh_text_that_differs(spark):
    page = lambda i: f"<body><div><p>Story {i} told in full {i * 7}</p></div><div class='sidebar'>Links {i}</div><div id='comments-{i}'><p>Reader {i} says {i}</p></div><div class='kx'>Every page</div></body>"
    pages = spark.createDataFrame([(i, "http://s.example/", page(i)) for i in range(40)] + [(99, "http://t.example/", page(99))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    assert got[5] == "Story 5 told in full 35"
    assert got[99] == "Story 99 told in full 693\nEvery page"  # a single page goes by its names


def test_importance_against_brute_force(spark):
    import math
    import re
    from collections import Counter

    pages = [f"<body><div class=a><p>x{i % 4}</p><p>y</p>{'<h2>z</h2>' * (i % 3)}</div><div class=b>w{i}</div></body>" for i in range(24)]
    nodes = {}  # chain -> child sequences, blocks of every instance
    for page in set(pages):
        stack, kids = [], []
        for end, tag, cls, text in re.findall(r"<(/?)(\w+)(?: class=(\w))?>([^<]*)", page):
            if end:
                nodes.setdefault(tuple(stack), ([], []))[0].append(tuple(k for j, k in enumerate(kids[-1]) if j == 0 or kids[-1][j - 1] != k))
                stack.pop()
                kids.pop()
                continue
            name = f"{tag}.{cls}" if cls else tag
            if kids:
                kids[-1].append(name)
            stack.append(name)
            kids.append([])
            if text:
                nodes.setdefault(tuple(stack), ([], []))[1].append(text)

    def entropy(items):
        n, c = len(items), Counter(items)
        return -sum(v / n * math.log(v / n) for v in c.values()) / math.log(n)

    def importance(chain):
        shapes, texts = nodes[chain]
        parts = [(importance(c), len(nodes[c][0])) for c in nodes if c[:-1] == chain]
        if texts:
            c = Counter(texts)
            parts.append((1 - sum(math.log(v) / math.log(len(texts)) for v in c.values()) / len(c), len(texts)))
        g = 0.9 ** len(set(shapes)) if any(shapes) else 1
        return (1 - g) * entropy(shapes) + g * sum(v * w for v, w in parts) / sum(w for _, w in parts)

    df = spark.createDataFrame([(i, "http://i.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    parser, want = htmltext.Parser(), {}
    for chain in nodes:
        path = 1
        for name in chain:
            path = parser._id(path, name)
        want[path] = importance(chain)
    got = {r.path: r.importance for r in htmltext.style_tree(df).collect()}
    assert set(got) == set(want) | {1} or set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_only_forms_and_scripts_go_inside_an_article():
    text = htmltext.Parser().text
    body = "<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p><noscript><p>shown</p></noscript><object><p>other</p></object><svg><text>drawn</text></svg><template><p>kept</p></template>"
    assert text(f"<article>{body}<form><p>f</p><select><option>o</select></form><script>s</script></article>") == "a x=1 b\nshown\nother\ndrawn\nkept"
    assert text("<article><p>one <span class=share>Share</span> two</p></article>") == "one two"


def test_layout_names_do_not_empty_a_page():
    text = htmltext.Parser().text
    for body in ('<body class="has-sidebar">', '<body class="no-sidebar">', '<body class="with-banner">', '<body><div id="page" class="layout-sidebar-right">', '<body><div class="page-sidebar-wrap">'):
        assert text(body + "<article><p>Story</p></article>") == "Story", body
    assert text('<body class="has-sidebar"><p>Story</p><div class="sidebar"><p>side</p></div>') == "Story"
    cards = '<div class="sidebar"><article><p>card</p></article></div>'
    assert text("<article><p>Story</p></article>" + cards) == text("<p>Story</p>" + cards) == "Story"
    assert text("<article><p>Story</p><div class=comments><article><p>reader</p></article></div></article><nav><article>n</article></nav>") == "Story"
