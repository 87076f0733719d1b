"""Main text of pages: texts written out by hand, and the style tree against its definition."""

import math
import random
from collections import Counter, defaultdict

from veldrin.llm import page_text, queries
from veldrin.llm.page_text import Page

SCHEMA = "page_id long, url string, html string, text string, host int, `a.b` int"


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA).repartition(parts)
    return {r.page_id: r for r in page_text.extract(df).collect()}


RICH = """<!DOCTYPE html><HTML lang=en><head><title>No &amp; no</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1><p>slogan</p></header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div><div id='sidebar'>side<div>deep</div></div>
<main><p>intro beside the article</p><article class="post"><header class="entry-header"><h1>The &lt;title&gt;</h1><p class="byline">by me</p></header>
<p>First\n  <b>bold<i>er</b> text&nbsp;&amp;amp; more<br>line<p>Second &eacute;&#233;&#x20AC; a<b</p><script>var t="</p><p>no";</script><!-- <p>no</p> -->
<ul><li>one<li>two <a href="x>y" class=adsfree>three</a></ul><table><tr><td>a<td>b<tr><td>c</table><div>loose <p>inner</p> tail</div>
<form><label>mail</label><input><button>go</button></form><aside>pull</aside><span class="ad">buy</span> after
<blockquote role=note>quote</blockquote><section id="comments"><p>nice!</p></section></article></main><footer>&copy; x</footer></body>"""
RICH_TEXT = "The <title>\nFirst bolder text &amp; more line\nSecond éé€ a\none\ntwo three\na b\nc\nloose\ninner\ntail\nafter\nquote"


def test_rich_page():
    assert Page(RICH).text({}) == RICH_TEXT


def test_defined_cases(spark):
    rows = [(1, "http://h/1", None), (2, "http://h/2", ""), (3, None, "<p>alone</p> tail"), (3, None, "<p>alone</p> tail"), (4, "no host", "text only &lt;"), (5, "http://h/5", "<script>x"), (6, "http://h/6", "<p>" * 3000 + "deep" + "<div>" * 3000 + "er"), (7, "http://h/7", "<p>a" + " b" * 400_000 + "</p>"), (8, "http://h/8", "<nav>only menus</nav>"), (9, "http://h/9", "<p title='open>x</p><p>y</p>")]
    got = run(spark, rows)
    assert {i: r.text for i, r in got.items() if i != 7} == {1: "", 2: "", 3: "alone\ntail", 4: "text only <", 5: "", 6: "deep\ner", 8: "", 9: "x\ny"}
    assert got[7].n_chars == 800_001 and got[3].url is None and all(r.n_chars == len(r.text) for r in got.values())
    assert page_text.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def site(rng, n, copies=0):
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "sed"]
    pages = []
    for i in range(n):
        body = [" ".join(rng.choice(words) for _ in range(30)) + f" {i}.{k}" for k in range(3)] if i >= copies else ["copied text one", "copied text two " + str(i % 2)]
        rest = f"<div class='box{i}'>{body[0]}</div>" if i % 2 else ""
        pages.append(f"<body><div class='x1'><div>Follow us on our channels</div><div>All rights reserved</div></div><div class='x2'><h1>Title {i}</h1>{''.join(f'<p>{b}</p>' for b in body)}<div class='x3'>Tell a friend</div></div>{rest}</body>")
    return pages


def test_style_tree_drops_what_a_host_repeats(spark):
    rng = random.Random(3)
    rows = [(i, f"https://big.example/{i}", h) for i, h in enumerate(site(rng, 40))] + [(100 + i, f"https://one{i}.example/", h) for i, h in enumerate(site(rng, 3))]
    got = run(spark, rows)
    for i, _, h in rows:
        for part in ("Follow us", "rights reserved", "Tell a friend"):
            assert (part in got[i].text) == (i >= 100)
        assert f"Title {i % 100}" in got[i].text and got[i].text.count(".") >= 3 and h.count("sit") == got[i].text.count("sit")


def test_copies_of_a_page_stay(spark):
    rows = [(i, "http://copies.example/x", h) for i, h in enumerate(site(random.Random(1), 30, copies=30))]
    got = run(spark, rows)
    assert all("copied text one" in r.text and "Title" in r.text for r in got.values())


def test_style_tree_is_its_definition(spark, monkeypatch):
    monkeypatch.setattr(page_text, "HELD", 50)
    rng = random.Random(5)
    rows = [(f"HTTP://User@Host{i % 2}.example:80/{i}", h) for i, h in enumerate(site(rng, 23, 5))] + [("http://host1.example", None), (None, "<p>x</p>")]
    shown, texts = defaultdict(Counter), defaultdict(set)
    for url, html in rows:
        if url and html:
            page = Page(html)
            for path, kind, feature in page.features():
                shown[page_text.host_of(url), page_text._signed(path), kind][feature] += 1
                texts[page_text.host_of(url), page_text._signed(path), kind, feature].add(tuple(t for _, t in page.blocks))
    want = {}
    for host, path, kind in list(shown):
        k = lambda which: [n if len(texts[host, path, which, f]) > 1 else 1 for f, n in shown[host, path, which].items()]  # noqa: E731, B023
        m = k(2)[0]
        if kind == 2 and m > 1:
            base = math.log(max(m, page_text.FEWEST))
            c, p = k(1), k(0)
            want[host, path] = (1 - sum(math.log(x) for x in c) / len(c) / base if c else 1.0, min(1.0, -sum(x / sum(p) * math.log(x / sum(p)) for x in p) / base) if p else 1.0, max(1, len(p)))
    got = {(r.host, r.path): (r.content, r.presentation, r.sequences) for r in page_text.style_tree(spark.createDataFrame(rows, "url string, html string").selectExpr("url", "cast(html as binary) html")).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(a - b) < 2e-6 for key in want for a, b in zip(got[key], want[key], strict=True))


def test_query(spark):
    got = queries.op11_html_text(spark, "/root/testdata/sf0.001")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r.html for r in queries.table(spark, "/root/testdata/sf0.001", "pages").collect()}
    rows = got.collect()
    assert len(rows) == len(pages) and all(r.text == Page(pages[r.page_id]).text({}) for r in rows)
