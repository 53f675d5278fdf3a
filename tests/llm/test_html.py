import html as entities
import re
import time

from cubeloom.llm import html
from cubeloom.llm.common import read

SCHEMA = "page_id long, url string, html string, text string, host string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h2>Head &amp; line</h2></header><p>One  <b>two</b>
three&nbsp;&#233;<p>Four<script>var x="</p><p>no";</script> five<aside>Ad</aside><div class="ad-box">Buy</div><ul><li>item 1<li>item 2</ul><form><input> Send</form><pre>a
 b</pre>1 < 2 &copy<!-- no --></article><section id="comments"><p>I agree</p></section><footer>End</footer></body></html>"""


def test_article_without_the_rest():
    assert html.extract(PAGE) == "Head & line\nOne two three é\nFour five\nitem 1\nitem 2\na b\n1 < 2 ©"


def test_pages_without_article_are_read_by_their_wrapper():
    page = lambda n, more="": f"<html><body><div class='top'>My shop</div><div id=content><h1>Story {n}</h1>" + "".join(f"<p>Par {n} {i}</p>" for i in range(n + 1)) + f"{more}</div><div class='x'><a href=1>next</a> <a href=2>last one</a></div><div class='bottom'>Since 1999</div></body></html>"
    wrapper = html.infer([page(1), page(2), page(3), page(3)])
    assert wrapper["fixed"] == ["My shop", "Since 1999", "next last one"] and any(isinstance(x, tuple) for x in wrapper["wrapper"])
    assert html.extract(page(7), wrapper) == "\n".join(["Story 7", *(f"Par 7 {i}" for i in range(8))])


def test_names_count_as_whole_tokens_of_containers():
    cases = {
        '<div class="layout with-sidebar"><article><p>A</p></article></div>': "A",
        '<main><div class="post has-sidebar"><p>B</p></div></main>': "B",
        '<div class="content no-comments"><p>C</p></div>': "C",
        '<article><div class="article-header"><h1>D</h1></div><div class="header"><h2>d</h2></div><p>x</p></article>': "D\nd\nx",
        '<article><div class="comment-policy-explained"><p>E</p></div></article>': "E",
        "<p title=it's>F</p><p>next</p>": "F\nnext",
        "<div><p>see <a href=x>all linked text here</a></p></div>": "see all linked text here",
        '<div class="related"><article>teaser</article></div><article>real</article>': "real",
        '<div class="sidebar"><article>the only one</article></div>': "the only one",
        "<article>x<section class=post-comments><article class=comment>c</article></section></article>": "x",
        "<article class=post>story</article><section id=comments><article class=comment>c</article></section>": "story",
        '<p data-role=banner title="hidden gems">G</p>': "G",
        '<article><div class=ad-box>Buy</div><div class="ad-3-unit">z</div><nav>n</nav><form>f</form>t</article>': "t",
        "<article><p>A</p><select><option>o</select><p>B</p></article>": "A\nB",
        "<article><p>A<select><option>o<optgroup><option>p</select> b</p><datalist><option>q</datalist></article>": "A b",
        '<article><p>A</p><ul class="commentlist"><li>no</ul><div class="fb-comments">no</div><ol id="commentsList"><li>no</ol></article>': "A",
        '<article><p>A</p><div class="comment-body">no</div><div class="comment-author">no</div><div class="commenting-rules">B</div></article>': "A\nB",
        '<article><div class="article-body"><p>A</p></div><div class="searchable text-body">B</div></article>': "A\nB",
        '<div hidden>no</div><div style="display: none">no</div><p>yes</p>': "yes",
    }
    for source, text in cases.items():
        assert html.extract(source) == text, source


def test_deep_pages_are_read_in_linear_time():
    n = 30_000
    began = time.perf_counter()
    found, _ = html.blocks("<div>" * n + "x" + "<p>y" * n)
    assert len(found) == n + 1 and len(html.blocks("<div>" + "<b>" * n + "x" + "<p>y</i>" * n)[0]) == n + 1
    assert time.perf_counter() - began < 20


def test_the_wrapper_decides_where_there_is_no_article(spark):
    page = lambda n: f"<html><body><div class=a>Our shop</div><div class=b><h1>Story {n}</h1><p>Text {n}</p></div><div class=c>Call us</div></body></html>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(9)] + [(9, "https://other.example/", page(9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert all(got[i] == f"Story {i}\nText {i}" for i in range(9)) and got[9] == "Our shop\nStory 9\nText 9\nCall us"
    wrapper = html.infer([page(i) for i in range(4)])
    assert html.extract(page(5), wrapper) == "Story 5\nText 5" and html.extract(page(5), {}) != "Story 5\nText 5"


def test_alignment():
    one, two = ["<ul>", "<li>", "#", "</li>", "<li>", "#", "</li>", "</ul>"], ["<ul>", "<li>", "#", "</li>", "<li>", "#", "</li>", "<li>", "#", "</li>", "</ul>", "<p>", "#", "</p>"]
    a, b = html.fold_repeats(one), html.fold_repeats(two)
    assert a == ["<ul>", ("+", ("<li>", "#", "</li>")), "</ul>"] and b[:3] == a
    assert html.align(a, b) == [*a, ("?", ("<p>",)), ("?", ("#",)), ("?", ("</p>",))]


def test_whole_table_equals_a_plain_reading(spark):
    pages = read(spark, "/root/testdata/sf0.001", "pages")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    for r in pages.collect():
        body = r["html"].split("<article>", 1)[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>|<(?:p|/p)?\Z", re.sub("<br>", " ", re.sub(r"</?b>|<br?\Z", "", body)))
        assert got[r["page_id"]] == "\n".join(t for t in (" ".join(entities.unescape(p).split()) for p in parts) if t)


def test_edge_cases(spark):
    rows = [(1, None, None, "x", "h"), (2, "::bad", "", "", ""), (None, "http://h/a", "<p>cut <b>off &am", "", ""), (3, "http://H/b", "plain & text", "", ""), (3, "http://h/b", "plain & text", "", ""), (4, "http://h/c", "<article>" + "<p>long</p>" * 30_000, "", ""), (5, "http://h/d", "<<<>>> </ x> <!", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["page_id"] or 0, r["text"]) for r in html.main_text(df).collect())
    assert [t for _, t in got[:4]] == ["cut off &am", "", "", "plain & text"] and got[4][1] == "plain & text" and got[5][1].count("long") == 30_000
    assert html.main_text(df.limit(0)).count() == 0


def test_texts_have_the_slots_of_the_wrapper():
    page = lambda n, date=True: f"<body><div><p>By author {n}</p><hr>{'<h2>Date ' + str(n) + '</h2>' if date else ''}<ul>" + "".join(f"<li>Item {n} {i}</li>" for i in range(n)) + "</ul><p>Shop</p></div></body>"
    wrapper = html.infer([page(1), page(2), page(3), page(4, False)])["wrapper"]
    assert sum(x[0] == "+" for x in wrapper) == 1 and any(x[0] == "?" for x in wrapper)
    for n, date in ((1, True), (6, True), (2, False)):
        found, stream = html.blocks(page(n, date))
        slots = dict(zip((b[1] for b in found), html.match(wrapper, stream)))
        assert len({v for k, v in slots.items() if k.startswith("Item")}) == 1 and all(v[0] != "#" for v in slots.values())
        assert slots[f"By author {n}"] != slots["Shop"]  # one place, two slots


def test_pages_are_read_by_slots_and_not_by_places():
    page = lambda n: f"<body><div><p>{'Shop' if n else 'New'}</p><h2>Story {n}</h2><p>{'Text' if n > 1 else 'Shop'} {n}</p></div></body>"
    wrapper = html.infer([page(n) for n in range(2, 6)])
    out = {**wrapper, "places": {s: "out" if s == html.match(wrapper["wrapper"], html.blocks(page(9))[1])[0] else v for s, v in wrapper["places"].items()}, "fixed": []}
    assert html.extract(page(9), out) == "Story 9\nText 9"


def test_long_pages_are_aligned_too():
    rows = lambda n: "".join(f"<h{i % 5 + 1 if i % 7 else 6}>{n} {i}</h{i % 5 + 1 if i % 7 else 6}>" for i in range(600))
    page = lambda n: f"<body><div id=top>Shop</div>{rows(n)}<div>{n}</div></body>"
    wrapper = html.infer([page(n) for n in range(4)])["wrapper"]
    assert len(wrapper) > 400 and all(s[0] != "#" for s in html.match(wrapper, html.blocks(page(9))[1]))


def test_common_is_longest_also_when_halved():
    import random

    r = random.Random(3)
    x, y = ([r.randrange(9) for _ in range(2200)] for _ in range(2))
    found = html.common(x, y)
    row = [0] * (len(y) + 1)
    for v in x:
        new = [0]
        for j, w in enumerate(y):
            new.append(row[j] + 1 if v == w else max(row[j + 1], new[-1]))
        row = new
    assert len(found) == row[-1] and all(x[i] == y[j] for i, j in found) and found == sorted(found)


def test_fixed_texts_and_slots_are_counted_over_all_pages(spark):
    def page(n):
        notice = "<div><p>Since 1999</p></div>" if n % 10 else ""  # most pages, not all
        passage = "<p>A passage of near copies</p>" if n < 8 else f"<p>Text {n}</p>"
        side = f"<div id=sidebar><p>Hot {n}</p></div>" if n % 3 else ""
        return f"<body>{notice}<div id=content><h2>Story {n}</h2>{passage}</div>{side}</body>"

    pages = [(n, f"http://h/{n}", page(n), "", "") for n in range(40)] + [(100, "http://two/a", page(3), "", ""), (101, "http://two/b", page(3), "", "")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    for n in range(40):
        assert got[n] == f"Story {n}\n" + ("A passage of near copies" if n < 8 else f"Text {n}")
    assert got[100] == got[101] == "Since 1999\nStory 3\nA passage of near copies"  # a host of one page drops nothing


def test_pages_made_otherwise_than_the_sample_are_labelled_too(spark):
    links = lambda n: f"<div class=z><a href=1>more {n}</a> <a href=2>last {n}</a></div>"
    apart = lambda n: f"<div class=x><h2>Story {n}</h2><p>Text {n}</p></div>{links(n)}"
    alike = lambda n: f"{links(n)}<h2>Story {n}</h2><div class=z>Text {n}</div>"  # noqa: E731 # in one place with the links
    for body in (apart, alike):
        rows = [(n, f"http://h/{n}", f"<body><div class={chr(97 + n % 20)}>{body(n)}</div></body>", "", "") for n in range(80)]  # 20 kinds of pages, 8 pages in the sample
        for per_host in (1, 8, 80):
            got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, SCHEMA), per_host).collect()}
            assert got == {n: f"Story {n}\nText {n}" for n in range(80)}


def test_a_fixed_text_counts_on_pages_whose_items_do_not_take_it(spark):
    notice = "<div class=n>Since 1999</div>"
    body = lambda n: f"<div id=content><h2>Story {n}</h2><p>a {n}</p><h3>b {n}</h3></div>"
    rows = [(n, f"http://h/{n}", f"<body>{notice + body(n) if n % 2 else body(n) + notice}</body>", "", "") for n in range(20)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert got == {n: f"Story {n}\na {n}\nb {n}" for n in range(20)}


def test_texts_that_no_item_takes_have_the_label_of_their_place():
    page = lambda n, first="": f"<body><div class=top><p>Shop {n}</p></div>{first}<div class=z><a href=1>go {n}</a></div></body>"
    wrapper = html.infer([page(n) for n in range(4)])
    assert html.extract(page(9, "<div class=z><hr><a href=1>other</a></div><p>Text</p>"), wrapper) == "Shop 9\nText"


def test_the_wrapper_comes_from_all_pages_of_a_host(spark):
    def page(n):  # 20 kinds of pages; one page of each has no link in the place of the links
        kind, own = chr(97 + n % 20), n // 20 == 4
        more = f"more {n}" if own else f"<a href=1>more {n}</a>"
        return f"<body><div class={kind}><h2>Story {n}</h2><p>Text {n}</p><div class=z>{more}</div></div></body>"

    df = spark.createDataFrame([(n, f"http://h/{n}", page(n), "", "") for n in range(100)], SCHEMA)
    for more in ((), (3,)):
        got = {r["page_id"]: r["text"] for r in html.main_text(df, *more).collect()}
        assert got == {n: f"Story {n}\nText {n}" for n in range(100)}


def test_merged_wrappers_take_all_texts_but_those_of_rare_places(spark):
    page = lambda n: f"<body><div id={chr(97 + n % 9)}{'rare' if n == 50 else ''}><h2>Story {n}</h2>{'<p>a</p>' * (n % 4)}{'<hr><ul><li>x<li>y</ul>' if n % 3 else ''}</div></body>"
    df = spark.createDataFrame([(n, f"http://h/{n}", page(n), "", "h") for n in range(120)], SCHEMA)
    streams = html.streams_of(html.parsed(df)).cache()
    assert streams.agg({"n": "sum"}).first()[0] == 120
    for at_once in (2, 5, 64):
        ((wrapper,),) = html.wrappers(streams, at_once).select("wrapper").collect()
        items = html.frozen(html.json.loads(wrapper))
        for n in range(120):
            assert any(s[0] == "~" for s in html.match(items, html.blocks(page(n))[1])) == (n == 50)
    assert html.wrappers(streams.limit(0)).count() == 0
