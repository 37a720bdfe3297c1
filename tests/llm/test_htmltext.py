import random
import re
import time

import pytest

from plumbline.llm import htmltext


def dp(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("cells", [1 << 26, 8])
def test_common_is_a_longest_common_subsequence(cells):
    rng = random.Random(1)
    for _ in range(600):
        a, b = ([rng.randrange(rng.choice((2, 6, 20))) for _ in range(rng.randrange(14))] for _ in range(2))
        got = htmltext.common(a, b, cells)
        assert got == sorted(set(got)) and len(got) == dp(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def text(html, partner=None):
    own, other = ([x.text for x in htmltext.lines(h or "")] for h in (html, partner))
    return htmltext.main_text(htmltext.lines(html), set(htmltext.common(own, other)))


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <article>x</article> -->
      <div class="cookie-notice">We use cookies</div><div class='ad'>Buy</div>
      <article class="post"><h1>Title &amp; more</h1><p><b>Bo</b>ld&nbsp;and &lt;i&gt; &#233;&eacute;
      text<br>next</p><aside>side</aside><form><input>name</form><p>a > b &am &amp</p><div id="comments"><p>reader</p></div>
      <script>if (a < b) {}</script><p>open <i>end</article><footer>&copy; x</footer></body>"""
    assert text(page) == "Title & more Bold and <i> éé text next a > b &am & open end"
    assert text("") == "" and text("<p></p>") == "" and text("plain <b>te</b>xt") == "plain text"
    assert text("<div class=ad>x<article><p>kept</p></article>") == "kept"
    assert text("<nav>menu<main><p>kept</p></main>") == "kept"
    assert text("<main><p>a</p><article><p>b</p></article></main>") == "b"
    assert text("<article><p>a</div>b</p></article>c") == "a b"
    assert text("<article><p title='x > y'>a</p><script>never closed") == "a"
    assert text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("word") == 50_000


def test_differencing_decides_without_markup():
    site = "<div>Home | About</div><div>{}</div><div>All rights reserved</div><div>{}</div>"
    assert text(site.format("one story", "more"), site.format("other story", "less")) == "one story more"
    assert text("<article>" + site.format("a", "b") + "</article>", site.format("a", "b")) == "Home | About a All rights reserved b"


TEASER = "<article><p>Read this next, on all pages</p></article>"


def test_differencing_decides_among_articles():
    page = lambda body: f"<div>Home</div>{body}{TEASER}"
    one, other = (page(f"<article><p>{x} story, told at length and in full</p><p>a quote of both</p></article>") for x in ("one", "other"))
    assert text(one, other) == "one story, told at length and in full a quote of both"
    one, other = (page(f"<main><p>{x} story, told at length and in full</p><p>a quote</p></main>") for x in ("one", "other"))
    assert text(one, other) == "one story, told at length and in full a quote"
    one, other = (page(f"<div>{x} story, told at length and in full</div>") for x in ("one", "other"))
    assert text(one, other) == "one story, told at length and in full"
    copy = "<article><p>a story that two pages hold</p></article><div>{}</div>"
    assert text(copy.format("buy"), copy.format("sell")) == "a story that two pages hold"
    nested = "<article><p>{}</p>" + TEASER + "</article>"
    assert text(nested.format("a"), nested.format("b")) == "a Read this next, on all pages"


def test_a_story_in_main_is_not_left_out_for_longer_text():
    page = "<main>story {}<article>part of both</article></main>" + TEASER
    assert text(page.format("one"), page.format("other")) == "story one part of both"
    page = TEASER + "<main><p>story {0}</p></main><div>buy {0}, which is far longer than the story on this page</div>"
    assert text(page.format("one"), page.format("other")) == "story one"
    page = "<main><article><p>a story that two pages hold</p></article><p>read {} times</p></main>"
    assert text(page.format(1), page.format(2)) == "a story that two pages hold read 1 times"
    page = "<main>a {}<article>b<main>c</main></article><main>d</main>e</main><div>f</div>"
    assert text(page.format(1), page.format(2)) == "a 1 b c d e"


@pytest.mark.parametrize("partitions", [1, 7])
def test_articles_of_the_template_go(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for i in range(120):
        body = rng.choice(["<article>story {}</article>", "<main>story {}<article>part</article></main>", "<div>story {}</div>", "<article>copy</article>"]).format(rng.randrange(40))
        rows.append((i, f"http://{rng.choice('ab')}.net/{i // 9}", f"<div>menu</div>{body}{TEASER if rng.random() < 0.7 else ''}"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    alone = {i: text(html) for i, _, html in rows}
    assert got == dict(enumerate(brute(rows))) and sum(got[i] != alone[i] for i in alone) > 20


def brute(rows):
    """Text of each row: sorted, each run of equal pages against the run before it on the host, or after it."""
    split = lambda url: re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)", url or "").groups()
    order = sorted(range(len(rows)), key=lambda i: (split(rows[i][1])[0].lower(), split(rows[i][1])[1], rows[i][0]))
    runs = []
    for i in order:
        host, page = split(rows[i][1])[0].lower(), htmltext.lines(rows[i][2] or "")
        keys = [x.text for x in page]
        if not runs or runs[-1][:2] != (host, keys):
            runs.append((host, keys, []))
        runs[-1][2].append((i, page))
    out = {}
    for k, (host, keys, members) in enumerate(runs):
        near = [runs[j][1] for j in (k - 1, k + 1) if 0 <= j < len(runs) and runs[j][0] == host]
        for i, page in members:
            out[i] = htmltext.main_text(page, set(htmltext.common(keys, near[0])) if near else set())
    return [out[i] for i in range(len(rows))]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_query(spark, partitions):
    site = "<div>{host} menu</div><div>story {n}</div><div>bottom {host}</div>"
    rows = [(n, f"http://h{n % 3}.org/p/{n:03}?q={n}", site.format(host=n % 3, n=n)) for n in range(60)]
    rows += [(100 + n, f"http://h0.org/copy/{n}", site.format(host=0, n="same")) for n in range(30)]  # equal pages
    rows += [(200, "http://alone.org/", "<div>only one</div>"), (201, None, None), (202, "", ""), (203, "not a url", "<article>x</article>"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = htmltext.extract(df).collect()
    empty = htmltext.extract(df.limit(0)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {n: f"story {n}" for n in range(60)} | {100 + n: "story same" for n in range(30)} | {200: "only one", 201: "", 202: "", 203: "x"}
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted((r[0], want[r[0]], len(want[r[0]])) for r in rows)
    assert [want[r[0]] for r in rows] == brute(rows)
    assert {r.page_id: r.url for r in got} == {r[0]: r[1] for r in rows} and empty == []


@pytest.mark.parametrize("partitions", [2, 9])
def test_pairs_do_not_depend_on_ranges(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for i in range(150):
        host, blocks = rng.choice("ab"), [f"menu {rng.randrange(2)}", *(f"line {rng.randrange(6)}" for _ in range(rng.randrange(3)))]
        rows.append((i, f"http://{host}.net/{i // 40}", "".join(f"<div>{b}</div>" for b in blocks) if rng.random() < 0.5 else "<div>menu 0</div><div>same</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dict(enumerate(brute(rows)))


@pytest.mark.parametrize("html", ['<a "' * 250_000, "<a '" * 100_001, "<p>" * 100_000, "<p><b>x</b>" * 50_000, "<p>" * 50_000 + "<article>" + "</p>" * 50_000, "<" * 500_000, "<script/>" * 50_000, "<a x" * 200_000 + ' ">"'])
def test_broken_pages_take_linear_time(html):
    began = time.process_time()
    htmltext.lines(html)
    assert time.process_time() - began < 10


def test_unclosed_markup():
    text = lambda html: [(x.text, x.inside) for x in htmltext.lines(html)]
    assert text("<p>a<p>b<div>c<a href='x>y'>d</a> e") == [("a", ""), ("b", ""), ("cd e", "")]
    assert text("<nav>menu<article>a<p>b</nav>c</article>d</nav>e") == [("a", "article"), ("b", "article"), ("c", "article"), ("e", "")]
    assert text('a < b <c "d <p>e</p>') == [("a < b", ""), ("e", "")]
    assert text("a<!-- <p>b") == [("a", "")] and text("<script>x") == [] and text("a<b") == [("a<b", "")]
