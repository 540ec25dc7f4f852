import itertools
import random

import pytest

from readroute.llm import html_difference as hd


def texts(page):
    return [x.text for x in hd.page_lines(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple\n text", ["plain & simple text"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<article><h1>T &lt;1&gt;</h1><p><b>x <i>y</b> z<br>w<p>q&nbsp;r</article><footer>f</footer>", ["T <1>", "x y z w", "q r"]),
        ('<html><head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li>m</ul></nav><!-- <p>c</p> --><div class="ad">buy</div><article><p>text</p><aside>s</aside><p>more</p></article><footer>&copy; x</footer>', ["text", "more"]),
        ("<article>a<section id='comments'><article>c</article></section></article>", ["a"]),
        ("<main><h1>t</h1><form><p>f</p></form><p>x</p></main><p>out</p>", ["t", "x"]),
        ("<div class='site-header'>h</div><div class='post-content'><p>x</p><div class='newsletter'>n</div></div><div>rest</div>", ["x"]),
        ("<div class='page with-sidebar'><p>x</p><div id=sidebar><p>s</p></div></div>", ["x"]),
        ("<header><h1>site</h1></header><article><header><h1>title</h1></header><p>x</p></article>", ["title", "x"]),
        ("<article><div class='cookieNotice'>c</div><p role=alert>a</p><p hidden>h</p><p style='display: none'>d</p>x</article>", ["x"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]),
        ("<article><p>one &#x41;&#66;&unknown; &am</p><p>&quot;</p>", ['one AB&unknown; &am', '"']),
        ("<a title='x > y'>in</a> line <b", ["in line"]),
        ("<p>a < b <c></p><!-- never closed <p>x", ["a < b"]),
        ("<article><p>x</div></p>y</article>z", ["x", "y"]),
        ("<textarea><p>raw</textarea><p>x", ["x"]),
        ("<script>never closed <p>x", []),
        ("<article><pre>a\n  b</pre><ul><li>1<li>2</ul></article>", ["a b", "1", "2"]),
    ],
)
def test_lines(page, want):
    assert texts(page) == want


def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[j], row[j] + (x == y)))
            row = new
        return row[-1]

    for bits in (1 << 26, 8):
        monkeypatch.setattr(hd, "BITS", bits)
        for _ in range(400):
            a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
            at = hd.shared(a, b)
            assert at == sorted(set(at)) and len(at) == longest(a, b)
            rest = iter(b)
            assert all(a[k] in rest for k in at)


def site(host, n, rng, lang="en", article="div", extra=""):
    """(url, html, text) of pages whose own lines only differ from the site's by not being shared."""
    out = []
    top, bottom = [f"{host} start", "all about it"], ["read on", f"made by {host}"]
    for k in range(n):
        own = [" ".join(rng.choice(["red", "blue", "low", "high", "sun"]) + str(rng.randrange(10**6)) for _ in range(12)) for _ in range(rng.randrange(2, 5))]
        lines = [*top, *own, *bottom]
        out.append((f"http://{host}/{lang}/{k:03d}{extra}", f"<{article}>" + "".join(f"<p>{x}</p>" for x in lines) + f"</{article}>", "\n\n".join(own)))
    return out


def test_shared_lines_go_and_copies_stay(spark):
    rng = random.Random(5)
    pages = [*site("a.org", 40, rng), *site("b.org", 30, rng)]
    same = "<div><p>one text</p><p>published twice</p></div>"
    pages += [("http://c.org/1", same, "one text\n\npublished twice"), ("http://c.org/2", same, "one text\n\npublished twice")]
    pages += [("http://d.org/x", "<div>alone</div>", "alone"), (None, "<p>no url</p>", "no url"), ("no scheme", "<p>no host</p>", "no host"), ("http://e.org/", None, ""), ("http://e.org/", "", "")]
    pages += [(u, h, t) for u, h, t in [("http://f.org/1", "<article><p>same</p><p class='x'>tool</p><p>own</p></article>", "same\n\nown"), ("http://f.org/2", "<article><p>same</p><p class='x'>tool</p><p>other</p></article>", "same\n\nother")]]
    table = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string, TEXT string, host int").repartition(3)
    rows = hd.html_difference(table).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == pages[r.page_id][2] and r.n_chars == len(r.text) and r.url == pages[r.page_id][0], r


def test_the_partition_does_not_matter(spark):
    """Against neighbours found by sorting all pages in one place."""
    rng = random.Random(6)
    pages = [p for h in ("x.org", "y.org", "z.org") for p in site(h, rng.randrange(2, 25), rng, extra=rng.choice(["", "/", "?a=1"]))]
    pages = [(i, *p) for i, p in enumerate(pages + pages[:3])]
    split = lambda u: (u.split("://")[1].split("/")[0], "/" + u.split("://")[1].split("/", 1)[1].split("?")[0])
    order = sorted(pages, key=lambda p: (*split(p[1]), p[1], str(p[0])))
    made = []
    for i, u, h, _ in order:
        lines = hd.page_lines(h)
        made.append(hd.Page(*split(u), lines, [x.text for x in lines], (i,)))
    want = {p.row[0]: "\n\n".join(hd.difference(p, b, a)) for b, p, a in zip([None, *made], made, [*made[1:], None])}
    for n in ("1", "4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {r.page_id: r.text for r in hd.html_difference(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").coalesce(1)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want, n


def test_empty_table_odd_ids_and_long_pages(spark):
    schema = "page_id string, url string, html string"
    assert hd.html_difference(spark.createDataFrame([], schema)).count() == 0
    long = "<div>" * 3000 + "<p>x<b>" * 20000 + "<!--" * 10000
    rows = hd.html_difference(spark.createDataFrame([("a", "http://h/1", long), (None, "http://h/1", "<p>y"), (None, "http://h/1", "<p>y")], schema)).collect()
    assert sorted(r.n_chars for r in rows) == [1, 1, 20000 * 3 - 2]


def test_many_equal_lines_are_aligned_in_time():
    a = [str(k % 7) for k in range(20000)]
    b = [str(k % 5) for k in range(15000)]
    at = hd.shared(a, b)
    assert len(at) == len(hd.shared(b, a)) and all(x < y for x, y in itertools.pairwise(at))
