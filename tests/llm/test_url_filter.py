import itertools
import math

from readroute.llm.url_filter import RULES, SEEDS, segment, url_filter

URLS = [
    "http://a.example.com/en/7?x", "https://A.Example.COM/en/8#/x", "com/en/", None, "", "http://com/en/", "http://com", "x://net/de/8", "x://example.net/de/8",
    "x://b.example.net/de/81/?q", "x://xorg/es/", "x://a.org/es/", "x://a.org?/es/", "x://a.org/ES/", "http://h/p://q/r", "http://spamfarm.io/a9", "ftp://goodwords.dev/", "x://É.net/de/é?é",
    "x://" + "b" * 3000 + ".net/de/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def ruled(host, path):
    fit = []
    for verdict, rule in RULES:
        top, _, rest = rule.partition("/")
        if (host == top or host.endswith("." + top)) and path.startswith("/" + rest):
            fit.append((len(rule), rule, verdict))
    return max(fit)[1:] if fit else (None, None)


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (3, URLS[0]), (None, URLS[1])], "page_id long, url string").selectExpr("*", "'<p>good words farm</p>' as html", "1 as id", "2 as host", "'x' as verdict", "3 as HTML", "4 as words")
    rows = url_filter(pages, seeds=SEEDS).collect()
    assert len(rows) == len(URLS) + 2
    urls = dict(enumerate(URLS))
    for r in rows:
        if r.page_id in urls and not (r.page_id == 3 and r.host):
            assert (r.host, r.path) == parts(urls[r.page_id]), r
            rule, verdict = ruled(r.host, r.path)
            assert r.rule == rule and r.verdict == (verdict or ("block" if r.score > 0 else "allow"))
    by_id = {r.page_id: r for r in rows}
    assert by_id[15].host_words == ["spam", "farm", "io"] or by_id[15].host_words[:2] == ["spam", "farm"]
    assert by_id[15].verdict == "block"
    assert by_id[16].host_words[:2] == ["good", "words"]


def test_viterbi_is_the_best_of_all_splits():
    counts = {"the": 90, "re": 30, "there": 10, "a": 50, "in": 40, "rein": 1, "he": 20, "t": 2}
    total = sum(counts.values())

    def p(w):
        return math.log(counts[w] / total) if w in counts else math.log(1 / total) - len(w) * math.log(10)

    for run in ("there", "therein", "ainthere", "xthe", "thx", "rerere", "zq"):
        best = -math.inf
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            words, word = [], run[0]
            for c, letter in zip(cuts, run[1:]):
                if c:
                    words.append(word)
                    word = ""
                word += letter
            best = max(best, sum(map(p, [*words, word])))
        assert math.isclose(sum(map(p, segment(run, counts, total))), best)


def test_bayes_scores(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'fine'}.site/{'buy' if i % 2 else 'read'}/{i}") for i in range(40)]
    pages = spark.createDataFrame([(i, u, "bad fine site") for i, u in rows], "page_id long, url string, html string")
    found = {r.page_id: r for r in url_filter(pages, rules=[("block", "bad.site/buy/1"), ("allow", "fine.site/read/2")], seeds=()).collect()}
    assert all(found[i].verdict == ("block" if i % 2 else "allow") for i in range(40))
    none = url_filter(pages, rules=[], seeds=()).collect()
    assert {r.verdict for r in none} == {"allow"} and url_filter(pages.limit(0)).count() == 0


def test_long_words_and_runs(spark):
    long = "incomprehensibilities" * 2  # 42 letters
    counts = {long: 5, "the": 90}
    assert segment("the" + long + "the", counts, 100) == ["the", long, "the"]
    assert segment("q" * 5000, counts, 100) == ["q" * 5000]
    pages = spark.createDataFrame([(1, f"http://the{long}.io/", f"{long} the the"), (2, "http://the.the/", None), (3, "http://1.2/", "")], "page_id long, url string, html string")
    assert {r.page_id: r.host_words for r in url_filter(pages).collect()} == {1: ["the", long, "io"], 2: ["the", "the"], 3: []}


def test_rules_alone_teach_by_default_and_empty_tables(spark):
    schema = "page_id long, url string, html string"
    assert url_filter(spark.createDataFrame([], schema)).count() == 0
    pages = [(k, f"http://bad{k}.com/en/win-prize-{k}", "<p>win prize bad good news</p>") for k in range(20)] + [(50 + k, f"http://good{k}.net/de/news-{k}", "<p>good news</p>") for k in range(20)]
    pages += [(100, "http://spam.io/win-prize", ""), (101, "http://spam.io/news", ""), (102, "http://spam.io/", None)]
    rows = {r.page_id: r for r in url_filter(spark.createDataFrame(pages, schema)).collect()}
    assert rows[100].verdict == "block" and rows[101].verdict == "allow" and rows[102].verdict == "allow"
    seeded = {r.page_id: r for r in url_filter(spark.createDataFrame(pages, schema), seeds=SEEDS).collect()}
    assert seeded[102].verdict == "block" and seeded[102].score > rows[102].score
