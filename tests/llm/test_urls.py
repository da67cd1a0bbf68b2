import pytest

from glossa.llm import urls


def plain(url, rules):
    """The rule by string tests alone."""
    host, path = urls.host_and_path(url)
    best = None
    for verdict, rule in rules:
        rhost, slash, rpath = rule.partition("/")
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(slash + rpath):
            rank = (len(rule), verdict == "block")
            best = max(best or (rank, rule, verdict), (rank, rule, verdict))
    return (host, path, best[1], best[2]) if best else (host, path, None, "allow")


URLS = [
    None, "", "example.com/en/1", "http://", "http:///en/", "https://Example.COM/en/7", "https://a.example.com/en/77?x=/en/", "https://a.example.com/en/6#y",
    "https://badexample.com/en/7", "https://x.com/en", "https://x.com/en/", "ftp://net/de/", "http://example.net/de/8", "http://q.example.net/de/81", "http://example.net/de/9",
    "http://org/es/x://y", "http://ÄB.org/es/", "http://a.com?x=1/en/", "http://a.com#/en/", "http://u@b.com:80/en/", "http://.com/en/q", "http://a.com//en/", "x" * 50000 + "://a.com/en/" + "y/" * 20000,
]


@pytest.mark.parametrize("max_rules", [200_000, 2])
def test_every_url_gets_the_longest_rule(spark, max_rules):
    rows = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)] + [(0, None, "k")], "page_id long, url string, host string")
    got = urls.filter_urls(rows, max_rules=max_rules).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[r.page_id], urls.RULES)


def test_ties_block_and_host_rules(spark):
    rules = [("allow", "a.com/x"), ("block", "a.com/x"), ("block", "b.com"), ("allow", "b.com/ok/")]
    rows = spark.createDataFrame([(1, "http://a.com/xy"), (2, "http://b.com"), (3, "http://c.b.com/ok/1"), (4, "http://b.com/no")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(rows, rules).collect()} == {1: ("a.com/x", "block"), 2: ("b.com", "block"), 3: ("b.com/ok/", "allow"), 4: ("b.com", "block")}


@pytest.mark.parametrize("max_rules", [200_000, 1])
def test_a_long_path_beats_a_deep_host(spark, max_rules):
    rules = [("block", "com/aaaaaaaaaaaaaaaa"), ("allow", "example.com/a")]
    rows = spark.createDataFrame([(1, "http://www.example.com/aaaaaaaaaaaaaaaa"), (2, "http://www.example.com/ab")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(rows, rules, max_rules=max_rules).collect()} == {1: ("com/aaaaaaaaaaaaaaaa", "block"), 2: ("example.com/a", "allow")}


def test_empty(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert urls.filter_urls(spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string"), []).first().verdict == "allow"
