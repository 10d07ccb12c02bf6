import brute

from drawlog.llm import urls

URLS = [
    None, "", "no scheme/path", "://", "http://", "http://com", "http://com/", "https://A.COM/x", "http://notcom/", "http://example.com/en/", "http://example.com/en", "http://example.com/EN/",
    "http://www.example.com/en/1?x=/en/", "http://a.www.example.com/en/#f", "http://xwww.example.com/en/", "http://a.net/es/", "http://net/fr/?q", "http://a.net?x=/es/", "http://a.net#/fr/", "ftp://u@h.net:80/es/",
    "http://É.example.com/en/é", "http://free-bets.example.org/en/", "http://alphabets.example.org/", "http://poker.org", "http://x://y.com/", "http://a.net/es/" + "z" * 100_000,
]


def test_stated_rules_and_words(spark):
    rows = [(i, u, "host", "path", "rule") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute.url_row(URLS[r.page_id])
        assert (r.host, r.path, r.rule if r.stated else None) == (host, path, rule), URLS[r.page_id]
        if verdict:
            assert r.verdict == verdict
    by_url = {URLS[r.page_id]: (r.rule, r.verdict) for r in got}
    assert by_url["http://free-bets.example.org/en/"] == ("word:bets", "block")
    assert by_url["http://alphabets.example.org/"] == (None, "allow")
    assert by_url["http://poker.org"] == ("word:poker", "block")
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_index_takes_the_rarest_token():
    rules = [urls.prefix_rule("block", "example.com/en/"), urls.prefix_rule("allow", "com/open"), urls.Rule("any", "block", "[?]", ())]
    index, always = urls.rule_index(rules, {"com": 50, "example": 9, "en": 20})
    assert {t: [r.name for r in rs] for t, rs in index.items()} == {"example": ["example.com/en/"], "com": ["com/open"]}
    assert [r.name for r in always] == ["any"]


def test_many_rules_equal_trying_all(spark):
    import itertools
    import re

    hosts = ["a.com", "b.a.com", "c.net", "x.c.net"]
    paths = ["/", "/en/", "/en/q", "/fr", "/fr/z"]
    rules = [urls.prefix_rule(v, h + p) for v, h, p in zip(itertools.cycle(["block", "allow"]), hosts * 5, paths * 4)]
    pages = [(i, f"http://{h}{p}{x}") for i, (h, p, x) in enumerate(itertools.product(hosts, paths, ["", "1", "/en/", "?en"]))]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    for i, u in pages:
        host, path, _, _ = brute.url_row(u)
        fits = [r for r in rules if re.search(r.pattern, host + path)]
        best = min(fits, key=lambda r: (-r.level, -r.weight, r.name), default=None)
        assert got[i] == ((best.name, best.verdict) if best else (None, "allow"))
