import itertools
import re

import duckdb

from chartloom.llm import url_filter

FOUND = """http://best-bet.org/ http://free-bet.example.org/ http://a.online-bets.org/ http://porn.example.org/ http://xxxvideos.example.org/ http://topreplica-watches.org/ http://replica-watch.org/
    http://buycheap-pills.org/ http://cheap-pills24.org/ http://Buycheap-Pills24.org/ http://a.org/x-porn/tubes http://a.org/casino http://poker.org/ http://a.org/warez/x""".split()
FREE = "http://abc.org/bets http://bestbets.org/ http://a.org/xxx http://replica-watcher.org/ http://cheap.org/pills http://porntube1.org/porn http://docs.porn.org/a?clickid=1".split()


def judged(spark, urls, rules=url_filter.PATTERN_RULES, most=url_filter.MAX_RULES):
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), pattern_rules=rules, max_rules=most).collect()
    return {r.page_id: r.verdict for r in rows}


def matching(rule):
    """Urls made from a generated rule's own words, each of which it matches."""
    kind, *rest = rule.name.split(":")
    w = rest[-1]
    if kind == "sale":
        made = [f"http://a.org/{rest[0]}-{w}", f"https://{rest[0]}.best.{w}.org/", f"http://x-{rest[0]}_{w}?a=1"]
    elif kind == "farm":
        made = [f"http://a.org/?{w}=0123456789ab", f"http://a.org/x?y=1&{w}=0123456789abcdef#z"]
    elif rest[0] == "host":
        made = [f"http://{w}.org/", f"https://my-{w}.example.org", f"HTTP://{w.upper()}-24.org:80/x", f"http://a.{w}?q"]
    else:
        made = [f"http://a.org/{w}", f"http://a.org/x/best_{w}.html", f"http://a.org/{w}-24/?q=1"]
    assert all(re.search(rule.regex, u.lower()) for u in made), (rule, made)
    return made


def test_every_generated_rule_is_fetched(spark):
    rules = url_filter.generated_rules()
    assert len(rules) > 200 and len({r.name for r in rules}) == len(rules)
    urls = [u for r in rules for u in matching(r)]
    for most in (url_filter.MAX_RULES, 0):
        assert set(judged(spark, urls, rules, most).values()) == {"block"}


def test_rows_of_every_kind_both_ways(spark):
    urls = [None, "", "no url", "http://", "://x", "http://a.org/casino", "http://a.org/" + "x/" * 50_000 + "casino", "http://a.example.com/en/casino", "http://b.net/es/"]
    rows = [(i, u, "h", "v", 1) for i, u in enumerate(urls)] + [(5, urls[5], "h", "v", 1), (None, None, None, None, None)] + [(100 + i, "http://hot.org/casino/" + "y" * (i % 2), "h", "v", 2) for i in range(3000)] + [(9000 + i, None, "h", "v", 2) for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, action string, n int")
    got = [sorted(map(str, url_filter.judge_urls(pages, max_rules=most).collect())) for most in (url_filter.MAX_RULES, 0)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    by_id = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert [tuple(by_id[i])[1:] for i in range(6)] == [("", "", None, "allow")] * 4 + [("x", "", None, "allow"), ("a.org", "/casino", None, "block")]
    assert by_id[6].verdict == "block" and tuple(by_id[7])[3:] == ("example.com/en/", "block") and tuple(by_id[8])[3:] == ("net/es/", "block")
    assert by_id[None].verdict == "allow" and {by_id[100 + i].verdict for i in range(3000)} == {"block"}
    for most in (url_filter.MAX_RULES, 0):
        assert url_filter.judge_urls(pages.limit(0), max_rules=most).collect() == []


def test_index_finds_what_every_rule_on_every_url_finds(spark):
    hosts = "free best online bet bets xxx porn tube tubes cheap pills buycheap pills24 replica topreplica watch watches casino poker warez".split()
    urls = FOUND + FREE + [f"http://{a}{s}{b}.org/" for a, b in itertools.product(hosts, hosts) for s in ("-", ".", "")] + [f"http://a.org/{a}/{b}" for a, b in itertools.product(hosts, hosts)]
    urls += ["HTTP://docs.a.org/x?clickid=0123456789abcdef0", "http://b.org/x?a=1&clickid=0123456789abcdef0", None, "", "no url"]
    got = judged(spark, urls)
    assert [got[i] for i in range(len(FOUND))] == ["block"] * len(FOUND)
    pages = duckdb.connect()
    pages.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    pages.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert got == {r[0]: r[4] for r in pages.execute(url_filter.oracle()).fetchall()}
    assert got == judged(spark, urls, most=0)


def test_every_named_token_is_sure(spark):
    for url, rule in itertools.product(FOUND + FREE, url_filter.PATTERN_RULES):
        if re.search(rule.regex, url.lower()):
            tokens = set(re.split("[^a-z0-9]+", url.lower()))
            assert all(tokens & ({part} if isinstance(part, str) else set(part)) for part in rule.tokens), (url, rule)


def test_rules_without_and_with_only_sure_tokens(spark):
    for rules in ((url_filter.PatternRule("a", "block", "casin"),), (url_filter.PatternRule("b", "block", "-casino-", ("casino",)),), ()):
        want = {0: "block" if rules and re.search(rules[0].regex, "http://my-casino-x.org/") else "allow", 1: "block" if rules and rules[0].name == "a" else "allow"}
        assert judged(spark, ["http://my-casino-x.org/", "http://casinos.org/"], rules) == want
