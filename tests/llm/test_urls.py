import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.llm import urls


def split_url(url):
    """Host and path by the definition."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def plain(url):
    """Every rule on every URL, without an index."""
    host, path = split_url(url)
    if not host and not path:
        return host, path, None, "allow"
    fits = [r for r in urls.HOST_RULES if re.match(r.regex, host + path)]
    if fits:
        best = max(fits, key=lambda r: r.length)
        return host, path, best.name, best.verdict
    return host, path, None, "block" if any(re.search(r.regex, host + path) for r in urls.PATTERNS) else "allow"


def test_every_url_against_all_rules(spark):
    rnd = random.Random(2)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "EXAMPLE.com", "badexample.com", "x.net", "net", "com", "spam-farm.example.org", "cheap-pills.io", "site.org", "example.com:80", "u@example.com", "com.org"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/EN/1", "/es/x", "/fr/", "/fr", "/wp-login.php", "/cart/", "/a/checkout/", "/en/?q=/es/", "?x=/en/", "#/en/", "/é/"]
    made = [(i, f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}", "h") for i in range(600)]
    made += [(1000, None, "h"), (1001, "", "h"), (1002, "no-scheme.com/en/", "h"), (1003, "://", "h"), (1004, "a://b://c.net/es/", "h"), (1, made[1][1], "h"), (None, "http://x.com/", "h"), (2000, "http://x.com/" + "y" * 100_000, "h")]
    df = spark.createDataFrame(made, "page_id long, url string, host string")
    got = sorted(((r.page_id is None, r.page_id or 0), r.host, r.path, r.rule or "", r.verdict) for r in urls.judge_urls(df).collect())
    want = []
    for i, u, _ in made:
        host, path, rule, verdict = plain(u)
        want.append(((i is None, i or 0), host, path, rule or "", verdict))
    assert got == sorted(want)
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    index = urls.RuleIndex(urls.HOST_RULES, {"com": 100, "example": 50, "en": 70, "www": 5, "net": 9, "es": 3, "fr": 20})
    assert {t: [r.name for r, _ in rules] for t, rules in index.by_token.items()} == {"com": ["com/"], "example": ["example.com/en/"], "www": ["www.example.com/en/"], "es": ["net/es/"], "net": ["net/fr/"]}


def test_host_and_path_of_odd_urls(spark):
    odd = [None, "", "x", "HTTP://A.Com/P?q#f", "x://h#f/a?b", "a://b://c/d", "://", "http://É.Com/É", "s3://h?/x", "h://?", "h:///p", "h://a b/c d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(odd)], "n long, url string")
    got = df.select("n", *[c.alias(n) for c, n in zip(urls.host_and_path(F.col("url")), ("host", "path"), strict=True)]).orderBy("n").collect()
    assert [(r["host"], r["path"]) for r in got] == [split_url(u) for u in odd]


def test_rules_from_a_table_and_rules_without_a_token(spark):
    table = spark.createDataFrame([("block", "bad.org", "/", None, None), ("block", None, None, r"/ads/\d+", ["ads"])], "verdict string, host string, path string, regex string, tokens array<string>")
    pages = spark.createDataFrame([("http://x.bad.org/", 1), ("http://good.org/ads/12", 2), ("http://good.org/", 3)], "host string, url long")
    verdicts = {r["url"]: r["verdict"] for r in urls.judge_urls(pages, "url", "host", urls.rules_of(table)).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow"}
    with pytest.raises(ValueError):
        urls.RuleIndex([urls.pattern_rule("block", "x", ())], {})
    with pytest.raises(ValueError):
        urls.rules_of(table, 1)
