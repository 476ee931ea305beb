import re

from relpredict.llm.url_rules import HOST_RULES, RULES, WORDS, UrlRule, host_rule, url_filter


def judge(url):
    """The contract, read naively."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in HOST_RULES:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.text), r.text, r.verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    blocked = re.search(rf"(^|[^A-Za-z0-9])({'|'.join(WORDS)})([^A-Za-z0-9]|$)", host + path)
    return host, path, None, "block" if blocked else "allow"


URLS = [
    "http://example.com/en/1", "https://WWW.Example.COM/en/1?x=/es/", "http://a.www.example.com/en/", "http://example.com",
    "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.net/en/#/es/", "http://com.org/x",
    "http://casino.org/x", "http://a.org/free-poker/1", "http://a.org/pokerface", "http://a.org/x?casino", "ftp://x.com/es/",
    "no scheme", "", None, "://", "http://ä.net/es/é", "http://com/" + "y" * 100_000, "http://a.net:80/es/", "http://a.net/ES/",
]


def test_against_the_contract(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])], "page_id bigint, url string")
    out = url_filter(frame.selectExpr("*", "'clash' AS host", "1 AS rule")).collect()
    assert len(out) == len(URLS) + 3
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge((URLS + URLS[:3])[r["page_id"]]), r
    assert url_filter(frame.limit(0)).count() == 0


def test_rules_without_tokens_and_literal_dots(spark):
    frame = spark.createDataFrame([(1, "http://q.zz/--"), (2, "http://q.zz/a"), (3, "http://exampleXorg/")], "page_id bigint, url string")
    rules = (UrlRule("block", "--"), host_rule("block", "example.org/"))
    assert {r["page_id"]: r["verdict"] for r in url_filter(frame, rules).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_tokens_stand_in_every_match():
    assert host_rule("block", "net/es/").tokens == ("net", "es")
    assert host_rule("block", "net/es").tokens == ("net",)  # a path may go on after es
    assert all(r.tokens for r in RULES)


def test_main_path_is_native(spark):
    plan = url_filter(spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
