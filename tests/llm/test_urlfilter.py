import random

from pixelspark.llm import urlfilter as u


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


def test_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["a", "b", "com", "net", "example", "www"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/x", "/en/", "y"]) for _ in range(rng.randint(0, 3)))
    rules = {(host(), rng.choice(["/", "/en/", "", "/x/", "/en/x"])): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(v, h, p) for (h, p), v in rules.items()] + u.RULES
    rules = [(v, h, p) for (h, p), v in {(h, p): v for v, h, p in rules}.items()]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{host().upper() if rng.random() < 0.2 else host()}{path()}{rng.choice(['', '?q=/en/', '#x://y'])}" for _ in range(800)]
    urls += [None, "", "nohost/en/", "http://", "http:///en/", "://com/", "x://com", "a\nb://net/es/1\n2", urls[0], urls[0], "http://com/" + "p" * 50_000]
    urls += ["http://www.example.com/en/1"] * 500
    pages = spark.createDataFrame([(k, x, "clash", "clash2", 1) for k, x in enumerate(urls)], "page_id long, url string, Host string, verdict string, key int").repartition(3)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(pages, u.rule_table(spark, rules)).collect()}
    assert len(found) == len(urls)
    for k, x in enumerate(urls):
        assert found[k] == brute(x, rules), x


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = u.rule_table(spark, u.RULES).limit(0)
    assert [r.verdict for r in u.judge_urls(pages, none).collect()] == ["allow"]
    assert u.judge_urls(pages.limit(0), u.rule_table(spark, u.RULES)).count() == 0
    odd = spark.createDataFrame([("a.com", "/", "block"), ("a.com", "/", "allow"), (None, "/", "block"), ("", "", "block"), ("a.com", None, "allow")], "host string, path string, verdict string")
    assert [r.verdict for r in u.judge_urls(pages, odd).collect()] == ["block"]
