import random
import re

from refrain.llm.url_rules import RULES, judge_urls

RULE = "host string, path string, verdict string"


def judged(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, urls, rules, slabs=None):
    pages = spark.createDataFrame([(i, u, "x", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    df = judge_urls(pages, spark.createDataFrame(rules, RULE))
    assert df.columns == ["page_id", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_cases(spark):
    urls = [
        None, "", "no scheme", "http://", "http://com", "http://COM/", "https://WWW.Example.com/en/1?x=/es/", "https://example.com/en/", "https://example.com/en",
        "http://xexample.com/en/", "http://a.b.net/es/1", "http://net/fr/#x", "http://a.net?x/es/", "x://y://z/com/", "http://com./en/", "http://É.com/Ä", "http://a..net/es/", "http://\x01.com/", "http://u:p@example.com:80/en/",
    ]
    check(spark, urls, RULES)


def test_random_nested_rules(spark):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "com", "a-b", "ab", ""])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: "".join(rng.choice(["/", "a", "b"]) for _ in range(rng.randrange(5)))
    rules = list({(host(rng.randrange(1, 4)), path()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    urls = [f"http://{host(rng.randrange(1, 5))}{'/' + path() if rng.random() < 0.8 else ''}" for _ in range(700)]
    # one host with a third of all pages
    check(spark, urls + [f"http://a.b.com/{path()}" for _ in range(350)], [(h, p, v) for (h, p), v in rules])


def test_no_rules_no_pages_and_repeats(spark):
    check(spark, ["http://a.com/x"] * 3, [("b", "/", "block")])
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, spark.createDataFrame(RULES, RULE)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.com/")], "page_id long, url string")
    both = [("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block")]
    assert [r.verdict for r in judge_urls(pages, spark.createDataFrame(both, RULE)).collect()] == ["block"] * 3
    assert judge_urls(pages, spark.createDataFrame([], RULE), default="block").where("verdict = 'block' and rule is null").count() == 3
