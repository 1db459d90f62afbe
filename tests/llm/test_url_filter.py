import random
import re

from relcheck.llm import url_filter as U


def plain(url, rules):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]) if m else ("", "")
    fit = [(len(h + p), v, h + p) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def check(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **more).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(urls[r["page_id"]], rules), urls[r["page_id"]]


ODD = [None, "", "nothing", "http://", "http://ORG", "http://org/", "HTTP://A.Example.ORG/en/12?x#y", "http://example.org/es", "http://example.org/es/?", "x://y://org/de/", "http://u:p@b.com:80/fr/x", "http://notexample.org/es/", "http://a\nb.com/de/1", "http://É.com/fr/é#", "http://.org/", "http://com/fr//", "http://..org/x"]


def test_rules_of_the_contract(spark):
    check(spark, ODD, U.RULES)
    check(spark, ODD, U.RULES, broadcast_rules=0)


def test_random_rules(spark):
    rng = random.Random(1)
    hosts, parts = ["a", "b", "a.b", "b.a", "c.a.b", "x.c.a.b"], ["", "/", "/p", "/p/", "/p/q", "/pq"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in [(rng.choice(hosts), rng.choice(parts)) for _ in range(14)]}.values())
    urls = [f"http://{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', 'z', '?p'])}" for _ in range(80)]
    check(spark, urls, rules)
    check(spark, urls, [*rules, rules[0], (None, "/", "block"), ("a", None, "block")], broadcast_rules=0)


def test_no_rules_no_pages_repeats(spark):
    check(spark, ["http://a.org/", "http://a.org/"], [])
    pages = spark.createDataFrame([(7, "http://a.org/"), (7, "http://a.org/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.judge_urls(pages, rules).count() == 3
    assert U.judge_urls(pages.limit(0), rules).count() == 0


def test_no_python_in_the_plan(spark, sf):
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string").persist()
    plan = U.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
