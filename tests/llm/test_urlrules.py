from merset.llm.urlrules import clean_rules, judge_urls, path_bounds

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.Example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), ("x.example.com", "/", "block")]


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url is not None and at >= 0 else ""
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    host, path = low(rest[:n]), rest[n:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h) + len(p), len(h), low(h), p, a) for h, p, a in rules if (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com/", "http://com", "https://EXAMPLE.com/en/1?q=/en/", "https://www.example.com/en/1#x", "https://a.www.example.com/en/", "https://myexample.com/en/",
    "http://example.com?x=/en/", "http://example.net/es/", "http://example.net/esx", "ftp://u@h.net:80/es/?://", "http://a-b.example.com/en/", "http://x.example.com/en/z", "http://a.b.c.d.net/es/é", "http://.com/", "http://com./", "http://example.com/EN/",
]


def test_against_brute_force(spark):
    rows = spark.createDataFrame([(i, u, "host", 1) for i, u in enumerate(URLS)] + [(6, URLS[6], "host", 1)], "page_id long, url string, host string, kind int")
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("org", None, "block")], "host string, path string, action string")
    got = judge_urls(rows, rules, ranges=3).collect()
    assert len(got) == len(URLS) + 1
    listed = [r for r in RULES if r != ("net", "/es/", "allow")]
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], listed), r
        assert r["kind"] == 1


def test_empty_tables_and_default(spark):
    rows = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert judge_urls(rows.limit(0), rules).count() == 0
    only = judge_urls(rows, rules.limit(0), default="block").first()
    assert only["rule"] is None and only["verdict"] == "block"


def test_plan_has_no_python_and_no_nested_loops(spark):
    rows = spark.range(10).selectExpr("id page_id", "concat('http://a.com/', id) url")
    rules = spark.range(3).selectExpr("concat('h', id, '.com') host", "'/' path", "'block' action")
    plan = judge_urls(rows, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


def test_paths_nest_across_ranges(spark):
    rules = [("a.com", p, "block" if len(p) % 2 else "allow") for p in ("", "/", "/x", "/x/", "/x/yy", "/é", "/é/z", "z")] + [("com", "/x/y", "block"), ("", "/x/yy/w", "allow"), ("q/a.com", "/", "block"), ("b.a.com", "/x/yyy", "block")]
    urls = [f"http://{h}{p}" for h in ("a.com", "b.a.com", "ba.com", "com", "a.com.", "c.b.a.com") for p in ("", "/", "/x", "/x/y", "/x/yy/w", "/x/yyy", "/x0", "/é", "/é/", "/é/z", "/\U0010ffff", "//z", "?z")]
    at = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for ranges in (1, 7, 40):
        got = judge_urls(at, spark.createDataFrame(rules, "host string, path string, action string"), ranges=ranges).collect()
        assert sorted(r["page_id"] for r in got) == list(range(len(urls)))
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], rules), (ranges, r)


def test_many_path_rules_of_one_host(spark):
    """Each rule has two bounds, whatever the number of ranges, and each url meets its own."""
    rules = spark.range(100_000).selectExpr("'hot.com' host", "concat('/p', id, '/') path", "if(id % 3 = 0, 'block', 'allow') action")
    urls = spark.range(20_000).selectExpr("id page_id", "concat('https://www.hot.com/p', id * 7, '/index?', id) url")
    assert path_bounds(clean_rules(rules)).count() == 200_000
    got = judge_urls(urls, rules, ranges=16)
    wrong = got.where("rule is null or (page_id * 7 < 100000) <> (rule = concat('hot.com/p', page_id * 7, '/'))")
    assert wrong.where("page_id * 7 < 100000").count() == 0
    assert got.where("rule is not null").count() == 14_286
    assert got.where("verdict = 'block'").count() == 4_762
