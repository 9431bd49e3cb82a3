from strideway.llm import urlfilter
from strideway.llm.queries import ORACLES, URL_RULES, op10_url_filter
from tests.llm.oracle import same

SCHEMA = "page_id long, url string, host string, shape string, verdict string, key int"


def judged(spark, urls, rules=URL_RULES):
    rows = spark.createDataFrame([(i, u, "", "", "", 1) for i, u in enumerate(urls)], SCHEMA)
    return {r.page_id: r for r in urlfilter.judge(rows, rules).collect()}


def test_parsing_and_rules(spark):
    urls = ["http://WWW.Example.COM/en/1", "https://a.example.com/en/x?q#f", "http://example.com", "http://x.net/es/1", "http://xnet/es/1", "no scheme", None, "", "a://b://c/d", "http://net?x=/es/", "http://net/fr/#/y", "http://u@Host:80/P/%41"]
    got = judged(spark, urls)
    want = [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/x", "example.com/en/", "block"),
        ("example.com", "", None, None),
        ("x.net", "/es/1", "net/es/", "block"),
        ("xnet", "/es/1", None, None),
        ("", "", None, None),
        ("", "", None, None),
        ("", "", None, None),
        ("b:", "//c/d", None, None),
        ("net", "", None, None),
        ("net", "/fr/", "net/fr/", "block"),
        ("u@host:80", "/P/%41", None, None),
    ]
    for i, (host, path, rule, verdict) in enumerate(want):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[i]
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_wildcards_merging_and_purity(spark):
    rules = [("block", "h.org/bad/"), ("allow", "h.org/good/")]
    urls = [f"http://h.org/bad/{i}" for i in range(40)] + [f"http://h.org/good/{i}.html" for i in range(40)]
    urls += [f"http://h.org/user/name{chr(97 + i)}" for i in range(20)] + ["http://spam.org/bad/1"] * 3 + ["http://h.org/a/b/c/d/e/f"]
    got = judged(spark, urls, rules)
    assert got[0].template == "/bad/*" and got[40].template == "/good/*" and got[80].template == "/user/*"
    assert got[0].verdict == "block" and got[40].verdict == "allow"
    assert got[len(urls) - 1].template == "/a/b/c/d/e/f"
    assert len({got[i].verdict for i in range(80, 100)}) == 1
    assert all(r.verdict == "allow" for r in judged(spark, urls, []).values())


def test_deep_branches_are_told_apart(spark):
    rules = [("block", "h.org/a/b/c/d/e/bad/"), ("allow", "h.org/a/b/c/d/e/good/")]
    deep = [f"http://h.org/a/b/c/d/e/{k}/{w}{i}" for k in ("bad", "good") for i, w in enumerate(["x"] * 30)]
    urls = deep + ["http://h.org/a/b/c/d/e/bad/", "http://h.org/a/b/c/d/e/good/y"] * 2 + ["http://h.org/" + "a/" * 2000] * 2 + ["http://h.org/a"] * 2
    got = judged(spark, urls, rules)
    assert got[0].template == "/a/b/c/d/e/bad/*" and got[30].template == "/a/b/c/d/e/good/*"
    assert got[len(urls) - 3].template == "/a" * 2000 and got[len(urls) - 1].template == "/a"
    assert [got[i].verdict for i in (0, 30)] == ["block", "allow"]


def test_a_branch_without_labels_is_not_condemned(spark):
    """One blocked section doesn't block its site; a wildcard that holds blocked pages does block the rest of it."""
    rules = [("block", "a.net/es/"), *(("block", f"a.net/u/name{chr(97 + i)}") for i in range(12))]
    urls = ["http://a.net/es/1"] * 40 + ["http://a.net/en/x", "http://a.net/"] + [f"http://a.net/u/name{chr(97 + i)}" for i in range(20)] + ["http://b.net/es/1"] * 2
    got = judged(spark, urls, rules)
    assert got[40].verdict == got[41].verdict == got[63].verdict == "allow"
    assert got[42].template == "/u/*" and got[42].verdict == "block"
    assert got[61].rule is None and got[61].verdict == "block"


def test_one_host_has_templates_of_both_verdicts(spark):
    rows = op10_url_filter(spark, "/root/testdata/sf0.1").groupBy("host").agg({"verdict": "collect_set"}).collect()
    assert any(len(r[1]) == 2 for r in rows)


def test_empty(spark):
    assert judged(spark, []) == {}


def test_query_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        same(op10_url_filter(spark, sf), ORACLES["op10_url_filter"], sf)
