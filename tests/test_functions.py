import pytest
from pyspark.sql import functions as F

from hostweave.functions import domains as D
from hostweave.functions import formats
from hostweave.operators import audit, discovery, history


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = {
    "https://www.Example.com/path?x=1": "example.com", "https://my-transfer.com.ua/": "my-transfer.com.ua", "example.com:443": "example.com",
    "  EXAMPLE.COM.  ": "example.com", '"quoted.com"': "quoted.com", "'x.org' ": "x.org", "//cdn.net/a": "cdn.net", "user:pw@host.com/x": "host.com",
    "www.www.a.com": "www.a.com", "a.com\\b": "a.com", "a.com#f": "a.com", "[::1]:80": "[::1]:80", "ÄB.com": "Äb.com", "": "", '"': '"', "a..": "a",
}


def test_normalize_domain(spark):
    assert apply(spark, D.normalize_domain, list(CASES)) == list(CASES.values())


def test_reverse(spark):
    got = apply(spark, D.to_reverse, ["example.com", "en.wikipedia.org", "https://my-transfer.com.ua/foo", "Example.COM.", "", None])
    assert got == ["com.example", "org.wikipedia.en", "ua.com.my-transfer", "com.example", "", None]
    assert apply(spark, lambda c: D.from_reverse(D.to_reverse(c)), ["blog.example.co.uk"]) == ["blog.example.co.uk"]


def test_other_cleaners(spark):
    assert apply(spark, D.typed_domain, ["https://WWW.Example.com/page?x=1", "  my-transfer.com.ua.  ", "example.com:8443"]) == ["example.com", "my-transfer.com.ua", "example.com"]
    assert apply(spark, D.audit_target, [" https://www.A.com/x/ ", "http://www.www.b.org//"]) == ["a.com/x", "b.org"]
    assert apply(spark, D.brand, ["https://my-transfer.com.ua/", "www.a_bC.com"]) == ["My Transfer", "A BC"]
    assert apply(spark, D.url_host, ["http://www.WWW.a.com/x", "not a url", None, "https://b.org:80?q"]) == ["www.a.com", "", "", "b.org"]
    assert apply(spark, D.safe_file_name, ['a/b\\c:d*e?f"g<h>i|j']) == ["a_b_c_d_e_f_g_h_i_j"]
    assert apply(spark, D.urls_in_text, ["see http://a.com/x, (https://b.org). http://a.com/x; end"]) == [["http://a.com/x", "https://b.org"]]


def test_public_url(spark):
    urls = ["http://a.com/", "ftp://a.com", "http://localhost/", "http://10.0.0.1/x", "https://[::1]/", "nonsense", None, "https://1.1.1.1/"]
    assert apply(spark, D.public_url, urls) == [True, False, False, False, False, False, False, True]


def test_formats(spark):
    assert apply(spark, formats.rank_text, [0.0, None, 0.25, 4.115e-9], "double") == ["—", "—", "0.2500", "4.115e-9"]
    assert apply(spark, lambda c: formats.plural(c, "a", "b", "c"), [1, 2, 4, 5, 0, 11, 12, 14, 21, 22, 112], "int") == list("abbccccc") + ["a", "b", "c"]
    assert apply(spark, formats.file_name, ["/a/b.txt", "C:\\x\\y", "/a/"]) == ["b.txt", "y", "/a/"]
    assert apply(spark, formats.metric_label, ["Harmonic", "pagerank"]) == ["Harmonic", "PageRank"]
    assert apply(spark, lambda c: formats.run_status(c), [None, "scan cancelled", "disk"]) == ["completed", "cancelled", "failed"]
    assert [formats.plain_decimal(x) for x in (5e-9, 0.25, 2.0, 1e22)] == ["0.000000005", "0.25", "2", "10000000000000000000000"]


def test_search_queries(spark):
    rows = discovery.search_queries(spark.createDataFrame([("https://My-Transfer.com.ua/", "")], "target string, brand string")).orderBy("query_ord").collect()
    assert len(rows) == 6 and all("site:my-transfer.com.ua" in r.query for r in rows) and rows[1].query == '"My Transfer" -site:my-transfer.com.ua'
    assert "reputation" in {r.kind for r in rows}
    manual = discovery.manual_searches(spark.createDataFrame([("https://www.my-x.com/a", None)], "target string, brand string")).collect()
    assert len(manual) == 24 and {r.engine for r in manual} == set(discovery.ENGINES) and any("%22My%20X%22" in r.url for r in manual)


def test_evidence(spark):
    hits = spark.createDataFrame(
        [("a.com", "brand_mention", "q", 1, 0, "t", "http://b.org/x/", "s"), ("a.com", "url_mention", "q", 0, 3, "t", "http://b.org/x", "s"), ("a.com", "documents", "q", 2, 0, "t", "http://sub.a.com/", "s"), ("a.com", "documents", "q", 2, 1, "t", "bad url", "s")],
        "target string, query_kind string, query string, query_ord int, hit_ord int, title string, url string, snippet string",
    )
    found = discovery.evidence(hits)
    assert [(r.url, r.evidence_type, r.confidence) for r in found.collect()] == [("http://b.org/x", "potential_backlink", "medium")]
    facts = discovery.summary(found).first()
    assert (facts.unique_source_domains, facts.potential_backlinks, facts.strongest, facts.strongest_count) == (1, 1, "b.org", 1)
    empty = discovery.summary(found.limit(0))
    assert empty.first().unique_source_domains == 0 and discovery.insights(empty).count() == 1
    bodies = spark.createDataFrame([("a.com", "k", "q", 0, '{"web":{"results":[{"title":"T","url":"http://x.org"}]}}')], "target string, query_kind string, query string, query_ord int, body string")
    assert [(h.title, h.url, h.snippet) for h in discovery.hits_from_json(bodies, "brave").collect()] == [("T", "http://x.org", "")]


@pytest.mark.parametrize("args", [("", ["a"], "brave"), ("k", [], "brave"), ("k", ["a"], "google"), ("k", ["a"], "other")])
def test_bad_requests(args):
    with pytest.raises(ValueError):
        discovery.check_request(*args)


def test_audit(spark):
    html = '<html><head><title> T &amp; x </title></head><body><a href="https://www.a.com/p" rel="nofollow">one <b>two</b></a><a href="//sub.a.com">s</a><a href="/own">o</a><a rel="x">none</a><a href="http://a.com" rel="nofollow"> </a><script>var b="My Brand";</script></body></html>'
    rows = [(0, "http://b.org/x", 200, html, None), (1, "http://b.org/y", 403, "", None), (2, "http://b.org/private/z", 200, html, "User-agent: *\nDisallow: /private"), (3, "http://www.a.com/", 200, html, None), (4, "nonsense", 200, html, None), (5, "http://b.org/e", 500, "", None), (6, "http://b.org/n", None, None, None), (7, "http://c.org/", 200, "<p>a.com only</p>", None)]
    pages = spark.createDataFrame(rows, "ord int, url string, http_status int, html string, robots string")
    out = audit.audit(pages, "https://www.A.com/", "my brand")
    got = {r.ord: r for r in out.collect()}
    assert [got[i].status for i in range(8)] == ["audited", "blocked", "robots_blocked", "skipped", "invalid", "http_error", "request_failed", "audited"]
    first = got[0]
    assert (first.backlink_count, first.anchors, first.rel_values, first.title, first.has_brand_mention) == (3, ["one  two", "s"], ["nofollow"], "T & x", True)
    assert (got[1].source_domain, got[1].http_status, got[2].source_domain, got[2].http_status) == ("b.org", 403, "", None)
    assert audit.audit_summary(out).first().asDict() == {"audited": 8, "confirmed_backlinks": 1, "mentions_without_link": 1, "blocked_or_skipped": 6}
    with pytest.raises(ValueError):
        audit.clean_target("https://")


def test_first_urls(spark):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate([" http://a.com/ ", "http://a.com", "http://b.com", *[f"http://c.com/{i}" for i in range(60)]])], "ord int, url string")
    got = [r.url for r in audit.first_urls(urls).orderBy("ord").collect()]
    assert len(got) == 50 and got[:2] == [" http://a.com/ ", "http://b.com"]


def test_history(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"))
    assert h.runs().count() == 0 and h.reports().count() == 0
    ids = [h.start_run("pagerank", ["a.com"], "res") for _ in range(3)]
    h.finish_run(ids[0])
    h.finish_run(ids[1], "cancelled by user")
    h.finish_run(ids[2], "no space")
    open_run = h.start_run("harmonic", [], "res", "index")
    assert {r.id: r.status for r in h.runs().collect()} == {ids[0]: "completed", ids[1]: "cancelled", ids[2]: "failed", open_run: "running"}
    h.save_report("brave", {"evidence": [{"url": "a"}, {"url": "b"}]})
    assert h.reports().first().evidence_count == 2
    old = history.with_kind(spark.createDataFrame([(1,)], "id bigint"), history.RUN_EVENTS)
    assert old.first().kind == "scan"
