import pytest

from brevispark.llm import url_filter as op
from brevispark.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2#f", "http://example.org", "http://x.com/de/1", "http://com/fr/", "http://xcom/fr/", "http://b.net/a", "http://bad.net/",
    "http://sub.bad.net/fr", "http://notbad.net/", "http://BAD.net?q", "x://y://z/fr/", "http://é.bad.net/", "http://bad.net/", "http://...bad.net/",
]


def plain(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, rule in URL_RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    method = "block" if any(host == d or host.endswith("." + d) for d in listed) else "allow"
    return host, path, best and best[1], best[0] if best else method


@pytest.mark.parametrize("most_bits", [1 << 25, 16])
def test_equals_plain_rules(spark, monkeypatch, most_bits):
    monkeypatch.setattr(op, "MOST_BITS", most_bits)
    listed = ["bad.net", "absent.org", "y://z", "a.b.c.d", "com"]
    urls = [*URLS, "http://1.a.b.c.d/", "http://b.c.d", "http://.com/x", "http://com./x", *URLS]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("page_id", "url", "'x' AS host", "1 AS verdict", "true AS hit", "'k' AS k0")
    found = op.filter_urls(pages, URL_RULES, listed, keep=("page_id", "k0"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: plain(u, listed) for i, u in enumerate(urls)} and found.columns[:2] == ["page_id", "k0"]


def test_a_list_of_thousands_in_shards(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_BITS", 1 << 14)  # some five shards
    listed = spark.range(8000).selectExpr("concat('bad', id, '.example') AS key")
    pages = spark.range(12000).selectExpr("id AS page_id", "concat('http://w', id % 3, IF(id % 2 = 0, '.bad', '.good'), id, '.example/') AS url")
    got = op.filter_urls(pages, [], listed)
    assert got.where("(verdict = 'block') <> (page_id % 2 = 0 AND page_id < 8000)").count() == 0 and got.count() == 12000


def test_a_host_of_very_many_labels(spark):
    host = "a." * 100_000 + "bad.net"
    pages = spark.createDataFrame([(1, f"http://{host}/x"), (2, f"http://{host}x/"), (3, "http://" + "." * 100_000)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in op.filter_urls(pages, URL_RULES, ["bad.net", "x.y.z"]).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_a_cascade_is_exact_over_its_universe(spark):
    rows = [(f"host{i}.example", i % 5 == 0) for i in range(4000)]
    universe = spark.createDataFrame(rows, "key string, listed boolean")
    cascade = op.build_cascade(universe, bits_per_key=(4, 2))
    assert len(cascade.levels) > 3
    assert universe.where(cascade.listed(universe["key"]) != universe["listed"]).count() == 0


def test_empty_inputs(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert op.filter_urls(pages, URL_RULES, ["bad.net"]).count() == 0
    one = spark.createDataFrame([(1, "http://bad.net/")], "page_id bigint, url string")
    assert op.filter_urls(one, [], []).first().verdict == "allow"


def test_the_plan_holds_no_python(spark):
    pages = spark.createDataFrame([(1, "http://bad.net/")], "page_id bigint, url string")
    plan = op.filter_urls(pages, URL_RULES, ["bad.net"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
