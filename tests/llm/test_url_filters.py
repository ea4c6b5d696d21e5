"""The url filter against a plain scan of all rules."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetmetrics.llm import url_filters as U


def plain(rules, host, path, default="allow"):
    fits = [(h.count("."), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, default)


HOSTS = st.lists(st.sampled_from(["a", "b", "com", ""]), min_size=1, max_size=4).map(".".join)
PATHS = st.lists(st.sampled_from(["", "e", "en", "eng", "x"]), max_size=4).map(lambda p: "/" + "/".join(p)) | st.just("")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), HOSTS.filter(bool), PATHS), max_size=8), HOSTS, PATHS)
def test_trie_equals_scan(rules, host, path):
    assert (U.UrlTrie(rules).match(host, path) or (None, "allow")) == plain(rules, host, path)


URLS = [
    "http://x.example.com/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/x/y", "https://EXAMPLE.com/EN/", "http://example.com/en",
    "https://spain.net/es/a?b#c", "http://net/fr/", "http://xnet/fr/", "http://a.org/", "http://a.com", "http://a.com?x/en/", "http://user@a.com:80/x", "no scheme", "", None,
    "://com/", "http://one.com/http://two.net/es/", "http://a.com/\n/x", "http://example.com./en/", "http://" + "a." * 500 + "com/" + "p/" * 5000, "http://a.com/",
]


@pytest.mark.parametrize("most", [U.MOST_RULES, 2])
def test_trie_and_join_equal_scan(spark, most):
    rules = [*U.RULES, ("block", "a.com", ""), ("allow", "a.com", ""), ("block", "example.com", "/en"), ("allow", None, "/"), ("block", "", "/"), ("block", "org", None)]
    used = [(v, h, p or "") for v, h, p in rules if h]
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    # columns of the result's names, and a repeated row
    pages = spark.createDataFrame([(i, u, "own", 1) for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string, _h int")
    pages = pages.withColumnRenamed("_h", "rule") if most == 2 else pages
    rows = U.judge_urls(pages, frame, most_rules=most).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["rule"], r["verdict"]) == plain(used, r["host"], r["path"]), r
    by = {r["page_id"]: r for r in rows}
    assert [by[i]["host"] for i in (3, 11, 12, 13, 14, 16)] == ["example.com", "user@a.com:80", "", "", "", "one.com"]
    assert by[9]["path"] == "" and by[10]["path"] == "" and by[17]["path"] == "/\n/x"
    empty = U.judge_urls(pages.where("false"), frame, most_rules=most)
    assert empty.count() == 0 and empty.columns[-4:] == ["host", "path", "rule", "verdict"]


def test_no_rules_give_the_default(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert U.judge_urls(pages, none, default="block").first()["verdict"] == "block"


def test_query_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, U.op13_url_filters(spark, sf_dir).collect()))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == sorted(c.sql(U.OP13_SQL).fetchall())
