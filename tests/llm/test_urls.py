"""Verdicts on urls: hosts and paths by hand, rules, and a template tree on pages made to tell branches apart."""

import pytest
from pyspark.sql import functions as F

from strandmill.llm import urls as U

SCHEMA = "page_id long, url string, host string, n long, template string"


def pages(spark, found):
    return spark.createDataFrame([(k, u, "h", 1, "t") for k, u in enumerate(found)], SCHEMA)


def test_hosts_paths_and_rules_by_hand(spark):
    want = {
        "http://A.Example.NET/en/1?x=/": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://example.net/en": ("example.net", "/en", "net/", "block"), "x://net": ("net", "", None, "allow"), "x://net/": ("net", "/", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://example.com/de/a#b": ("example.com", "/de/a", "example.com/de/", "block"), "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"), "http://x.org:80/fr/": ("x.org:80", "/fr/", None, "allow"),
        "no scheme/net/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "://?": ("", "", None, "allow"), "http://É.NET/": ("É.net", "/", "net/", "block"), "http://u@q.net#/x": ("u@q.net", "", None, "allow"), "http://a\nb.net/x\ny": ("a\nb.net", "/x\ny", "net/", "block"),
    }
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages(spark, want)).collect()}
    assert found == dict(enumerate(want.values()))


def test_shapes(spark):
    d = spark.createDataFrame([("/a//b1/c.html/d/e/",), ("/2024/some-long-title-here.html",), ("",), ("/" + "x" * 25 + ".PDF",), ("/plain-name/x_y/",)], "path string")
    assert [r[0] for r in d.select(U.shape(F.col("path"), 3)).collect()] == [["a", "*", "c.html", "**"], ["*", "*.html"], [], ["*"], ["plain-name", "x_y"]]


def test_templates_reject_what_is_mostly_bad_and_merge_what_is_alike(spark):
    """Branches bad and good apart, two alike merged, rare names under a wildcard; unknown pages are allowed but under a bad branch."""
    rows = [(f"http://h.test/bad/{k}", True) for k in range(40)] + [(f"http://h.test/good/{k}", False) for k in range(40)] + [(f"http://h.test/fine/{k}", False) for k in range(40)]
    rows += [("http://h.test/bad/x", None), ("http://h.test/bad", None), ("http://h.test/good/x", None), ("http://h.test/", None), ("http://other.test/bad/1", None)] + [(f"http://h.test/{a}{b}/z", None) for a in "abcd" for b in "efgh"]
    d = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, is_bad boolean")
    got = {r["page_id"]: r for r in U.judge(d, bad=F.col("is_bad")).collect()}
    of = {u: got[k] for k, (u, _) in enumerate(rows)}
    assert len(got) == len(rows) and all((got[k]["verdict"] == "block") == u.startswith("http://h.test/bad") for k, (u, _) in enumerate(rows))
    assert of["http://h.test/good/1"]["template"] == of["http://h.test/fine/1"]["template"] == "/fine|good/*/" and of["http://h.test/bad/x"]["template"] == of["http://h.test/bad/1"]["template"].replace("*", "*")
    assert of["http://h.test/ae/z"]["template"].startswith("/*/") and of["http://h.test/"]["template"] == "/" and 0.5 <= of["http://other.test/bad/1"]["purity"] <= 0.5
    assert of["http://h.test/bad"]["template"] == "/bad/" and of["http://h.test/bad"]["purity"] == pytest.approx((40 + (2 + 2) * 0.5) / (42 + 2), abs=1e-9)


def test_repeats_long_urls_and_empty_table(spark):
    d = pages(spark, ["http://a.com/x/1"] * 7 + ["http://a.com/" + "seg/" * 20_000, "http://a.com/" + "y" * 200_000])
    found = U.judge(d)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    rows = {r["page_id"]: r for r in found.collect()}
    assert len(rows) == 9 and rows[7]["path"] == "/" + "seg/" * 20_000 and {r["verdict"] for r in rows.values()} == {"allow"} and U.judge(d.limit(0)).count() == 0
