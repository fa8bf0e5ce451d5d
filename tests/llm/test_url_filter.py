import pytest

from scriptorium.llm import url_filter as uf

CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme.net/x", "", "", None, "allow"),
    ("http://a.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/en", "example.net", "/en", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://example.net?/en/", "example.net", "", None, "allow"),
    ("x://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    ("https://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
    ("https://example.com/fr/de/", "example.com", "/fr/de/", None, "allow"),
    ("https://x.org/fr/#a", "x.org", "/fr/", "org/fr/", "allow"),
    ("http:///net/", "", "/net/", None, "allow"),
    ("a://b://net/", "b:", "//net/", None, "allow"),
    ("http://net/" + "a/" * 5000, "net", "/" + "a/" * 5000, "net/", "block"),
    ("http://\u00c4.net/", "\u00c4.net", "/", "net/", "block"),
]


def test_cases(spark):
    rows = [(n, c[0], "clash") for n, c in enumerate(CASES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    out = uf.judge_urls(pages).select("page_id", "_judged.*").collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r)[1:] == CASES[r.page_id][1:]
    assert uf.judge_urls(pages.limit(0)).collect() == []


def test_longest_match_between_verdicts():
    t = uf.Trie([("allow", "a.com", "/x/"), ("block", "a.com", "/x/y"), ("block", "b.a.com", "/"), ("allow", "com", "")])
    assert t.find("a.com", "/x/z") == ("a.com/x/", "allow")
    assert t.find("a.com", "/x/yes") == ("a.com/x/y", "block")
    assert t.find("c.b.a.com", "/x/z") == ("b.a.com/", "block")
    assert t.find("q.com", "") == ("com", "allow") and t.find("net", "/") is None


def test_rule_bound(monkeypatch):
    monkeypatch.setattr(uf, "MAX_RULES", 1)
    with pytest.raises(ValueError):
        uf.Trie(uf.RULES)
