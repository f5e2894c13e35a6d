import pytest

from quillspark.llm.queries import RULES
from quillspark.llm.url_filter import judge_urls, vocabulary

CASES = [
    (None, "", "", None, "allow"), ("no scheme porn", "", "", None, "block"), ("", "", "", None, "allow"),
    ("https://EXAMPLE.com/en/a?x=/fr/", "example.com", "/en/a", "example.com/en/", "block"),
    ("https://www.example.com/en/porn", "www.example.com", "/en/porn", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("http://shop.net/es/x", "shop.net", "/es/x", "net/es/", "block"), ("http://shop.net/de/x", "shop.net", "/de/x", None, "allow"),
    ("http://x.org/casino#a", "x.org", "/casino", None, "block"), ("http://x.org/casinos", "x.org", "/casinos", None, "allow"),
    ("http://x.org/bet", "x.org", "/bet", None, "allow"), ("http://x.org/bet-bet", "x.org", "/bet-bet", None, "allow"),
    ("http://x.org/bet-poker", "x.org", "/bet-poker", None, "block"), ("http://x.org/alphabet-poker", "x.org", "/alphabet-poker", None, "allow"),
    ("http://example.com", "example.com", "", None, "allow"), ("http://x.org\n/a", "x.org\n", "/a", None, "allow"),
]


@pytest.mark.parametrize("clash", [False, True])
def test_verdicts(spark, clash):
    df = spark.createDataFrame([(i, c[0], "z") for i, c in enumerate(CASES)] + [(None, None, "z")], f"page_id long, url string, {'host' if clash else 'html'} string")
    got = {r.page_id: r for r in judge_urls(df, RULES).collect()}
    for i, (url, *want) in enumerate(CASES):
        assert [got[i].host, got[i].path, got[i].rule, got[i].verdict] == want, url
    assert judge_urls(df.limit(0), RULES).count() == 0


def test_terms_of_a_table(spark):
    terms = spark.createDataFrame([("Spam", True), ("spam", False), ("odd", False), ("fringe-y", None), ("", True), (None, True)], "term string, strict boolean")
    strict, soft = vocabulary(terms)
    assert (strict, soft) == (("spam",), ("fringe-y", "odd"))
    urls = spark.createDataFrame([(1, "http://a.org/spam"), (2, "http://a.org/odd"), (3, "http://a.org/odd/fringe-y"), (4, "http://a.org/casino")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge_urls(urls, [], strict=strict, soft=soft).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    with pytest.raises(ValueError, match="terms"):
        vocabulary(terms, most=1)
