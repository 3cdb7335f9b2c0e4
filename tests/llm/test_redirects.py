from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from riskspark.llm import redirects

LINK = '<html><head><LINK rel="canonical" href="{}"></head></html>'
REFRESH = "<meta http-equiv='refresh' content='0; url={}'>"
PAGES = [
    (1, "http://a.org/x", LINK.format("https://bad.net/y")),  # inherits a block
    (2, "https://a.org/x#part", None),  # the same address in another form
    (3, "http://c.org/", REFRESH.format("/x2")), (4, "http://c.org/x2", LINK.format("//example.net/en/q")), (5, "http://d.org/z", LINK.format("http://c.org/x2")),
    (6, "http://e.org/z", LINK.format("http://d.org/z")), (7, "http://e.net/z", LINK.format("http://e.org/z")),  # an allow outweighs the block by rule of another alias
    (8, "http://free.com/page", "<p>canonical</p>"), (9, "http://SUB.Example.COM/de/1?q", ""), (10, "http://notexample.com/de/1", None),
    (11, "http://example.net", None), (12, "http://example.net/en", None), (13, "http://w.example.net/en/", None), (14, "ftp://x.org/fr/", None),
    (15, None, LINK.format("http://bad.net/y")), (16, "no scheme", LINK.format("http://bad.net/y")), (17, "", None), (18, "://", None),
    (19, "http://rel.org/dir/page?x=1", LINK.format("other")), (20, "http://rel.org/dir/other", LINK.format("http://blocked.net/")),
    (2, "https://a.org/x#part", None),
    (21, "http://q.org/a", """<meta content="0; url='http://bad.net/y'" http-equiv="Refresh">"""),  # quoted within the attribute
    (22, "http://v.org/dir/p", "<link href='?v=2' rel='nofollow canonical'>"), (23, "http://v.org/dir/p?v=2", REFRESH.format("http://bad.net/y")),
    (24, "http://up.org/a/b/page", "<link rel=canonical href=../r>"), (25, "http://up.org/a/r", LINK.format("http://bad.net/y")),
    (26, "http://up.org/a/b/c/", LINK.format("./.././../x/.")), (27, "http://up.org/a/x/", LINK.format("../../../../gone")), (28, "http://up.org/gone", LINK.format("http://bad.net/y")),
    (29, "http://amp.org/", LINK.format("/p?a=1&amp;b=&#50;&#x26;c&lt;&bogus;&#0;")), (30, "http://amp.org/p?a=1&b=2&c<&bogus;&", LINK.format("http://bad.net/y")),
    (31, "http://mail.org/", LINK.format("mailto:x@bad.net")), (32, "http://frag.org/p?x", LINK.format("#part")), (33, "http://bare.org", LINK.format("sub")), (34, "http://bare.org/sub", LINK.format("http://bad.net/y")),
    (35, "http://w.org/", '<link data-href="http://bad.net/" rel="canonical"><link rel="icon" href="http://bad.net/"><meta http-equiv="x" content="0;url=http://bad.net/">'),
]
WANT = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block", 10: "allow", 11: "allow", 12: "block",
        13: "allow", 14: "allow", 15: "allow", 16: "allow", 17: "allow", 18: "allow", 19: "block", 20: "block",
        21: "block", 22: "block", 23: "block", 24: "block", 25: "block", 26: "block", 27: "block", 28: "block", 29: "block", 30: "block", 31: "allow", 32: "allow",
        33: "block", 34: "block", 35: "allow"}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", "clash", "clash") for p in PAGES], "page_id long, url string, html string, host string, node string, a string")


def test_verdicts_and_twin(pages):
    found = [tuple(r) for r in redirects.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert len(found) == len(PAGES)
    assert {r[0]: r[4] for r in found} == WANT
    assert {r[0]: r[3] for r in found}[12] == "net/" and {r[0]: r[1:3] for r in found}[9] == ("sub.example.com", "/de/1")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert sorted(found, key=repr) == sorted(con.execute(redirects.SQL).fetchall(), key=repr)


def test_given_redirects(spark, pages):
    more = spark.createDataFrame([("http://free.com/page", "http://any.net/"), (None, "http://x.org/"), ("http://free.com/page", None)], "source string, target string")
    assert {r.page_id: r.verdict for r in redirects.judge(pages, redirects=more).collect()}[8] == "block"


def test_longest_rule_and_ties(spark):
    rules = (redirects.Rule("block", "a.org", "/"), redirects.Rule("allow", "a.org", "/"), redirects.Rule("block", "a.org", "/x/"))
    rows = spark.createDataFrame([(1, "http://a.org/q", None), (2, "http://a.org/x/1", None)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in redirects.judge(rows, rules).collect()} == {1: "allow", 2: "block"}


def test_no_rows(pages):
    assert redirects.judge(pages.limit(0)).count() == 0

@pytest.mark.parametrize("base", ["http://h.org/b/c/d;p?q", "http://h.org", "http://h.org/x/"])
def test_references_resolve_as_the_standard_library_does(spark, base):
    links = ["g", "./g", "g/", "/g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g",
             "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g?y/../x"]
    rows = spark.createDataFrame([(u,) for u in links], "link string")
    found = {r.link: r.full for r in rows.select("link", redirects.resolve(F.lit(base), F.col("link")).alias("full")).collect()}
    for link in links:
        # An address's empty path is the root.
        want = urljoin(base if base.count("/") > 2 else base + "/", link)
        assert found[link].replace("h.org?", "h.org/?").replace("h.org#", "h.org/#") == want, link


def test_character_references(spark):
    texts = {"a&amp;b&lt;&gt;&quot;&apos;": "a&b<>\"'", "&#233;&#xE9;&#X1F642;": "éé🙂", "&#0;&#xD800;&#1114112;&amp &nope; &": "&#0;&#xD800;&#1114112;&amp &nope; &", "": "", "&&": "&&"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in rows.select("t", redirects.unescaped(F.col("t")).alias("u")).collect()} == texts
