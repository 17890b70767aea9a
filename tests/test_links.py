"""Addresses against the standard library's resolution, texts with links, and consent by sequence."""

import json
from urllib.parse import urljoin

from pyspark.sql import functions as F

from attesta.functions import net, text
from attesta.operators import qualification

BASE = "https://Host.example/a/b/page?x=1#top"


def test_references_resolve_as_the_standard_says(spark):
    hrefs = ["c", "./c", "../c", "../../../c", "/c/./d/../e", "?q=1", "c?q=1#f", "//other/p", "http://h:80/", "https://h:443/x", "https://h:8443", "c/", "..", ".", "a/..", "/a/b/..", "HTTP://H/P"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, h string")
    got = dict(rows.select("h", net.resolved(F.col("h"), F.lit(BASE))).collect())
    for h in hrefs:
        want = urljoin(BASE, h).replace("Host.example", "host.example").replace("HTTP://H/", "http://h/").replace(":80/", "/").replace(":443/", "/")
        want = want if want.count("/") > 2 else want + "/"
        assert got[h] == want.replace("http://h/../", "http://h/"), h


def test_what_is_not_safe_is_no_address(spark):
    hrefs = ["mailto:a@b", "javascript:x()", "ftp://h/x", "http://u@h/", "https://u:p@h/x", "http:///x", "https://h/a b", None]
    rows = spark.createDataFrame([(h,) for h in hrefs], "h string")
    assert [r[0] for r in rows.select(net.resolved(F.col("h"), F.lit(BASE))).collect()] == [None] * len(hrefs)
    kept = spark.createDataFrame([("?token=1&a=2&Password=x",), ("/p?sesskey=1",), ("",), ("#f",)], "h string").select(net.resolved(F.col("h"), F.lit(BASE))).collect()
    assert [r[0] for r in kept] == ["https://host.example/a/b/page?a=2", "https://host.example/p", "https://host.example/a/b/page?x=1", "https://host.example/a/b/page?x=1#f"]


def test_links_stay_behind_their_labels(spark):
    pages = {
        "<p>See <a href='../c?x=1&amp;token=2'>this</a> and <a name=n>that</a>.</p><a href=mailto:x>mail</a>": "See this (https://host.example/a/c?x=1) and that.\nmail",
        "<script>var a='<a href=/x>no</a>'</script><A HREF=\"/y\">up</A> tail": "up (https://host.example/y) tail",
        "no links &lt;b&gt;": "no links <b>",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in pages], "h string")
    assert dict(rows.select("h", text.linked_text(F.col("h"), F.lit(BASE))).collect()) == pages


def test_the_newest_grant_before_a_read_decides(spark):
    own = json.dumps({"lastattempt": {"submission": {"userid": 7, "status": "draft"}}, "feedback": {"grade": "A", "gradeddate": 5}, "grader": "x"})
    other = json.dumps({"lastattempt": {"submission": {"userid": 8}}})
    reads = spark.createDataFrame([("o", "c", 1, "7", own), ("o", "c", 3, "7", own), ("o", "c", 5, "7", own), ("o", "c", 7, "7", other), ("o", "d", 9, "7", own), ("p", "c", 9, "7", own), ("o", "c", 8, "7", "{}")], "owner_id string, connection_id string, seq int, account string, response string")
    grants = spark.createDataFrame([("o", "c", 1, True), ("o", "c", 4, False), ("o", "c", 6, True)], "owner_id string, connection_id string, seq int, granted boolean")
    got = {(r.owner_id, r.connection_id, r.seq): (r.refusal, r.status) for r in qualification.consented_reads(reads, grants).collect()}
    assert {k: v[0] for k, v in got.items()} == {("o", "c", 1): "never_granted", ("o", "c", 3): None, ("o", "c", 5): "revoked", ("o", "c", 7): "not_own", ("o", "c", 8): None, ("o", "d", 9): "never_granted", ("p", "c", 9): "never_granted"}
    status = json.loads(got["o", "c", 3][1])
    assert status == {"lastattempt": {"submission": {"userid": 7, "status": "draft"}}, "feedback": {"available": True, "gradeddate": 5}} and json.loads(got["o", "c", 8][1]) == {"lastattempt": {}}
    assert qualification.consented_reads(reads.limit(0), grants).count() == 0
