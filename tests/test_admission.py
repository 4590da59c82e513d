"""URL, address, robots, intent and request rules."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from evigrid.functions import urls as U
from evigrid.operators import admission as A
from evigrid.plans.specs import TargetPolicy

PUBLIC = TargetPolicy("public_http", allowlist=(("example.com", False),))


def codes(spark, urls, pair):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    return [tuple(r) for r in df.select(pair[0].alias("o"), pair[1].alias("c")).collect()]


def test_loopback_targets(spark):
    good = {"http://127.0.0.1:7/deep/path": "http://127.0.0.1:7", "http://127.0.0.1/?n=3&m": "http://127.0.0.1", "http://[::1]/": "http://[::1]"}
    bad = ["http://127.0.0.2x/", "http://loop.test/", "https://[::1]:44/", "ws://127.0.0.1/", "http://me:pw@127.0.0.1:7/", "http://127.0.0.1:7/p#top",
           "http://127.0.0.1:123456/"]
    out = codes(spark, [*good, *bad], U.check_target(F.col("url")))
    assert out == [(o, None) for o in good.values()] + [(None, "only_literal_loopback_http_supported")] * len(bad)


def test_public_targets(spark):
    want = {"https://example.com/": "https://example.com", "https://example.com/a/b/c": "https://example.com", "https://Example.COM:443/x": "https://example.com",
            "gopher://example.com/": "public_scheme_not_allowed", "http://example.com/x": "public_scheme_not_allowed", "https:///x": "invalid_url",
            "https://10.1.2.3/": "target_not_in_allowlist", "https://[2001:db8::1]/": "target_not_in_allowlist", "https://shop.example.com/": "target_not_in_allowlist",
            "https://example.com.test/": "target_not_in_allowlist", "https://example.com:444/": "unsupported_port", "https://example.com:4x/": "invalid_url",
            "https://me@example.com/": "invalid_url", "https://example.com/x?page=2": "entry_url_query_not_supported", "https://example.com/x#y": "invalid_url"}
    out = codes(spark, list(want), U.check_target(F.col("url"), PUBLIC))
    assert [o or c for o, c in out] == list(want.values())
    sub = TargetPolicy("public_http", allowlist=(("example.com", True),))
    assert codes(spark, ["https://a.b.example.com/x", "https://badexample.com/"], U.check_target(F.col("url"), sub)) == [
        ("https://a.b.example.com", None), (None, "target_not_in_allowlist")]
    queries = {"https://example.com/?page=1&q=a": None, "https://example.com/?page=1&page=2": "unsupported_query",
               "https://example.com/?Token=1": "unsupported_query", "https://example.com/a b": "invalid_url", "https://example.com/a\\b": "invalid_url"}
    df = spark.createDataFrame([(u,) for u in queries], "url string").select(U.checked_url(F.col("url"), PUBLIC))
    assert [r[0] for r in df.collect()] == list(queries.values())
    with pytest.raises(ValueError):
        TargetPolicy("public_http", allowlist=(("localhost", False),))


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(1)
    v4 = [".".join(str(rng.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, rng.randrange(256)])) if i == 0
                   else str(rng.randrange(256)) for i in range(4)) for _ in range(400)]
    v4 += ["100.64.0.1", "192.0.2.1", "198.19.255.255", "172.31.0.1", "172.32.0.1", "8.8.8.8", "169.254.1.1", "256.1.1.1", "01.2.3.4", "1.2.3", ""]
    extra = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "240.0.0.0/4")]

    def blocked(text):
        try:
            ip = ipaddress.IPv4Address(text)
        except ValueError:
            return True
        return (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or any(ip in n for n in extra))
    v6 = {"::1": True, "fe80::1%eth0": True, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "2001:4860:4860::8888": False,
          "2002::1": True, "2001::1": True, "fc00::1": True, "zz::": True}
    df = spark.createDataFrame([(t,) for t in [*v4, *v6]], "ip string").select("ip", A.ip_blocked(F.col("ip")).alias("b"))
    assert {r.ip: r.b for r in df.collect()} == {**{t: blocked(t) for t in v4}, **v6}
    hosts = spark.createDataFrame([("a", "8.8.8.8"), ("a", "10.0.0.1"), ("b", "8.8.4.4"), ("c", None)], "host string, ip string")
    assert {r.host: r.code for r in A.admit_hosts(hosts).collect()} == {"a": "ssrf_ip_blocked", "b": None, "c": "target_resolution_failed"}


def test_robots_against_the_standard_library(spark):
    from urllib.robotparser import RobotFileParser
    texts = ["", "User-agent: *\nDisallow: /private\nAllow: /private/open\n", "User-agent: *\nAllow: /private/open\nDisallow: /private",
             "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /a # note\n", "Disallow: /\nUser-agent: x\n\nDisallow: /y\n",
             "User-agent: a\nUser-agent: bot\nDisallow: /b\nCrawl-delay: 3\nUser-agent: *\nDisallow:\n", "# only a note\n\n\nUser-agent: *\n\nDisallow: /z",
             "User-agent: *\nDisallow: /%7Ejoe\nDisallow: /sp%20ace"]
    paths = ["/", "/private", "/private/open/x", "/a", "/b/c", "/y", "/z", "/~joe/x", "/sp%20ace/1"]
    files = spark.createDataFrame([(f"o{i}", t, True) for i, t in enumerate(texts)] + [("down", None, False)], "origin string, text string, fetched boolean")
    pages = spark.createDataFrame([(f"o{i}", p) for i in range(len(texts)) for p in paths] + [("down", "/"), ("o0", "rel")], "origin string, path string")
    for agent in ("*", "bot/1.0"):
        got = {(r.origin, r.path): r.allowed for r in A.robots_filter(pages, A.robots_rules(files), agent).collect()}
        for i, text in enumerate(texts):
            parser = RobotFileParser()
            parser.parse(text.splitlines())
            for p in paths:
                assert got[f"o{i}", p] == parser.can_fetch(agent, p), (text, p, agent)
        assert not got["down", "/"] and not got["o0", "rel"]


def test_intents(spark):
    want = {"collect product prices": ("PUBLIC", None), "please BYPASS the phone number check": ("RESTRICTED", "circumvention_not_allowed"),
            "get Phone Number list": ("SENSITIVE", "possible_personal_data_collection"), "采集用户列表": ("SENSITIVE", "privacy_data_collection"),
            "破解验证码": ("RESTRICTED", "circumvention_not_allowed")}
    df = spark.createDataFrame([(t,) for t in want], "t string").select(A.classify_intent(F.col("t")).alias("i"))
    assert [(r.i.classification, r.i.reason) for r in df.collect()] == list(want.values())
    kinds = spark.createDataFrame([("PUBLIC", False), ("AUTHORIZED", True), ("AUTHORIZED", False), ("RESTRICTED", True)], "k string, a boolean")
    assert [tuple(r.d) for r in kinds.select(A.decide(F.col("k"), F.col("a")).alias("d")).collect()] == [
        (True, None), (True, None), (False, "authorization_required"), (False, "restricted_data_not_supported")]


def test_request_log(spark):
    row = lambda i, **c: {**{"session": "s", "seq": i, "method": "GET", "resource_type": "xhr", "status": 200, "content_type": "application/json",
                             "url": "http://h/api?page=1", "request_headers": {"Accept": "x"}, "post_data": None, "body": "{}"}, **c}
    ok_post = {"method": "POST", "request_headers": {"CONTENT-type": "application/json; charset=utf-8"}, "post_data": '{"page":1}'}
    rows = [row(1), row(2, method="PUT"), row(3, resource_type="image"), row(4, status=302), row(5, content_type="text/html"),
            row(6, url="http://h/?a=1&a=2"), row(7, request_headers={"Cookie": "x"}), row(8, **{**ok_post, "post_data": "[1]"}),
            row(9, **ok_post), row(10, body="3"), row(11, **{**ok_post, "post_data": '{"password":1}'}), row(12, url="http://h/x?e=")]
    rows += [row(i) for i in range(13, 31)]
    schema = ("session string, seq int, method string, resource_type string, status int, content_type string, url string, "
              "request_headers map<string,string>, post_data string, body string")
    df = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.split(", ")) for r in rows], schema)
    out = {r.seq: (r.reason, r.request_id) for r in A.admit_observations(df).collect()}
    assert len(out) == 30 and out[1] == (None, "req_001") and out[9] == (None, "req_002") and out[12] == (None, "req_003") and out[30] == (None, "req_021")
    few = {r.seq: r.reason for r in A.admit_observations(df, per_session=20).collect()}
    assert len(few) == 30 and {few[i] for i in range(21, 31)} == {"not_observed"} and few[20] is None
    own = df.withColumn("origin", F.when(F.col("seq") == 1, "http://h:80").otherwise("http://h"))
    assert {r.seq for r in A.admit_observations(own).filter("reason = 'origin'").collect()} == {1}
    assert [out[i][0] for i in range(2, 9)] == ["method", "resource_type", "status", "content_type", "query", "headers", "request_body"]
    assert out[10][0] == "body" and out[11][0] == "request_body"
