"""HTML extraction: lists with detail pages, chains of any length, odd markup."""

import os
import random
import subprocess
import sys
from urllib.parse import urljoin

from pyspark import cloudpickle
from pyspark.sql import functions as F

from evigrid.functions import markup as M
from evigrid.functions.urls import checked_url, join_url, url_parts
from evigrid.operators import html as H, validate as V
from evigrid.plans.specs import FieldSpec, HtmlField, HtmlPlan, TargetPolicy

SITE = "http://127.0.0.1:8000"
PLAN = HtmlPlan("div.offer", {"name": HtmlField("h3"), "maker": HtmlField("dd.maker", source="detail")}, "a.open", "a.onward")
SPECS = [FieldSpec("name", "string"), FieldSpec("maker", "string", False)]
ROW = '<div class="offer wide"><h3> {0}</h3><a class="open" href="/kit/{1}">see</a></div>'
PAGES = {"/": ROW.format("Lathe", 1) + '<a class="onward" href="/more/2">further</a>', "/more/2": ROW.format("Vise", 2),
         "/kit/1": '<dl><dt>Made by<dd class="maker">Ost &amp; Sohn</dl>', "/kit/2": "<p>maker unknown</p>"}


def collect(spark, pages, plan=PLAN, specs=SPECS, **options):
    docs = spark.createDataFrame([(SITE + p, f"<html><body>{b}</body></html>") for p, b in pages.items()], "url string, html string")
    entries = spark.createDataFrame([(1, SITE + "/")], "source_id int, url string")
    records, summary = H.html_collect(entries, docs, plan, specs, **options)
    return records.orderBy("ordinal").collect(), summary.first()


def test_list_and_detail(spark):
    rows, out = collect(spark, PAGES, max_pages=2, max_records=10)
    assert [(r.name, r.maker, r.source_url) for r in rows] == [("Lathe", "Ost & Sohn", SITE + "/kit/1"), ("Vise", None, SITE + "/kit/2")]
    assert (out.status, out.pages, out.completeness) == ("succeeded", 2, "stop_condition_only")
    missing = V.missing_counts(spark.createDataFrame([(r.name, r.maker) for r in rows], "name string, maker string"), ["name", "maker"])
    assert {r.field: r.missing for r in missing.collect()} == {"name": 0, "maker": 1}


def test_failures_and_limits(spark):
    def code(changes, **options):
        return collect(spark, {**PAGES, **changes}, **options)[1].error_code
    assert code({"/more/2": PAGES["/more/2"] + '<a class="onward" href="/">back</a>'}) == "pagination_cycle"
    assert code({"/more/2": "<p>nothing</p>"}) == "no_list_sample"
    assert code({"/more/2": '<div class="offer"><h3>x</h3></div>'}) == "detail_link_missing"
    assert code({"/more/2": '<div class="offer"><a class="open" href="http://127.0.0.1:9/x">x</a></div>'}) == "cross_origin_request"
    assert code({"/more/2": '<div class="offer"><a class="open" href="https://example.com/x">x</a></div>'}) == "only_literal_loopback_http_supported"
    assert code({"/kit/1": "<p></p>"}, specs=[SPECS[0], FieldSpec("maker", "string")]) == "required_field_missing"
    many = "".join(ROW.format(f"B{i}", 1) for i in range(70))
    assert code({"/": many}, max_requests=60) == "html_request_budget_exceeded" and code({"/": many}) is None
    assert code({"/": many + "".join(f'<div class="offer"><h3>C{i}</h3></div>' for i in range(1000))}, max_page_records=1000) == "too_many_page_records"
    rows, out = collect(spark, {**PAGES, "/": many}, max_records=5)
    assert len(rows) == 5 and out.record_limit_reached and out.completeness == "partial"
    rows, out = collect(spark, {**PAGES, "/": ROW.format("Lathe", 1) + PAGES["/"]})
    assert out.duplicates_removed == 1 and out["count"] == 2


def test_long_chain(spark):
    """75 pages, then one that leads back to the third."""
    links = spark.createDataFrame([(f"u{i}", f"u{i + 1}" if i < 75 else "u3", None) for i in range(1, 76)], "url string, next string, code string")
    entries = spark.createDataFrame([(1, "u1"), (2, "u70"), (3, "gone")], "source_id int, url string")
    out = {}
    for r in H.next_link_chain(entries, links).collect():
        out.setdefault(r.source_id, []).append((r.page_no, r.url, r.code))
    assert sorted(out[1])[-2:] == [(75, "u75", None), (76, "u3", "pagination_cycle")] and len(out[1]) == 76
    assert sorted(out[2])[5:8] == [(6, "u75", None), (7, "u3", None), (8, "u4", None)] and sorted(out[2])[-1] == (74, "u70", "pagination_cycle")
    assert out[3] == [(1, "gone", None)]


def test_markup_corner_cases():
    doc = ('<html><body><script>var a="<article class=book>x</article>"</script><!-- <article class="book"> -->'
           '<div id=top class="a  b"><p>one<p>two <b>three<br></p><ul><li>x<li class="k">y &amp; z</ul></div>'
           "<article data-id='7'><h2>T &lt;1&gt;</h2></article></body></html>")
    nodes = M.parse(doc)
    value = lambda s, a="text": M.value(nodes, s, a)
    assert value("article.book") is None and value("article h2") == "T <1>" and value("#top > p") == "one"
    assert value("li.k") == "y & z" and value("div.a.b li") == "x" and value("article[data-id=7]", "data-id") == "7"
    assert [n.tag for n in M.select(nodes, "h2, li")] == ["li", "li", "h2"] and value("ul > p") is None


def test_reference_resolution(spark):
    bases = ["https://a.example.com/x/y?q=1", "http://h", "http://h/", "http://h/a/b/c/"]
    hrefs = ["", "z", "./z", "../z", "../../../z", "/a/./b/../c", "/a/..", "z/.", "?p=2", "#f", "?p#f", "//other.org/a/../b", "mailto:x", "ftp://h/x", "z?a=1#b", "/", "a..b/.c", "et."]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    assert [(r.base, r.href, r.t) for r in df.withColumn("t", join_url("base", "href")).collect()] == [(b, h, urljoin(b, h)) for b in bases for h in hrefs]


def test_links_and_outline(spark):
    base = "https://a.example.com/x/y?q=1"
    hrefs = ["/z", "z", "../z", "?p=2", "#f", "//other.org/a", "http://a.example.com/", "mailto:x", "z?a=1&a=2"]
    policy = TargetPolicy("public_http", allowlist=(("example.com", True),))
    df = spark.createDataFrame([(base, h) for h in hrefs], "base string, href string")
    out = {r.href: (r.target, r.code) for r in H.same_origin_links(df, policy).collect()}
    assert {h: t for h, (t, _) in out.items()} == {h: urljoin(base, h) for h in hrefs}
    assert [out[h][1] for h in hrefs] == [None, None, None, None, "invalid_url", "target_not_in_allowlist", "public_scheme_not_allowed",
                                          "invalid_url", "unsupported_query"]
    html = ('<body><main><li class="a b c d"><a href="/d" title="t">x</a></li><li class="a b c d" data-x="1"></li>'
            '<input name="q"><p id="token-box">y</p></main></body>')
    rows = {r.selector: r for r in H.dom_outline(spark.createDataFrame([(1, html)], "page_id bigint, html string")).collect()}
    assert set(rows) == {"main", "li.a.b.c", "a"} and rows["li.a.b.c"].attributes == ["class", "data-x"]
    assert rows["a"].parent == "li" and rows["a"].sample_link == "/d"
    wide = "<body>" + "".join(f'<i class="c{i}"></i>' for i in range(150)) + '<i class="c0" late="1"></i></body>'
    page = spark.createDataFrame([(1, wide)], "page_id bigint, html string")
    assert H.dom_outline(page).count() == 150
    out = H.dom_outline(page, limit=100).collect()
    assert len(out) == 100 and all("late" not in r.attributes for r in out)


def test_stored_parse_is_dealt_over_tasks(spark):
    """Documents that come from one small split are parsed by many tasks, with the rows of a plain parse."""
    plan = HtmlPlan("li", {"name": HtmlField("b"), "more": HtmlField("i", source="detail")}, "a", "a.next")
    pages = [(f"http://example.com/{i}", "".join(f"<li><b>{i} {k}</b><a href='/{k}'>x</a>" for k in range(i % 4)) + "<i>end</i><a class=next href=/n>n</a>")
             for i in range(300)]
    documents = spark.createDataFrame(pages, "url string, html string").coalesce(1)
    stored = H.parse_stored(documents, plan)
    assert len({os.path.basename(r[0]).split("-")[1] for r in stored.select(F.input_file_name()).distinct().collect()}) > 4
    of = lambda df: sorted(df.selectExpr("to_json(struct(*))").collect())
    assert of(stored) == of(H.parse_documents(documents, plan))
    assert stored.where("n_nodes = 0").first()["detail_values"] == {"more": "end"}


def test_plain_documents_are_read_as_by_the_parser():
    """Documents of plain tokens, which are read several times as fast, give the nodes that the parser gives; all others go to it."""
    def through(html):
        builder = M._Builder()
        builder.feed(html)
        builder.close()
        return builder.nodes

    def view(nodes):
        return [(n.tag, list(n.attrs.items()), n.pos, n.parent.pos, n.text(), [c.pos for c in n.children if not isinstance(c, str)]) for n in nodes]

    parts = ["<p>", "</p>", '<div class="a b">', "</div>", "<a href='/x?y=1'>", "</a>", "<li>", "<ul>", "</ul>", "<br>", "text", " a &amp; b ", "&lt", "<P CLASS=x>", "<td>",
             "<table>", '<script>var a="</p><b>";</script>', "<script>x<!-- y</script>", "<script>a", "<style>p{}</style>", "<title>a&amp;b</title>", "<title>a<b>c</title>",
             "<!-- c -->", "<!--x--y-->", "<!DOCTYPE html>", "<", ">", "</ p>", '<a b c="1" b="2">', '<a b="1"c="2">', "<a href=/n>", '<img src="a.png" />', '<a x="&amp;">',
             "<textarea><p></textarea>", "<option>", "<select>", "<button>", "</button>", "<![CDATA[x]]>", "\n"]
    rng, plain = random.Random(4), 0
    for _ in range(4000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        fast = M._parse_plain(html)
        plain += fast is not None
        assert view(M.parse(html)) == view(through(html)) and (fast is None or view(fast) == view(through(html))), html
    assert plain > 500
    shop = '<!DOCTYPE html><html><head><title>x</title></head><body><script>var a="</p>";</script><article class="row big"><h2> 1</h2><a class=next href="/c/1">n</a></article></body></html>'
    assert len(M._parse_plain(shop)) == 8


def test_helper_travels_by_value(tmp_path):
    """A worker without a copy of the package reads documents all the same."""
    from evigrid import session  # noqa: F401 - has the package travel by value

    sent = cloudpickle.dumps(lambda html: [n.text() for n in M.select(M.parse(html), "p.state")])
    told = subprocess.run([sys.executable, "-c", "import sys, pickle; print(pickle.load(sys.stdin.buffer)('<p class=state>one<p>two'))"], input=sent, cwd=tmp_path,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, check=True)
    assert told.stdout.decode().strip() == "['one']"


def test_link_checks_work_parts_out_once(spark):
    """Parts of an address are named by many rules; the plan holds each of them a few times, not once a use."""
    policy = TargetPolicy("public_http", allowlist=(("example.com", True), ("example.org", True)))
    bases = ["https://a.example.com/x/y", "https://example.com", "HTTPS://a.example.com/", "https://u@a.example.com/", "https://other.net/", "http://a.example.com/", "a b"]
    hrefs = ["/z", "z", "//example.org/a", "/z?token=1", "/a b", "/#f", "https://a.example.com/z", "", None, "/..", "https://a.example.com.evil.net/"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    links = H.same_origin_links(df, policy)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") < 60
    origin = url_parts(F.col("base")).origin
    near = H.near_link_error(F.col("target"), origin, checked_url(F.concat(origin, F.lit("/")), policy), policy)
    rows = links.withColumn("near", near).collect()
    assert all(r.near == r.code for r in rows) and len({r.code for r in rows}) == 6
