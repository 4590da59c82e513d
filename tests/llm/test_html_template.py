"""Main text of pages by template deduction."""

from evigrid.llm import html_template as H

PAGE = ('<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x="</p><article>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
        '<!-- <p>hidden</p> --><div class="ad">Buy now</div><article><h1>Head {0}</h1><p><b>First &amp; {0}<br>line\n\t two<p>Second&nbsp;{0} &lt;b&gt; &eacute;</p>'
        '<form><p>Search</p><input name=q></form><div id="comments"><p>I disagree</p></div><ul><li>one<li>two</ul></article>'
        '<aside>Side</aside><footer>&copy; site {0}</footer></body></html>')
SCHEMA = "page_id long, url string, html string, text string, host string, n_chars long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], SCHEMA)


def texts(spark, rows):
    return sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(pages(spark, rows).repartition(3)).collect()), key=repr)


def test_article(spark):
    want = "Head {0}\n\nFirst & {0} line two\n\nSecond {0} <b> é\n\none\n\ntwo"
    rows = [(i, f"https://h{i % 2}.example.com/{i}", PAGE.format(i)) for i in range(12)]
    assert texts(spark, rows) == sorted([(i, u, want.format(i), len(want.format(i))) for i, u, _ in rows], key=repr)


def test_constants_of_a_template(spark):
    """Without content elements, a text that comes with its element on every page of a host is template; others are slots."""
    page = "<html><body><div><p>Welcome to our site</p></div><div class=main-text><p>Story {0}</p><p>{1}</p></div></body></html>"
    rows = [(i, f"http://a.example.com/{i}", page.format(i, "shared by some" if i % 2 else f"own {i}")) for i in range(6)]
    rows += [(10, "http://b.example.com/1", page.format(10, "alone"))]
    out = {r[0]: r[2] for r in texts(spark, rows)}
    assert out[1] == "Story 1\n\nshared by some" and out[2] == "Story 2\n\nown 2"
    assert out[10] == "Welcome to our site\n\nStory 10\n\nalone"  # one page shows no template


def test_copies_of_an_article_keep_it(spark):
    rows = [(i, f"http://a.example.com/{i}", "<body><nav>Menu</nav><article><p>The same words.</p></article></body>") for i in range(8)]
    assert {r[2] for r in texts(spark, rows)} == {"The same words."}


def test_vectors_tell_classes_apart():
    """Tokens that occur equally often on every page have the same vector, others do not."""
    sums = {}
    for no, n_items in enumerate([1, 3, 2, 3]):
        items = "".join(f"<li><i>x{no}{k}</i></li>" for k in range(n_items))
        for path, t, vector, n in H.tokens_of(no, f"<html><body><ul>{items}</ul><p>fixed</p></body></html>"):
            v = sums.setdefault((path, t), [0, 0])
            v[0] += vector
            v[1] += n
    fixed = H.constant(">html>body>p", "fixed")
    once = [k for k, v in sums.items() if v == sums[">html>body>p", 0]]
    assert set(once) == {(">html", 0), (">html>body", 0), (">html>body>ul", 0), (">html>body>p", 0), (">html>body>p", fixed)}
    assert sums[">html>body>ul>li", 0][1] == 9


def test_broken_markup():
    long = "<p>" + "x " * 50_000 + "</p>" + "<div>" * 500 + "deep"
    blocks, _ = H.blocks_of(long)
    assert [b[3] for b in blocks] == [("x " * 50_000).strip(), "deep"]
    for text in ("", "<", "<p", "</p>", "a<b>c", '<a href="x', "<script>never closed", "<!-- never closed", "<p>a</div>b</p>", "&#0;&bogus;", "<table><td>1<td>2<tr><td>3"):
        H.blocks_of(text)
    assert [b[3] for b in H.blocks_of("<table><tr><td>1<td>2<tr><td>3</table>")[0]] == ["1", "2", "3"]
    assert [b[3] for b in H.blocks_of("a<b>c")[0]] == ["ac"]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a.example.com/", ""), (None, "no url", "<p>x</p>"), (3, "http://A.example.com:80/", "plain"), (3, "http://A.example.com:80/", "plain")]
    assert texts(spark, rows) == sorted([(1, None, "", 0), (2, "http://a.example.com/", "", 0), (None, "no url", "x", 1), (3, "http://A.example.com:80/", "plain", 5),
                                         (3, "http://A.example.com:80/", "plain", 5)], key=repr)
    assert H.extract(pages(spark, rows).limit(0)).count() == 0


def test_constants_inside_content_elements(spark):
    page = "<body><article><h1>Head {0}</h1><div class=x1>Spread the word</div><p>Story {0}</p><p>Second {0}</p></article></body>"
    rows = [(i, f"http://a.example.com/{i}", page.format(i)) for i in range(6)] + [(9, "http://a.example.com/9", "<body><main><div class=x1>Spread the word</div></main></body>")]
    out = {r[0]: r[2] for r in texts(spark, rows)}
    assert out[3] == "Head 3\n\nStory 3\n\nSecond 3"
    assert out[9] == "Spread the word"  # a page without slots


def test_boilerplate_in_a_path_it_shares_with_paragraphs(spark):
    """Once or twice on every page, or with every teaser: the class of an element around the text, not its own path."""
    page = "<body><div><p>Spread the word</p>{1}<p>Read more</p><p>Read more</p></div></body>"
    rows = [(i, f"http://a.example.com/{i}", page.format(i, "".join(f"<p>Part {k} of {i}</p>" for k in range(1 + i % 3)))) for i in range(7)]
    teaser = "<section><h2>{0}</h2><p>On {0}</p><p>Go on</p></section>"
    rows += [(20 + i, f"http://b.example.com/{i}", "<body>" + "".join(teaser.format(f"{k} of {i}") for k in range(1 + i % 3)) + "</body>") for i in range(5)]
    out = {r[0]: r[2] for r in texts(spark, rows)}
    assert out[2] == "Part 0 of 2\n\nPart 1 of 2\n\nPart 2 of 2" and out[3] == "Part 0 of 3"
    assert out[21] == "0 of 1\n\nOn 0 of 1\n\n1 of 1\n\nOn 1 of 1"


def test_copies_of_a_post_under_a_path_of_its_own(spark):
    page = "<body><div class=top><p>Day {0}</p></div><div class=post-{1}>{2}</div></body>"
    rows = [(i, f"http://a.example.com/{i}", page.format(i, 77, "One post.")) for i in range(3)]
    rows += [(i, f"http://a.example.com/{i}", page.format(i, i, f"Post {i}.")) for i in range(3, 7)]
    rows += [(i, f"http://b.example.com/{i}", f"<body><nav>{i}</nav><div class=intro>A</div><div class=post-77>One post.</div></body>") for i in range(10, 13)]
    rows += [(13, "http://b.example.com/13", "<body><div class=intro>A</div><p>Other</p></body>")]
    out = {r[0]: r[2] for r in texts(spark, rows)}
    assert out[1] == "Day 1\n\nOne post." and out[5] == "Day 5\n\nPost 5."
    assert out[11] == "A\n\nOne post."  # two pages that differ in text show no template


def test_attributes_by_whole_name():
    kept = ['<div style="overflow:hidden">', '<section aria-hidden="false">', "<div data-class=sidebar data-id=nav>", '<div title="x hidden class=sidebar">', "<div id=a/b hidden-x=1>",
            '<main class="no-sidebar">', '<article class="post has-comments">', '<div role=main id=sidebar>', '<div class=a class="menu">']
    gone = ["<div hidden>", '<div HIDDEN="">', "<div hidden=until-found class=x>", '<div id="sidebar" width=3>', "<div class='x menu' data-x>", "<div\n class = nav\n>", "<article hidden>", "<main role=search>"]
    for tag in kept + gone:
        assert [b[2] for b in H.blocks_of(f"<body>{tag}Text")[0]] == [tag in gone], tag
    assert H.attributes(' CLASS="a b" id=c checked data-id="d" width = 4') == {"class": "a b", "id": "c", "checked": "", "data-id": "d", "width": "4"}


def test_inline_elements_and_headers_of_articles():
    from evigrid.llm.html_template import slots_of

    def texts(page):
        return [t for _, t, _ in slots_of(page)[0]]

    assert texts('<article><p>Hi <span class="advert">Buy <span>it</span> now</span>there <span hidden>secret</span> <b class="x">you</b></p></article>') == ["Hi there you"]
    assert texts('<article><p>a <span class="ads">b <p>c</p></article><p>d') == ["a"]  # unclosed: ends with the block around it
    assert texts('<p>a <span class="ads">b</p><p>c</p>') == ["a", "c"]
    assert texts('<p>a <img class="ads">b<br class="ads">c <a role="navigation">x</a></p>') == ["a b c"]
    assert texts("<article><header><h1>Title</h1><p>by me</p></header><p>x</p></article>") == ["Title", "x"]
    assert texts('<article><header class="banner"><h1>Title</h1></header><p>x</p></article>') == ["x"]
    assert texts("<header><h1>Site</h1></header><article><nav><h1>n</h1></nav><p>x</p></article>") == ["x"]
