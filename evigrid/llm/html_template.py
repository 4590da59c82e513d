"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by their path, and its text blocks. Tokens of one host that occur equally often
on every page share an occurrence vector and form an equivalence class, whatever their paths; a token that occurs k times on each of
its pages stands for k tokens that occur once. A text is template if an element around it (the page itself counts as one) is
of its class, so that classes nest, and if the class spans the host's pages: more than a share of the different
ones. Pages with the same article text are one page there, so copies of an article are no template. What is left are the slots.

Occurrence vectors are never gathered: each is a sum of per-page hashes, so equal vectors have equal sums whatever a host's size.
"""

from __future__ import annotations

import html
import re

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import store

# HTML's element kinds, and the names that mark what is not article text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "title", "select", "canvas", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "details"}
LIMITS = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main", "blockquote"}
CONTENT = {"article", "main"}
ITEMS = {"li", "dt", "dd", "td", "th"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar"}
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice\w*|popup|modal|side-?bar\w*|menu\w*|nav|navbar|navigation|"
    r"breadcrumbs?|header|masthead|footer|comments?|commentlist|disqus|share|sharing|social|related|newsletter|subscribe|widget\w*|toolbar|pagination|"
    r"login|signup)(?:$|[\s_-])", re.I)

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|"[^"]*"|'[^']*'""")


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a start tag, what follows its name: names lower-cased, the first of a name counts. Quoted strings without a name are none."""
    given: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(tag):
        if m[1]:
            given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return given


#: Degrees of being set aside: in the header of an article, whose title stays; anywhere else.
HEADER, OFF = 1, 2


def set_aside(given: dict[str, str], by_name: bool = True) -> bool:
    """Whether an element's attributes say that it is not article text: hidden, a role, or with ``by_name`` its class or id."""
    if "hidden" in given or given.get("role", "").lower() in ASIDE_ROLES:
        return True
    mark = f"{given.get('class', '')} {given.get('id', '')}"
    return by_name and bool(mark.strip() and ASIDE_NAME.search(mark))


def blocks_of(page: str) -> tuple[list[tuple[str, bool, bool, str]], dict[str, int]]:
    """Text blocks in page order as (path, inside content, set aside, text), and how often each element path occurs."""
    blocks, elements = [], {}
    stack: list[tuple[str, str, bool, int]] = []  # tag, path, inside content, set aside (see OFF)
    text: list[str] = []
    skip: tuple[str, int, int] | None = None  # an inline element set aside: tag, how often it is open, blocks open around it

    def here():
        return stack[-1] if stack else ("", "", False, 0)

    def flush():
        words = "".join(text)
        text.clear()
        if "&" in words:
            words = html.unescape(words)
        words = " ".join(words.split())
        if words:
            _, path, inside, aside = here()
            blocks.append((path, inside, aside > 0, words))

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if not skip:
            text.append(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif skip:
                if tag == skip[0]:
                    n = skip[1] + (-1 if closing else 1)
                    skip = (tag, n, skip[2]) if n else None
            elif not closing and tag not in VOID and rest and set_aside(attributes(rest)):
                skip = (tag, 1, len(stack))
            continue
        if closing:
            if any(s[0] == tag for s in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
                if skip and len(stack) < skip[2]:  # the block around an unclosed inline element ends it
                    skip = None
            continue
        if tag in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            text.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in LIMITS:
                    break
        _, path, inside, aside = here()
        if tag == "body":  # an unclosed head does not reach into the body
            stack[:] = [s for s in stack if s[0] == "html"]
            _, path, inside, aside = here()
        given = attributes(rest) if rest else {}
        names = given.get("class", "").split()
        body, main = tag in ("html", "body"), tag in CONTENT or given.get("role", "").lower() == "main"
        off = OFF if not body and (tag in ASIDE or set_aside(given, not main)) else 0
        if tag == "header" and inside and not set_aside(given):
            off = HEADER
        elif tag == "h1" and aside == HEADER:  # the title stands in the article's header
            aside = 0
        path = f"{path}>{tag}" + "".join(sorted("." + n for n in names))
        elements[path] = elements.get(path, 0) + 1
        stack.append((tag, path, inside or main, max(aside, off)))
    flush()
    return blocks, elements


def number(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)))


def constant(path: str, text: str) -> int:
    """Number of a text token: its text at its path."""
    return (number(path, text) >> 1) or 1


def slots_of(page: str) -> tuple[list[tuple[str, str, bool]], dict[str, int]]:
    """(path, text, whether it can be template) of the blocks that may be article, in page order, and how often each element path occurs.

    These are the blocks inside content elements (article, main), or all of a page without any, but those set aside. Items of
    lists and tables inside content elements are no template.
    """
    blocks, elements = blocks_of(page)
    content = any(b[1] for b in blocks)
    return [(path, text, not (inside and path[path.rfind(">") + 1:].split(".")[0] in ITEMS))
            for path, inside, aside, text in blocks if not aside and (inside or not content)], elements


def tokens_of(page_no: int, page: str):
    """(path, text hash or 0, vector hash, count) of every token of a page; of its texts only those that may be article."""
    own, elements = slots_of(page)
    counts: dict[tuple[str, int], int] = {(path, 0): n for path, n in elements.items()}
    for path, text, _ in own:
        key = (path, constant(path, text))
        counts[key] = counts.get(key, 0) + 1
    for (path, t), n in counts.items():
        yield path, t, number(page_no, n) >> 32, n


def host_of(url: Column) -> Column:
    """Host of a URL, lower-cased; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, least: int = 3, url: str = "url", page: str = "html", share: float = 0.5) -> DataFrame:
    """One row per host: ``host``, ``constants`` (number of path and text of each text token that belongs to the template).

    A text belongs to it if its occurrence vector over the host's pages equals that of an element around it, and it is on at
    least ``least`` pages and more than ``share`` of the host's pages that differ in article text. Pages without any do not count.
    Vectors are compared by sum, support and total.
    """
    def count(batches):
        import pyarrow as pa

        held: dict[tuple[str, str, int], list[int]] = {}

        def rows():
            keys, values = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()),
                 *[pa.array([v[i] for v in values], pa.int64()) for i in range(6)]],
                ["host", "path", "text", "vector", "once", "pages", "total", "low", "high"])
        for batch in batches:
            for host, no, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens, once = list(tokens_of(no, body or "")), number(no, 1) >> 32
                if not any(t for _, t, _, _ in tokens):
                    continue
                for path, t, vector, n in [("", 0, once, 1), *tokens]:
                    v = held.setdefault((host, path, t), [0, 0, 0, 0, n, n])
                    v[0] += vector
                    v[1] += once
                    v[2] += 1
                    v[3] += n
                    v[4], v[5] = min(v[4], n), max(v[5], n)
            if len(held) > 200_000:
                yield rows()
        yield rows()

    def spans(batches):
        """Article text (as a number) of every page, with each candidate on it and with 0 for the page itself."""
        import pyarrow as pa

        for batch in batches:
            found = set()
            for host, body, candidates in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own, _ = slots_of(body or "")
                if own:
                    article = number(*[t for _, t, _ in own]) >> 1
                    found.update((host, t, article) for t in {0, *(constant(path, t) for path, t, free in own if free)}.intersection([0, *candidates]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string() if not i else pa.int64()) for i in range(3)],
                                             ["host", "text", "article"])

    row_no = F.xxhash64(F.col(url), F.col(page))
    rows = pages.select(host_of(F.col(url)).alias("host"), row_no.alias("no"), F.col(page).alias("html"))
    uniform = F.col("low") == F.col("high")
    tokens = (rows.mapInArrow(count, "host string, path string, text long, vector long, once long, pages long, total long, low long, high long")
              .groupBy("host", "path", "text").agg(*[F.sum(c).alias(c) for c in ("vector", "once", "pages", "total")], F.min("low").alias("low"), F.max("high").alias("high"))
              .where(F.col("pages") >= least)
              .select("host", "path", "text", "pages", F.when(uniform, F.col("once")).otherwise(F.col("vector")).alias("vector"),
                      F.when(uniform, F.col("pages")).otherwise(F.col("total")).alias("total")))
    tokens = store(tokens, "html-tokens")
    same = ["host", "path", "vector", "pages", "total"]
    steps = F.split("path", ">")
    around = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ">"))
    nested = tokens.where("text <> 0").withColumn("path", F.explode(around)).join(tokens.where("text = 0").select(*same), same)
    candidates = store(nested.groupBy("host").agg(F.collect_set("text").alias("candidates")), "html-candidates")

    seen = (rows.select("host", "html").join(candidates.withColumnRenamed("host", "c_host"), F.col("host") == F.col("c_host"))
            .select("host", "html", "candidates").mapInArrow(spans, "host string, text long, article long").distinct())
    support = store(seen.groupBy("host", "text").agg(F.count("*").alias("n")), "html-support")
    every = support.where("text = 0").select("host", F.col("n").alias("of"))
    valid = support.where("text <> 0").join(every, "host").where((F.col("n") >= least) & (F.col("n") > share * F.col("of")))
    return valid.groupBy("host").agg(F.collect_set("text").alias("constants"))


def extract(pages: DataFrame, least: int = 3, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (blocks of the article joined by an empty line), ``n_chars`` (code points).

    Where a page has content elements (article, main) only the blocks inside them count, elsewhere all. Blocks set aside by their
    element, role or name (menus, headers, footers, sidebars, notices, adverts, forms, comments) and the template's constant texts
    are left out; a page of constant texts only keeps them. Null and empty pages give the empty text; a null URL is a host of its own; pages of a
    host with fewer than ``least`` pages have no constants. Repeated rows stay; further columns are ignored.
    """
    found = store(templates(pages, least, url, page), "html-templates").withColumnRenamed("host", "t_host")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for body, constants in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own, _ = slots_of(body or "")
                fixed = set(constants or ())
                # A page without slots shows a copy, not a template: it keeps its text.
                keep = [t for path, t, free in own if not (fixed and free) or constant(path, t) not in fixed] or [t for _, t, _ in own]
                texts.append("\n\n".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             ["key", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    rows = (pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(F.col(url)).alias("host"))
            .join(found, F.col("host") == F.col("t_host"), "left").select("key", "url", "html", "constants")
            .mapInArrow(cut, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long"))
    return rows.select(F.col("key").alias("page_id"), "url", "text", "n_chars")
