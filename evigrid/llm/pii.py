"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Seeds are identifiers with a fixed form (e-mail, IP address, card and phone number). The words in front of them are
lexical patterns. Patterns and instances form a bipartite graph that is scored in rounds: a pattern is as trusted
as the instances it introduces, an instance as the patterns that introduce it. Patterns above a threshold then turn
identifier-like tokens that no fixed form caught into further spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, store

# Kinds in the order of the digest, and their forms. Possessive quantifiers and the look-behind
# (or the end of the previous match) find the same matches in linear time.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What the digits and at signs of a found identifier become in a masked text, so that every token keeps its place.
_MASK = "\x01" * 10 + "\x02"
_NUMBER = r"[0-9\x01().\-/]*[0-9\x01][0-9\x01().\-/]*"
#: Identifier-like tokens that no form has to know: numbers in groups, else a token with a digit or an at sign.
TOKEN = (rf"(?<![^\x20\x09-\x0D])(?:\+?{_NUMBER}(?:\x20{_NUMBER})+(?![^\x20\x09-\x0D])|"
         r"[^\x20\x09-\x0D]*[0-9@\x01\x02][^\x20\x09-\x0D]*)")
SPAN = "array<struct<start:int,no:int,end:int,kind:string,value:string,ahead:string>>"
#: Lengths of pieces: of an array whose running values are taken, of a text that is cut at many places.
PIECE, STRIP = 64, 1024


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` reads it for every element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join, zero: Column, levels: int = 3) -> Column:
    """For every element of an array the join of all before it, ``zero`` for the first; ``join`` is associative.

    Growing an array copies it, so running values are taken in pieces of PIECE elements, then over the pieces' totals.
    """
    def piece(part):
        start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    if levels == 1:
        return piece(values)["out"]

    def joined(parts):
        before = running(F.transform(parts, lambda p: p["at"]), join, zero, levels - 1)
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["out"], lambda v: join(b, v))))

    def cut(v):
        places = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(places, lambda i: piece(F.slice(v, i, F.lit(PIECE)))), joined)

    return let(values, cut)


def pairs_of(text: Column, pattern: str) -> Column:
    """(gap, value) of every match, in order; last the gap behind all of them, with a null value."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))


def last_words(gap: Column) -> Column:
    """The last two words of a text's last line, joined by a blank."""
    words = F.regexp_extract_all(F.substring_index(gap, "\n", -1), F.lit(WORD), F.lit(0))
    return let(words, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)), " "))


def spans_of(pairs: Column, kind: str | None, no: int) -> Column:
    """(start, no, end, kind, value, ahead) of the matches; positions in code points, end exclusive."""
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))
    before = running(F.transform(pairs, size), lambda a, b: a + b, F.lit(0))

    def span(x, at):
        begin = at + F.length(x["gap"])
        return F.when(x["value"].isNotNull(), F.struct(
            begin.alias("start"), F.lit(no).alias("no"), (begin + F.length(x["value"])).alias("end"), F.lit(kind).cast("string").alias("kind"),
            x["value"].alias("value"), last_words(x["gap"]).alias("ahead")))

    return F.filter(F.zip_with(pairs, before, span), lambda s: s.isNotNull()).cast(SPAN)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """Whether a match of a kind's form is one: address parts, check digit, number of digits."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits(value)).between(12, 19), F.call_function("luhn_check", digits(value))).otherwise(False)
    return F.length(digits(value)).between(9, 15) if kind == "phone" else F.lit(True)


def passing(kind: str):
    return lambda span: passes(kind, span["value"])


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def seen(text: Column, kind: str, no: int) -> Column:
    """``spans`` of a kind that pass, and ``masked``: the text in which their digits and at signs are replaced."""
    # Texts without the sign or digit a form needs are not searched.
    needs = F.contains(text, F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else text.rlike("[0-9]")

    def shown(x):
        value = F.coalesce(x["value"], F.lit(""))
        return F.concat(x["gap"], F.when(passes(kind, value), F.translate(value, "0123456789@", _MASK)).otherwise(value))

    def both(pairs):
        return F.struct(F.filter(spans_of(pairs, kind, no), passing(kind)).alias("spans"), F.array_join(F.transform(pairs, shown), "").alias("masked"))

    return F.when(needs, let(pairs_of(text, FORMS[kind]), both)).otherwise(F.struct(F.array().cast(SPAN).alias("spans"), text.alias("masked")))


def open_tokens(text: Column, kinds: list[Column]) -> Column:
    """Identifier-like tokens that no span of ``kinds`` (see ``seen``) touches.

    A token that a span touches shares a digit or an at sign with it, so it differs in the masked text, where it has the same place.
    """
    def tokens(t):
        return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))

    def free(own):
        kept = F.transform(own, lambda s: s["value"].rlike("[0-9@]"))
        for k in kinds:
            same = F.zip_with(own, tokens(k["masked"]), lambda s, m: s["value"] == m)
            kept = F.when(F.size(k["spans"]) > 0, F.zip_with(kept, same, lambda a, b: a & b)).otherwise(kept)
        return F.transform(F.filter(F.arrays_zip(own.alias("s"), kept.alias("free")), lambda x: x["free"]), lambda x: x["s"])

    return F.when(text.rlike("[0-9@]"), let(spans_of(pairs_of(text, TOKEN), None, len(FORMS)), free)).otherwise(F.array().cast(SPAN))


def contexts(ahead: Column) -> Column:
    """The lexical patterns in front of a place: its last word and its last two words, lower-cased; none across a line end."""
    words = F.regexp_extract_all(F.lower(ahead), F.lit(WORD), F.lit(0))
    n = F.size(words)
    return (F.when(n >= 2, F.array(F.element_at(words, -1), F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1))))
            .when(n == 1, F.array(F.element_at(words, -1))).otherwise(F.array().cast("array<string>")))


def evidence(docs: DataFrame, text: str) -> DataFrame:
    """``row`` (the columns of ``docs``), ``row_no``, ``base`` (spans, by start, then kind) and ``open`` (identifier-like tokens outside them), stored."""
    t = F.coalesce(F.col("row")[text], F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).select("row", *[seen(t, kind, no).alias(kind) for no, kind in enumerate(FORMS)])
    kinds = [F.col(kind) for kind in FORMS]
    rows = rows.select("row", F.sort_array(F.concat(*[k["spans"] for k in kinds])).alias("base"), open_tokens(t, kinds).alias("open"))
    return store(rows.withColumn("row_no", F.monotonically_increasing_id()), "pii-evidence")


def trusted_patterns(marked: DataFrame, rounds: int, trust: float, support: int) -> DataFrame:
    """``pattern``, ``kind``, ``confidence`` of the patterns at or above ``trust``.

    Confidence: the trust of a pattern's distinct instances over their number plus one, with at least ``support`` trusted
    ones. Trust of an instance: 1 for a seed of the kind, else 1 - the product of (1 - confidence) over its trusted patterns.
    """
    spans = marked.select(F.explode(F.concat("base", "open")).alias("s"))
    edges = (spans.select(F.explode(contexts(F.col("s.ahead"))).alias("pattern"), F.lower("s.value").alias("instance"), F.col("s.kind").alias("kind"))
             .groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    # Patterns that no seed stands behind can never gain trust.
    per_pattern = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("kind").alias("seeds")).where(F.col("seeds") >= support)
    # Stored first: the join then reads plain exchanges, and a pattern of very many instances can be split.
    per_pattern = store(per_pattern, "pii-counts")
    edges = store(edges.join(per_pattern.select("pattern", "n"), "pattern"), "pii-edges")
    learned = edges.where(F.col("kind").isNotNull()).select("pattern", "n", "instance", "kind", F.lit(1.0).alias("trust"))
    good, last = None, None
    for _ in range(rounds):
        scores = learned.groupBy("pattern", "kind").agg(
            (F.sum("trust") / (F.first("n") + 1)).alias("confidence"), F.count(F.when(F.col("trust") >= trust, 1)).alias("sure"))
        good = store(scores.where((F.col("confidence") >= trust) & (F.col("sure") >= support)).select("pattern", "kind", "confidence"), "pii-patterns")
        now = tuple(good.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "kind"))).first())
        if now == last or not now[0]:  # the set of trusted patterns repeats
            break
        last = now
        others = (edges.where(F.col("kind").isNull()).drop("kind").join(good, "pattern")
                  .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("trust")))
        reached = edges.where(F.col("kind").isNull()).drop("kind").join(others, "instance").select("pattern", "n", "instance", "kind", "trust")
        learned = edges.where(F.col("kind").isNotNull()).select("pattern", "n", "instance", "kind", F.lit(1.0).alias("trust")).unionByName(reached)
    return good


def find(docs: DataFrame, text: str = "text", rounds: int = 3, trust: float = 0.8, support: int = 5) -> DataFrame:
    """``row`` (all columns of ``docs``), ``base`` (spans of the fixed forms) and ``spans`` (these and the discovered ones), by
    start, then kind.

    Null texts count as empty and have no spans; empty tables give empty results; repeated rows are kept and counted as one
    instance each time by value. Whole texts of any length are searched. Further columns travel inside ``row``, whatever their
    names. A discovered token that two kinds claim goes to the more trusted, then to the first listed.
    """
    marked = evidence(docs, text)
    good = trusted_patterns(marked, rounds, trust, support)
    order = reduce(lambda e, kn: e.when(F.col("kind") == kn[1], kn[0]), enumerate(FORMS), F.when(F.lit(False), 0)).cast("int")
    places = (marked.select("row_no", F.explode("open").alias("s")).select("row_no", "s", F.explode(contexts(F.col("s.ahead"))).alias("pattern"))
              .join(good, "pattern").withColumn("no", order)
              .groupBy("row_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
              .agg(F.min_by("kind", F.struct(-F.col("confidence"), "no")).alias("kind"), F.min_by("no", F.struct(-F.col("confidence"), "no")).alias("no")))
    extra = places.groupBy("row_no").agg(F.collect_list(F.struct(
        "start", "no", "end", "kind", "value", F.lit("").alias("ahead"))).alias("extra"))  # bounded by one text
    joined = marked.join(extra, "row_no", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(SPAN))))
    return joined.withColumn("spans", spans).drop("row_no", "open", "extra")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(found_rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``find`` as they came in, with every span of ``text`` replaced by its kind in brackets.

    Spans that overlap are replaced as one, under the kind of the first.
    """
    whole = F.col("row")[text]

    def strips(t):
        return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{STRIP}}}"), F.lit(0))

    def between(x, begin, end):
        """The text from ``begin`` to ``end``, read from the strips it lies in."""
        first = F.floor(begin / STRIP).cast("int")
        part = F.slice(x["strips"], first + 1, F.floor((end - 1) / STRIP).cast("int") - first + 1)
        cut = lambda s, i: F.substring(s, F.greatest(begin - (first + i) * STRIP, F.lit(0)) + 1, end - F.greatest(begin, (first + i) * STRIP))
        return F.when(end > begin, F.array_join(F.transform(part, cut), "")).otherwise("")

    def put(x):
        reach = running(F.transform(x["spans"], lambda s: s["end"]), F.greatest, F.lit(0))
        # A span that begins before an earlier one ends is part of that one.
        heads = F.filter(F.zip_with(x["spans"], reach, lambda s, r: F.struct(s["start"].alias("start"), r.alias("from"), s["kind"].alias("kind"))),
                         lambda h: h["start"] >= h["from"])
        out = F.transform(heads, lambda h: F.concat(between(x, h["from"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        tail = between(x, F.array_max(F.transform(x["spans"], lambda s: s["end"])), x["size"])
        return F.concat(F.array_join(out, ""), tail)

    parts = F.struct(strips(whole).alias("strips"), F.col("spans").alias("spans"), F.length(whole).alias("size"))
    clean = F.when(F.size("spans") == 0, whole).otherwise(let(parts, put))
    names = found_rows.schema["row"].dataType.names
    return found_rows.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in names])
