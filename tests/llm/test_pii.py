"""Personal data: fixed forms against plain regular expressions, discovery through contexts, redaction."""

import random
import re

from pyspark.sql import functions as F

from evigrid.llm import pii as P

from .odd import ODD, docs

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for no, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if not ((kind == "ip" and any(int(p) > 255 for p in m.group().split("."))) or (kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)))
                    or (kind == "phone" and not 9 <= len(digits) <= 15)):
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(o[2] for o in sorted(out))


def spans(spark, rows, **options):
    found = P.find(docs(spark, rows), **options)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), P.listed(F.col("base")).alias("base"), P.listed(F.col("spans")).alias("spans"))


def test_forms_against_plain_expressions(spark):
    rng = random.Random(1)
    bits = ["a", "b.c", "@", "x@y.de", ".", "-", " ", "+", "1", "22", "333", "4444", "0", "255", "256", "10.0.0.1", "+1 (017) 555-7713", "4111111111111111", "(", ")",
            "é", "\n", "\U0001f600", "_", "%", "0000000000000000", "79927398713", "..", "@@"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))) for i in range(600)]
    rows += [(1000, "a@b.c+d@e.f.g a@b.c.d@e.f"), (1001, "1.2.3.4.5.6.7.8 00000255.1.1.1 1.2.3.999"), (1002, "9" * 5_000 + " " + "x" * 50_000 + "@"),
             (1003, "4111 1111 1111 1111-4111"), (1004, "+12345678 +123456789 +1234567890123456"), (1005, ("mail x1@y.org " * 300))]
    out = spans(spark, rows).collect()
    assert len(out) == len(rows) and all(r.base == plain(r.text) for r in out)


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(5))
    rows = [(i, f"{word()} {word()}\nkontakt via {word()}{i}@mail.example.org {word()}") for i in range(30)]
    rows += [(100 + i, f"{word()} rate of {i}% and room {i}b {word()}") for i in range(30)]
    rows += [(200, "please kontakt via jane7(at)mail"), (201, "room 7c is free"), (202, "via 9z")]
    out = {r.doc_id: r for r in spans(spark, rows).collect()}
    text = rows[60][1]
    at = text.index("jane7")
    assert out[200].base == "" and out[200].spans == f"email:{at}:{len(text)}"
    assert out[201].spans == "" and all(out[i].spans == out[i].base != "" for i in range(30))
    assert out[202].spans == "email:4:6"  # "via" alone is as sure as the two words
    assert {r.spans for r in spans(spark, rows, support=1000).collect() if r.doc_id >= 200} == {""}


def test_redaction(spark):
    rows = [(1, "é a@b.co, +1 (017) 555-7713, 4111111111111111 x"), (2, "nothing"), (3, None), (4, "10.0.0.1"), (5, "+4111111111111111")]
    df = docs(spark, rows)
    clean = P.redact(P.find(df))
    out = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == df.columns
    assert out == {1: "é [EMAIL], [PHONE], [CARD] x", 2: "nothing", 3: None, 4: "[IP]", 5: out[5]}
    assert not any(c.isdigit() for c in out[5])


def test_odd_documents(spark):
    out = spans(spark, ODD).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(ODD, key=repr)
    assert all(r.base == r.spans == plain(r.text or "") for r in out)
    assert spans(spark, [(1, "x")]).where("false").count() == 0 and P.find(docs(spark, ODD).limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = P.find(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_running_values(spark):
    rng = random.Random(3)
    rows = [(n, [rng.randrange(100) for _ in range(n)]) for n in (0, 1, 2, 63, 64, 65, 128, 4095, 4096, 4097, 9000)]
    df = spark.createDataFrame(rows, "n int, v array<int>")
    got = {r.n: r for r in df.select("n", P.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), P.running(F.col("v"), F.greatest, F.lit(-1)).alias("m")).collect()}
    for n, v in rows:
        assert got[n].s == [sum(v[:i]) for i in range(n)] and got[n].m == [max(v[:i], default=-1) for i in range(n)]


def test_numbers_in_groups(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(5))
    rows = [(i, f"{word()}\nreach phone: +1 555 {1000000 + i} {word()}") for i in range(30)]
    rows += [(100, "reach phone: (555) 123 4567 then"), (101, "phone: 555 12 x9"), (102, f"reach {'w' * 200} phone: (555) 123 4567\n12")]
    out = {r.doc_id: r for r in spans(spark, rows).collect()}
    assert out[100].spans == "phone:13:27" and out[101].spans == "phone:7:13" and out[102].spans == "phone:214:228"
    clean = {r.doc_id: r.text for r in P.redact(P.find(docs(spark, rows))).collect()}
    assert clean[100] == "reach phone: [PHONE] then" and clean[101] == "phone: [PHONE] x9"


def plain_redacted(text, found):
    """Spans replaced by their kind, overlapping ones as one."""
    out, at = "", 0
    for kind, start, end in found:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_redaction_against_plain_loop(spark):
    rng = random.Random(5)
    bits = ["wort ", "é", "\U0001f600 ", "x1@y.de ", "10.0.0.1", "+1 (017) 555-7713 ", "4111 1111 1111 1111 ", "\n", " " * 700, "z" * 1500]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    found = P.find(docs(spark, rows))
    listed = {r.doc_id: r.s for r in found.select(F.col("row.doc_id").alias("doc_id"), P.listed(F.col("spans")).alias("s")).collect()}
    clean = {r.doc_id: r.text for r in P.redact(found).collect()}
    for i, text in rows:
        got = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in listed[i].split(",") if s)]
        assert clean[i] == plain_redacted(text, got)


def test_very_long_text(spark):
    """Five megabytes of tokens with a digit, addresses among them: every step is linear in one text."""
    import time

    text = " ".join(f"k{i}" if i % 10 else f"u{i}@mail.example.org" for i in range(600_000))
    assert len(text) > 5_000_000
    rows = docs(spark, [(1, text)])
    begin = time.monotonic()
    found = P.find(rows)
    clean = P.redact(found).first().text
    assert clean == " ".join(f"k{i}" if i % 10 else "[EMAIL]" for i in range(600_000))
    assert time.monotonic() - begin < 120
