"""Pointers, type tags, canonical form, redaction and text rules."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from evigrid.operators.overlap import shape_text
from evigrid.functions import json_values as J, texts as X, walks as W


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_pointers_and_errors(spark):
    doc = json.dumps({"a": {"b": [10, None]}, "0": 1, "x/y": {"~": 2}, "it's": 3})
    df = spark.createDataFrame([(doc,)], "j string").select(F.parse_json("j").alias("v"))
    get = lambda p: J.as_text(J.pointer_get(F.col("v"), p))
    assert list(df.select(get("/a/b/0"), get("/0"), get("/x~1y/~0"), get("/it's"), get("/a/b/1"), get("/a/b/2")).first()) == [
        "10", "1", "2", "3", None, None]
    err = lambda p: J.pointer_error(F.col("v"), p)
    assert list(df.select(err("/a/b/0"), err("/a/c"), err("/a/b/01"), err("/a/b/x"), err("/a/b/9"), err("")).first()) == [
        None, "pointer_not_found", "invalid_array_index", "invalid_array_index", "pointer_not_found", None]
    by_column = df.select(*[J.as_text(J.pointer_get(F.col("v"), F.lit(p))) for p in ("/a/b/0", "/0", "/x~1y/~0", "/it's")]).first()
    assert list(by_column) == ["10", "1", "2", "3"]


def test_type_tags(spark):
    values = ["1", "1.0", "1.5", "true", '"x"', "null", "[]", "[1]", "{}", '{"a":1}', "1e5", "123456789012345678901", "-1"]
    tags = column(spark, [(v,) for v in values], "j string", J.type_tag(F.parse_json("j")))
    assert tags == ["integer", "number", "number", "boolean", "string", "null", "array", "array", "object", "object", "number", "integer", "integer"]


def test_digests_match_the_published_values(spark):
    text = '[{"value":"alpha","id":1},{"id":2,"value":"beta"},{"id":3,"value":"gamma"},{"id":4,"value":"delta"}]'
    want = "940d80911aca9d4391f7fe1f471de98e3da52619f75eff44cdc65b6500825d25"
    assert column(spark, [(text,)], "j string", J.digest(F.parse_json("j"))) == [want]
    assert column(spark, [(text,)], "j string", J.exact_digest("j")) == [want]
    assert column(spark, [('{"b":1.0}',)], "j string", J.exact_digest("j")) == [J.digest_value({"b": 1.0})]


def test_shape_and_redaction(spark):
    body = {"id": 7, "price": 1.5, "ok": True, "none": None, "user_token": "x", "rows": [{"name": "a"}, {"other": 1}],
            "deep": {"a": {"a": {"a": {"a": {"a": {"a": 1}}}}}}}
    out = json.loads(column(spark, [(json.dumps(body),)], "j string", W.shape("j"))[0])
    assert out["rows"] == [{"name": "<string>"}] and "user_token" not in out and out["none"] == "<null>"
    assert out["deep"]["a"]["a"]["a"]["a"]["a"] == {"a": "<depth_limit>"}
    wide = json.dumps({f"z{99 - i}": i for i in range(40)})
    assert list(json.loads(column(spark, [(wide,)], "j string", W.shape("j"))[0])) == [f"z{99 - i}" for i in range(40)]
    assert list(json.loads(column(spark, [(wide,)], "j string", W.shape_of(30)("j"))[0])) == [f"z{99 - i}" for i in range(30)]
    assert column(spark, [("{broken",), (None,), ("7",)], "j string", W.shape("j")) == [None, None, '"<integer>"']
    post = json.loads(column(spark, [('{"page":2,"size":"50","big":1000,"q":"abc","f":{"n":3}}',)], "j string", W.request_shape("j"))[0])
    assert post == {"page": 2, "size": "50", "big": "<integer>", "q": "<string>", "f": {"n": "<integer>"}}
    query = F.create_map(*[F.lit(x) for x in ("page", "12", "q", "shoes", "n", "1234", "api_key", "1")])
    assert spark.range(1).select(W.redact_query(query)).first()[0] == {"page": "12", "q": "<value>", "n": "<value>"}


def test_sensitive_keys_fail_closed_below_the_scan(spark):
    deep = lambda n: "".join('{"a":' for _ in range(n)) + "1" + "}" * n
    values = ['{"a":1}', '{"a":[{"Phone_no":1}]}', '{"API-key":1}', deep(6), deep(7), "[]"]
    assert column(spark, [(v,) for v in values], "j string", W.sensitive_keys(F.parse_json("j"))) == [False, True, True, False, True, False]


def test_members_and_subtrees(spark):
    doc = '{"rows":[{"id":1,"secret_x":2},{"id":2}],"meta":{"n":{"k":[]}}}'
    members = column(spark, [(doc,)], "j string", W.structure_members(F.parse_json("j")))[0]
    assert sorted((m.path, m.type) for m in members) == [
        ("/meta", "object"), ("/meta/n", "object"), ("/meta/n/k", "array"), ("/rows", "array"), ("/rows/id", "integer"), ("/rows/id", "integer")]
    trees = column(spark, [(doc,)], "j string", W.nested_subtrees(F.array(F.parse_json("j"))))[0]
    parts = [[{"id": 1, "secret_x": 2}, {"id": 2}], {"id": 1, "secret_x": 2}, {"id": 2}, {"n": {"k": []}}, {"k": []}]
    assert trees == sorted(J.digest_value(p) for p in parts)


def test_no_depth_is_lost(spark):
    value = {"oracle": ["}\"{", 1]}
    for _ in range(50):
        value = {"a": [value]}
    parts, todo = set(), list(value.values())
    while todo:
        part = todo.pop()
        if isinstance(part, (dict, list)) and part:
            parts.add(J.digest_value(part))
            todo += part.values() if isinstance(part, dict) else part
    doc = F.parse_json("j")
    assert column(spark, [(json.dumps(value),)], "j string", W.nested_subtrees(F.array(doc)))[0] == sorted(parts)
    assert column(spark, [(json.dumps(value),)], "j string", W.has_member(doc, ["oracle", "x"])) == [True]
    assert column(spark, [('{"a":["oracle","\\"oracle\\":"]}',)], "j string", W.has_member(doc, ["oracle"])) == [False]
    assert column(spark, [(json.dumps(value),)], "j string", shape_text(doc)) == [None]


def test_structure_digests(spark):
    """At any depth; up to ten levels two values have equal digests where their quoted shapes are equal."""
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return rng.choice([1, 1.0, 2.5, "s", 'q"]{', True, None, 10**25])
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice(["a", "b", "c:d", "secret", "e\"f"]): value(depth - 1) for _ in range(rng.randrange(3))}

    rows = [(json.dumps([value(6), {"k": value(6)}]),) for _ in range(400)]
    doc = F.parse_json("j")
    shapes = column(spark, rows, "j string", shape_text(doc))
    digests = [d[0] for d in column(spark, rows, "j string", W.structures(F.array(doc)))]
    assert None not in digests
    assert (len(set(shapes)), len(set(digests))) == (len(set(zip(shapes, digests, strict=True))),) * 2 and len(set(shapes)) > 50

    def deep(n, last):
        for k in range(n):
            last = {"a": [last], "b": 1} if k % 2 else [last, "x", last]
        return last

    def plain(v):
        if isinstance(v, (list, dict)):
            parts = {plain(c) for c in v} if isinstance(v, list) else {plain(c) for k, c in v.items() if k != "token"}
            text = f"{'array' if isinstance(v, list) else 'object'}[{','.join(sorted(parts))}]"
        else:
            text = {bool: "bool", int: "int", str: "str", float: "float", type(None): "NoneType"}[type(v)]
        return hashlib.sha256(text.encode()).hexdigest()

    values = [deep(17, 1), deep(17, "1"), deep(17, {"token": {"k": [1]}, "n": None}), deep(17, {"n": None}), {"a": [{"x": 7}]}, {"z": [{"y": 9}, {"y": 8}]}]
    got = [d[0] for d in column(spark, [(json.dumps(v),) for v in values], "j string", W.structures(F.array(doc)))]
    assert got == [plain(v) for v in values] and got[2] == got[3] and got[4] == got[5] and len(set(got)) == 4
    chain = lambda last: "[" * 300 + last + "]" * 300
    long = [d[0] for d in column(spark, [(chain("1"),), (chain("2"),), (chain("true"),)], "j string", W.structures(F.array(doc)))]
    assert long[0] == long[1] != long[2]


def test_text_rules(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(X.guard_formula(F.lit('=HYPERLINK("bad")'))) == '\'=HYPERLINK("bad")'
    assert one(X.guard_formula(F.lit("  +1"))) == "'  +1" and one(X.guard_formula(F.lit("a=1"))) == "a=1"
    assert one(X.tokens(F.lit("Page-No 2_x, é"))) == ["page", "no", "2_x"]
    assert one(X.normalize_name(F.lit("Total Count"))) == "totalcount"
    assert one(X.pointer_escape(F.lit("a/b~c"))) == "a~1b~0c"
    numbers = [("12", 12.0, 12), (" +3.50 ", 3.5, None), ("1e5", None, None), ("12.", None, None), ("", None, None), ("-7", -7.0, -7)]
    df = spark.createDataFrame(numbers, "t string, n double, i int")
    assert df.filter(~X.parse_number(F.col("t")).eqNullSafe(F.col("n")) | ~X.parse_integer(F.col("t")).eqNullSafe(F.col("i").cast("bigint"))).count() == 0
    assert one(X.iso_seconds(F.lit("2026-01-01T00:00:00+00:00"), F.lit("2026-01-01T00:00:01.5+00:00"))) == 1.5
    assert one(X.iso_seconds(F.lit("x"), F.lit("2026-01-01T00:00:00+00:00"))) is None
    assert one(X.sanitize_cell(F.lit("a\x00b\tc"))) == "a�b\tc"
