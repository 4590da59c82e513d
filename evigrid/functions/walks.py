"""Walks over JSON values: nested higher-order expressions where the depth is a rule, scans of canonical text where it is not.

A walk is a single projection: no explode, no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .json_values import as_array, as_object, as_text, canonical_json, container_tag, type_tag
from .texts import SENSITIVE, is_sensitive

MAX_DEPTH = 6
_SENSITIVE_NAME = re.compile(SENSITIVE)
MEMBER = "struct<path:string,key:string,type:string,text:string,depth:int>"


def _children(v: Column) -> Column:
    return F.coalesce(as_array(v), F.map_values(as_object(v)))


def sensitive_keys(v: Column, depth: int = 0) -> Column:
    """True where any member name is sensitive, or the value goes deeper than was scanned."""
    if depth > MAX_DEPTH:
        return F.lit(True)
    names = F.exists(F.map_keys(as_object(v)), is_sensitive)
    below = F.exists(_children(v), lambda c: sensitive_keys(c, depth + 1))
    return F.coalesce(names, F.lit(False)) | F.coalesce(below, F.lit(False))


def has_member(v: Column, names: list[str]) -> Column:
    """True where a member at any depth carries one of ``names``.

    In canonical JSON text a name is the only quoted text with a colon behind it, and quotes inside strings are escaped.
    """
    either = "|".join(re.escape(json.dumps(n, ensure_ascii=False)) for n in names)
    return F.coalesce(canonical_json(v).rlike(f"(?:{either}):"), F.lit(False))


def _entries(v: Column) -> Column:
    """Children as (key, value); list elements have no key. One lambda variable per child
    keeps the walk linear in its depth."""
    none = F.lit(None).cast("string")
    return F.coalesce(F.map_entries(as_object(v)), F.transform(
        as_array(v), lambda x: F.struct(none.alias("key"), x.alias("value"))))


def structure_members(v: Column, levels: int = MAX_DEPTH + 1) -> Column:
    """Array of (path, key, type, text, depth) for every object member; sensitive names are left out.

    List positions add no path step, so the members of all elements share a path.
    """
    empty = F.array().cast(f"array<{MEMBER}>")

    def walk(node: Column, path: Column, depth: int) -> Column:
        if depth > levels:
            return empty

        def visit(child: Column) -> Column:
            key, value = child["key"], child["value"]
            below = F.concat(path, F.coalesce(F.concat(F.lit("/"), key), F.lit("")))
            own = F.struct(below.alias("path"), key.alias("key"), type_tag(value).alias("type"),
                           as_text(value).alias("text"), F.lit(depth).alias("depth"))
            return F.concat(F.when(key.isNull(), empty).otherwise(F.array(own)), walk(value, below, depth + 1))

        shown = F.filter(_entries(node), lambda c: c["key"].isNull() | ~is_sensitive(c["key"]))
        return F.coalesce(F.flatten(F.transform(shown, visit)), empty)

    return walk(v, F.lit(""), 0)


_MARK = re.compile(r'"(?:[^"\\]++|\\.)*+"|[\[\]{}]', re.S)


def _containers(text: str) -> Iterator[str]:
    """Non-empty containers inside a canonical JSON text, at any depth, the whole text left out."""
    open_: list[int] = []
    for m in _MARK.finditer(text):
        mark = text[m.start()]
        if mark in "[{":
            open_.append(m.start())
        elif mark != '"':
            start = open_.pop()
            if open_ and m.end() - start > 2:
                yield text[start:m.end()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _subtree_digests(texts: pd.Series) -> pd.Series:
    # Parts of a canonical text are the canonical texts of the parts, so no value is decoded.
    digests = lambda one: {hashlib.sha256(c.encode()).hexdigest() for t in one if t is not None for c in _containers(t)}
    return texts.map(lambda one: None if one is None else sorted(digests(one)))


def nested_subtrees(bodies: Column) -> Column:
    """Digests of every non-empty nested container of an array of values, at any depth (the values themselves are left out)."""
    return _subtree_digests(F.transform(bodies, canonical_json))


# Names of JSON's scalar types inside signatures (fixed values).
SCALAR_KINDS = {"null": "NoneType", "boolean": "bool", "integer": "int", "number": "float", "string": "str", "missing": "NoneType"}
KINDS = frozenset(SCALAR_KINDS.values())
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[\[\]{}<>,:]|[^\s\[\]{}<>,:"]++', re.S)


def _leaf(token: str) -> str:
    """Type name of a scalar token: one that is a type name already, or JSON."""
    if token in KINDS:
        return token
    return {'"': "str", "t": "bool", "f": "bool", "n": "NoneType"}.get(token[0]) or ("float" if set(token) & set(".eE") else "int")


def _structure(kind: str, parts: set[str] | None = None) -> str:
    text = kind if parts is None else f"{kind}[{','.join(sorted(parts))}]"
    return hashlib.sha256(text.encode()).hexdigest()


def structure_digest(text: str) -> str:
    """Digest of the name-free structure of a JSON text, in which a scalar may also be a type name and ``<...>`` an object without names.

    A scalar has the digest of its type; a container that of its kind and of the sorted distinct digests of its parts. Containers
    are closed from the innermost outwards over a stack, so depth has no limit and equal subtrees count once. Members with a
    sensitive name are left out.
    """
    frames: list[list] = [["text", set(), False, False]]  # kind, digests of parts, a name comes next, the part is left out
    for m in _TOKEN.finditer(text):
        token, frame = m.group(), frames[-1]
        if token == ":":
            continue
        if token == ",":
            frame[2:] = [frame[0] == "object", False]
        elif token in "[{<":
            frames.append(["array" if token == "[" else "object" if token == "{" else "members", set(), token == "{", False])
        elif token not in "]}>" and frame[2]:
            frame[2:] = [False, _SENSITIVE_NAME.search(json.loads(token)) is not None]
        else:
            if token in "]}>":
                kind, parts, *_ = frames.pop()
                digest = _structure("array" if kind == "array" else "object", parts)
            else:
                digest = _structure(_leaf(token))
            if not frames[-1][3]:
                frames[-1][1].add(digest)
    return frames[0][1].pop()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _structure_digests(texts: pd.Series, heads: pd.Series, tails: pd.Series) -> pd.Series:
    def one(row):
        return None if any(x is None for x in row) else [None if None in x else f"{x[1]}{structure_digest(x[0])}{x[2]}" for x in zip(*row, strict=True)]
    return pd.Series(map(one, zip(texts, heads, tails, strict=True)), dtype=object)


def typed_text(v: Column, levels: int = 10) -> Column:
    """Text of a value with the type names of its scalars in their place, objects as ``<...>`` without names and sensitive members;
    what lies deeper than ``levels`` is plain JSON, in which a whole float is an integer."""
    if levels == 0:
        return F.to_json(v)
    shown = F.map_values(F.map_filter(as_object(v), lambda k, c: ~is_sensitive(k)))
    container = container_tag(v)
    # One recursion per level: the expression stays as long as the levels are many.
    inner = F.array_join(F.transform(F.coalesce(as_array(v), shown), lambda c: typed_text(c, levels - 1)), ",")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in SCALAR_KINDS.items() for x in p]), type_tag(v))
    first, last = (F.when(container == "object", o).otherwise(a) for o, a in ("<[", ">]"))
    return F.when(container.isNotNull(), F.concat(first, inner, last)).otherwise(kind)


def structures(values: Column, heads: Column | None = None, tails: Column | None = None) -> Column:
    """Structure digests of an array of values, at any depth (see ``structure_digest``), each between its head and its tail."""
    none = F.transform(values, lambda v: F.lit(""))
    return _structure_digests(F.transform(values, lambda v: typed_text(v)), none if heads is None else heads, none if tails is None else tails)


# Placeholders a redacted structure shows instead of values (fixed values).
PLACEHOLDER = {"NoneType": "<null>", "bool": "<boolean>", "int": "<integer>", "float": "<number>", "str": "<string>"}


def _redact(node, depth, visible=False, members=None):
    """Structure of a decoded JSON value without its values; see ``shape``."""
    if depth > MAX_DEPTH:
        return "<depth_limit>"
    if isinstance(node, list):
        return [_redact(node[0], depth + 1, False, members)] if node else []
    if not isinstance(node, dict):
        return PLACEHOLDER[type(node).__name__]
    out = {}
    for name in list(node)[:members]:
        if _SENSITIVE_NAME.search(name):
            continue
        item = node[name]
        small = visible and ((type(item) is int and 0 < item <= 999)
                             or (isinstance(item, str) and item.isdecimal() and len(item) <= 3))
        out[name] = item if small else _redact(item, 0 if visible else depth + 1, False, members)
    return out


def _redacted(text, visible, members=None):
    try:
        return json.dumps(_redact(json.loads(text), 0, visible, members), ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return None  # no text, or not JSON


def shape_of(members: int | None = None):
    """A function of a JSON text column that gives its value-free structure as JSON text, in written order; NULL where a text is
    not JSON. With ``members`` only so many members of each object are shown."""
    return F.pandas_udf(lambda body: body.map(lambda t: _redacted(t, False, members)), T.StringType())


@F.pandas_udf(T.StringType())
def shape(body: pd.Series) -> pd.Series:
    """Value-free structure of JSON text, as JSON text with all members; NULL where it is not JSON."""
    return body.map(lambda t: _redacted(t, False))


@F.pandas_udf(T.StringType())
def request_shape(body: pd.Series) -> pd.Series:
    """Like ``shape``, but small page-like numbers of a request body stay visible."""
    return body.map(lambda t: _redacted(t, True))


def redact_query(query: Column) -> Column:
    """Query map without sensitive names; only decimals of up to three digits stay readable."""
    kept = F.map_filter(query, lambda k, v: ~is_sensitive(k))
    return F.transform_values(kept, lambda k, v: F.when(v.rlike(r"(?U)^\d{1,3}$"), v).otherwise("<value>"))
