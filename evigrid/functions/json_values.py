"""JSON values as Variant columns: pointers, type tags, canonical form, digests."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

ARRAY = "array<variant>"
OBJECT = "map<string,variant>"

_TAGS = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null",
         "DOUBLE": "number", "FLOAT": "number", "ARRAY<VOID>": "array", "OBJECT<>": "object"}


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", ARRAY)


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", OBJECT)


def as_text(v: Column) -> Column:
    """Text of a scalar; NULL for containers and JSON null."""
    return F.try_variant_get(v, "$", "string")


def type_tag(v: Column) -> Column:
    """JSON type of a value: missing, null, boolean, integer, number, string, array, object.

    Whole numbers wider than 64 bits come back from Spark as DECIMAL(19+,0); a written
    ``1.0`` is DECIMAL(1,0), so the width tells the two apart.
    """
    kind = F.schema_of_variant(v)
    table = F.create_map(*[F.lit(x) for pair in _TAGS.items() for x in pair])
    # Plain scalars end at the first lookup; the rest is only read for decimals and containers.
    return F.coalesce(
        F.try_element_at(table, kind),
        F.when(kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer").when(kind.startswith("DECIMAL"), "number")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object"), F.lit("missing"))


def container_tag(v: Column) -> Column:
    """Like ``type_tag`` for containers, without walking their content."""
    return F.when(as_array(v).isNotNull(), "array").when(as_object(v).isNotNull(), "object")


# ---------------------------------------------------------------- pointers

def pointer_tokens(pointer: str) -> list[str]:
    """Reference tokens of an RFC 6901 pointer."""
    if pointer == "":
        return []
    if not pointer.startswith("/") or re.search(r"~(?![01])", pointer):
        raise ValueError("invalid_json_pointer")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def _member(v: Column, token: str) -> Column:
    if "'" not in token and '"' not in token and "\\" not in token:
        found = F.try_variant_get(v, f"$['{token}']", "variant")
    else:
        found = F.try_element_at(as_object(v), F.lit(token))
    if re.fullmatch(r"0|[1-9][0-9]*", token):
        found = F.coalesce(F.try_variant_get(v, f"$[{token}]", "variant"), found)
    return found


def pointer_path(pointer: Column, *, indexes: bool = False) -> Column:
    """Variant path of a pointer held in a column."""
    def step(token: Column) -> Column:
        plain = F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        quote = F.when(F.contains(plain, F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
        key = F.concat(F.lit("["), quote, plain, quote, F.lit("]"))
        if not indexes:
            return key
        return F.when(plain.rlike("^(0|[1-9][0-9]{0,8})$"),
                      F.concat(F.lit("["), plain, F.lit("]"))).otherwise(key)

    steps = F.transform(F.split(F.substring(pointer, 2, 100000), "/"), step)
    path = F.when(pointer == "", F.lit("$")).when(
        pointer.startswith("/"), F.concat(F.lit("$"), F.array_join(steps, "")))
    # The index form is needed only where some token can be a position.
    return F.when(pointer.rlike("/(0|[1-9][0-9]*)(/|$)"), path) if indexes else path


def pointer_paths(pointer: Column) -> Column:
    """Both path forms of a pointer column, to be computed once per row and used by ``path_get``."""
    return F.struct(pointer_path(pointer).alias("k"), pointer_path(pointer, indexes=True).alias("i"))


def path_get(v: Column, paths: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, paths["k"], "variant"), F.try_variant_get(v, paths["i"], "variant"))


def pointer_get(v: Column, pointer: str | Column) -> Column:
    """Value at a pointer as Variant; SQL NULL where it does not resolve.

    A JSON null found there stays a Variant null (``is_variant_null``).
    """
    if isinstance(pointer, str):
        for token in pointer_tokens(pointer):
            v = _member(v, token)
        return v
    return path_get(v, pointer_paths(pointer))


def pointer_error(v: Column, pointer: str) -> Column:
    """Error code of a lookup, NULL where the pointer resolves."""
    result = F.lit(None).cast("string")
    checks = []
    for token in pointer_tokens(pointer):
        child = _member(v, token)
        if not re.fullmatch(r"0|[1-9][0-9]*", token):
            checks.append((as_array(v).isNotNull(), "invalid_array_index"))
        checks.append((child.isNull(), "pointer_not_found"))
        v = child
    for condition, code in reversed(checks):
        result = F.when(condition, F.lit(code)).otherwise(result)
    return result


def tagged(values: list[Column]) -> Column:
    """Array of (t, s): type tag and scalar text, each value looked up once."""
    return F.transform(F.array(*values), lambda v: F.struct(type_tag(v).alias("t"), as_text(v).alias("s")))


def field_value(item: Column, pointer: str | Column, *, optional: bool = False) -> tuple[Column, Column]:
    """(value, violation): a missing optional member is NULL without violation."""
    value = pointer_get(item, pointer)
    code = F.lit(None).cast("string") if optional else F.when(value.isNull(), "pointer_not_found")
    return value, code


# ---------------------------------------------------------------- digests

def canonical_json(v: Column) -> Column:
    """Sorted keys, compact, non-ASCII kept. Whole floats print without ``.0``; see ``exact_digest``."""
    return F.to_json(v)


def digest(v: Column) -> Column:
    return F.sha2(canonical_json(v), 256)


def digest_text(text: Column) -> Column:
    """Digest of a JSON string value holding ``text``."""
    return F.sha2(F.to_json(F.to_variant_object(F.struct(text.alias("t")))), 256)


def set_digest(digests: Column) -> Column:
    """Order-free digest of an array of digests."""
    return F.sha2(F.to_json(F.sort_array(F.array_distinct(digests))), 256)


def digest_value(value: object) -> str:
    """Driver-side digest of a small document (plans, policies)."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@F.pandas_udf(T.StringType())
def exact_digest(body: pd.Series) -> pd.Series:
    """Digest of JSON text that keeps ``1.0`` distinct from ``1``."""
    return body.map(lambda text: None if text is None else digest_value(json.loads(text)))
