"""URL parts and target admission as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..operators.collect import first_match
from ..plans.specs import TargetPolicy
from .json_values import digest
from .texts import is_sensitive

# Generic URI syntax: scheme, authority, path, query, fragment.
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
#: Characters no link may hold.
REFUSED = r"[\x00-\x20\\]"
_DOMAIN = r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"
_HOST = r"^(?:.*@)?(\[[^\]]*\]|[^:\[\]]*)(?::(.*))?$"


@dataclass(frozen=True)
class Url:
    """Parts of a URL column; absent parts are empty strings."""

    scheme: Column
    authority: Column
    userinfo: Column
    host: Column
    port: Column
    bad_port: Column
    path: Column
    query: Column
    fragment: Column

    @property
    def origin(self) -> Column:
        return F.concat(self.scheme, F.lit("://"), self.authority)


def url_parts(url: Column) -> Url:
    return _url(*[F.regexp_extract(url, _URI, i) for i in range(1, 6)])


def _url(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column, inner: tuple[Column, Column, Column] | None = None) -> Url:
    userinfo, host, port = inner or _inner(authority)
    number = port.try_cast("int")
    bad = (port != "") & (~port.rlike(r"^[0-9]+$") | number.isNull() | (number > 65535))
    return Url(F.lower(scheme), authority, userinfo, host, F.when((port != "") & ~bad, number), bad, path, query, fragment)


def _inner(authority: Column) -> tuple[Column, Column, Column]:
    """(user information, host, text of the port) of an authority."""
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, _HOST, 1), r"^\[|\]$", ""))
    return F.regexp_extract(authority, r"^(.*)@", 1), host, F.regexp_extract(authority, _HOST, 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_parts(url: Column, body: Callable[[Url], Column]) -> Column:
    """``body`` of the parts of a URL, each of which is worked out once."""
    def split(p: Column) -> Column:
        outer = [p[f"p{i}"] for i in range(1, 6)]
        inner = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(_inner(p["p2"]))])
        return let(inner, lambda a: body(_url(*outer, (a["p0"], a["p1"], a["p2"]))))

    return let(F.struct(*[F.regexp_extract(url, _URI, i).alias(f"p{i}") for i in range(1, 6)]), split)


def query_pairs(query: Column) -> Column:
    """Array of (key, value), blank values kept."""
    raw = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(raw, lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("key"),
        F.coalesce(F.try_url_decode(F.get(F.split(p, "=", 2), F.lit(1))), F.lit("")).alias("value")))


def repeated_keys(pairs: Column) -> Column:
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"]))) < F.size(pairs)


def local_origin(url: Column) -> tuple[Column, Column]:
    """(origin, code) where only literal loopback HTTP is a target."""
    u = url_parts(url)
    code = _local_code(u)
    return F.when(code.isNull(), u.origin), code


def _local_code(u: Url) -> Column:
    return first_match(((u.scheme != "http") | ~u.host.isin("127.0.0.1", "::1")
                        | ~u.userinfo.isin("", ":") | (u.fragment != "") | u.bad_port,
                        "only_literal_loopback_http_supported"))


def check_target(url: Column, policy: TargetPolicy | None = None) -> tuple[Column, Column]:
    """(canonical origin, rejection code): exactly one of the two is set."""
    policy = policy or TargetPolicy()
    if policy.mode == "loopback":
        return local_origin(url)
    u = url_parts(url)
    code = _target_code(u, policy)
    return F.when(code.isNull(), F.concat(u.scheme, F.lit("://"), u.host)), code


def _target_code(u: Url, policy: TargetPolicy) -> Column:
    listed = F.lit(False)
    for domain, subdomains in policy.allowlist:
        listed = listed | (u.host == domain)
        if subdomains:
            listed = listed | u.host.endswith("." + domain)
    usual = F.when(u.scheme == "https", 443).when(u.scheme == "http", 80)
    return first_match(
        (u.bad_port | ~u.userinfo.isin("", ":") | (u.fragment != "") | (u.host == ""), "invalid_url"),
        (~u.scheme.isin(*policy.schemes), "public_scheme_not_allowed"),
        (u.port.isNotNull() & (u.port != usual), "unsupported_port"),
        ((u.query != "") & F.lit(not policy.entry_url_query_allowed), "entry_url_query_not_supported"),
        (~u.host.rlike(_DOMAIN) | ~listed, "target_not_in_allowlist"))


def checked_url(url: Column, policy: TargetPolicy | None = None) -> Column:
    """Rejection code of a URL that may carry a query, NULL where it is fine."""
    local = policy is None or policy.mode == "loopback"

    def code(u: Url) -> Column:
        target = _local_code(u) if local else F.when(~u.userinfo.isin("", ":") | (u.fragment != ""), "invalid_url").otherwise(
            _with_parts(u.origin, lambda o: _target_code(o, policy)))
        refused = let(query_pairs(u.query), lambda pairs: repeated_keys(pairs) | F.exists(pairs, lambda p: is_sensitive(p["key"])))
        rest = first_match((url.rlike(REFUSED), "invalid_url"), ((u.query != "") & refused, "unsupported_query"))
        return F.coalesce(target, rest)

    return _with_parts(url, code)


def policy_hash(allowlist: Column, schemes: Column, mode: Column, target_kind: Column, entry_query: Column) -> Column:
    """Content address of a policy row, the same as ``TargetPolicy.content_hash``."""
    document = F.struct(F.lit(1).alias("schema_version"), mode.alias("mode"), target_kind.alias("target_kind"),
                        allowlist.alias("allowlist"), schemes.alias("schemes"), entry_query.alias("entry_url_query_allowed"))
    return digest(F.parse_json(F.to_json(document)))


_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _without_dots(path: Column) -> Column:
    """Path with its dot segments resolved; steps above the root are dropped."""
    none = F.array().cast("array<string>")

    def joined(parts: Column) -> Column:
        kept = F.aggregate(parts, none, lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
                           .when(p == ".", out).otherwise(F.concat(out, F.array(p))))
        # A path that ends in a dot segment names a folder.
        return F.array_join(F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/")

    return let(let(F.split(path, "/", -1), joined), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def join_url(base: Column | str, href: Column | str) -> Column:
    """Reference resolution (RFC 3986) of ``href`` against an absolute ``base``; NULL where either is missing."""
    base, href = (F.col(c) if isinstance(c, str) else c for c in (base, href))
    part = lambda url, i: F.regexp_extract(url, _REFERENCE, i)
    tail = lambda mark, text: F.when(text != "", F.concat(F.lit(mark), text)).otherwise("")

    def resolved(p: Column) -> Column:
        b, r = (lambda i: p[f"b{i}"]), (lambda i: p[f"r{i}"])
        folder = F.concat(F.regexp_extract(b(3), r"(?s)^(.*/)[^/]*$", 1), r(3))
        path = F.when(r(3) == "", b(3)).otherwise(_without_dots(let(F.when(r(3).startswith("/"), r(3)).otherwise(folder), lambda f: F.when(
            f.startswith("/"), f).otherwise(F.concat(F.lit("/"), f)))))
        query = F.when((r(3) == "") & (r(4) == ""), b(4)).otherwise(r(4))
        inside = F.concat(b(1), F.lit("://"), b(2), path, let(query, lambda q: tail("?", q)), tail("#", r(5)))
        other = F.concat(b(1), F.lit("://"), r(2), r(3), tail("?", r(4)), tail("#", r(5)))
        return F.when((r(1) != "") & (F.lower(r(1)) != F.lower(b(1))), href).when(r(2) != "", other).otherwise(inside)

    parts = F.struct(*[part(base, i).alias(f"b{i}") for i in (1, 2, 3, 4)], *[part(href, i).alias(f"r{i}") for i in (1, 2, 3, 4, 5)])
    # Most references are a path from the root without anything to resolve.
    plain = href.startswith("/") & ~href.startswith("//") & ~href.contains("/.") & ~href.contains("?") & ~href.contains("#")
    return F.when(href == "", base).when(plain, F.concat(part(base, 1), F.lit("://"), part(base, 2), href)).otherwise(let(parts, resolved))
