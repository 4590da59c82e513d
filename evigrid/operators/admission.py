"""Which requests, intents, addresses and paths may be used."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.json_values import as_object
from ..functions.texts import is_sensitive
from ..functions.urls import query_pairs, repeated_keys, url_parts
from ..functions.walks import sensitive_keys
from .collect import first_match
from .windows import sequence_numbers

# Intent rules in order of precedence (rule, class, reason, phrases).
INTENT_RULES = (
    ("circumvention", "RESTRICTED", "circumvention_not_allowed", (
        "破解", "绕过", "验证码", "突破限制", "cookie盗取", "cookie窃取", "窃取cookie",
        "bypass", "crack", "captcha", "circumvent", "anti-bot", "steal cookie")),
    ("personal_identity", "SENSITIVE", "possible_personal_data_collection", (
        "手机号", "电话号码", "身份证", "银行卡", "私人地址", "家庭住址", "个人信息", "个人身份",
        "phone number", "id card", "identity card", "bank card", "social security",
        "personal address", "home address", "personal information")),
    ("privacy", "SENSITIVE", "privacy_data_collection", (
        "用户列表", "私人账号", "个人隐私", "隐私数据", "聊天记录", "通讯录",
        "user list", "private account", "personal data", "private data",
        "chat history", "contact list")),
)
PURPOSES = ("research", "analysis", "monitoring", "archiving", "other")

# IPv4 ranges that are never a public target.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
# IPv6 ranges that may embed an IPv4 address.
BLOCKED_V6 = ("2001::/32", "2002::/16")


def classify_intent(text: Column) -> Column:
    """Struct (classification, allowed, code, reason, rule); the matched phrase never shows."""
    low = F.lower(text)
    none = F.lit(None).cast("string")
    rule, kind, reason = none, F.lit("PUBLIC"), none
    for name, cls, why, phrases in reversed(INTENT_RULES):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(low, F.lit(phrase))
        rule = F.when(hit, F.lit(name)).otherwise(rule)
        kind = F.when(hit, F.lit(cls)).otherwise(kind)
        reason = F.when(hit, F.lit(why)).otherwise(reason)
    return F.struct(kind.alias("classification"), (kind == "PUBLIC").alias("allowed"),
                    F.when(kind != "PUBLIC", F.lit("data_policy_restricted")).alias("code"),
                    reason.alias("reason"), rule.alias("rule"))


def decide(classification: Column, authorized: Column) -> Column:
    """Struct (allowed, reason) of a data class."""
    allowed = (classification == "PUBLIC") | ((classification == "AUTHORIZED") & authorized)
    reason = (F.when(classification == "AUTHORIZED", "authorization_required")
              .when(classification == "SENSITIVE", "possible_personal_data_collection")
              .otherwise("restricted_data_not_supported"))
    return F.struct(allowed.alias("allowed"), F.when(~allowed, reason).alias("reason"))


# ---------------------------------------------------------------- request log

def admit_observations(log: DataFrame, *, per_session: int | None = None, body_limit: int | None = None,
                       chunk: Column | None = None) -> DataFrame:
    """Usable evidence among captured responses: every row comes back, refused ones with a ``reason``.

    ``log``: session, seq, method, resource_type, status, content_type, url, request_headers map, post_data, body, and optionally ``origin``, the
    only one a session may talk to. With ``per_session`` only the first responses of a session are looked at (the rest is
    ``not_observed``), with ``body_limit`` longer bodies are refused. ``chunk`` grows with ``seq`` and cuts a long session into pieces for numbering.
    """
    u = url_parts(F.col("url"))
    pairs = query_pairs(u.query)
    short = lambda c: F.octet_length(c) <= body_limit if body_limit is not None else F.lit(True)
    sent = F.when(short("post_data"), F.try_parse_json("post_data"))
    sent_type = F.lower(F.trim(F.substring_index(
        F.get(F.map_values(F.map_filter("request_headers", lambda k, v: F.lower(k) == "content-type")), F.lit(0)), ";", 1)))
    post_ok = ((sent_type == "application/json") & (F.size(F.map_keys(as_object(sent))) > 0) & ~sensitive_keys(sent))
    body = F.when(short("body"), F.try_parse_json("body"))
    place = F.concat(u.scheme, F.lit("://"), u.authority)
    foreign = ~F.coalesce(place == F.col("origin"), F.lit(False)) if "origin" in log.columns else F.lit(False)
    late = F.lit(False)
    if per_session is not None:
        log = log.withColumn("_rank", F.row_number().over(Window.partitionBy("session").orderBy("seq")))
        late = F.col("_rank") > per_session
    reason = first_match(
        (late, "not_observed"), (foreign, "origin"),
        (~F.col("method").isin("GET", "POST"), "method"),
        (~F.col("resource_type").isin("fetch", "xhr"), "resource_type"),
        (~F.col("status").between(200, 299), "status"),
        (~F.contains(F.coalesce("content_type", F.lit("")), F.lit("json")), "content_type"),
        (repeated_keys(pairs) | F.exists(pairs, lambda p: is_sensitive(p["key"])), "query"),
        (F.exists(F.map_keys("request_headers"), is_sensitive), "headers"),
        ((F.col("method") == "POST") & ~F.coalesce(post_ok, F.lit(False)), "request_body"),
        (~short("body"), "response_too_large"),
        (body.isNull() | ~F.substring(F.ltrim("body"), 1, 1).isin("{", "["), "body"))
    judged = (log.withColumn("reason", reason).drop("_rank").withColumn("clean_url", F.concat(place, u.path))
              .withColumn("query", F.map_from_entries(pairs_once(pairs))))
    numbered = sequence_numbers(judged.filter("reason IS NULL"), ["session"], ["seq"], F.lit(0) if chunk is None else chunk, "_number")
    return numbered.withColumn("request_id", F.format_string("req_%03d", "_number")).drop("_number").unionByName(
        judged.filter("reason IS NOT NULL").withColumn("request_id", F.lit(None).cast("string")))


def pairs_once(pairs: Column) -> Column:
    """Pairs as map entries; a repeated key keeps its first value (such rows are refused anyway)."""
    return F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)


def observation_error(method: Column, request_body: Column) -> Column:
    """POST carries a non-empty JSON object, GET carries none."""
    return first_match(
        ((method == "POST") & ~F.coalesce(F.size(F.map_keys(as_object(request_body))) > 0, F.lit(False)),
         "post_requires_json_object_body"),
        ((method != "POST") & request_body.isNotNull(), "get_must_not_carry_request_body"))


# ---------------------------------------------------------------- addresses

def ipv4_number(text: Column) -> Column:
    """Numeric value of a dotted address, NULL where it is not one."""
    octet = r"(?:0|[1-9][0-9]{0,2})"
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    good = text.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    return F.when(good & ~F.exists(parts, lambda p: p > 255), value)


def blocked_v4(number: Column) -> Column:
    hit = F.lit(False)
    for cidr in BLOCKED_V4:
        net = ipaddress.ip_network(cidr)
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return hit


@F.pandas_udf(T.BooleanType())
def _blocked_v6(values: pd.Series) -> pd.Series:
    nets = [ipaddress.ip_network(c) for c in BLOCKED_V6]

    def blocked(text):
        try:
            ip = ipaddress.IPv6Address(text)
        except ValueError:
            return True
        # A mapped IPv4 address is shown to the IPv4 rules by the caller.
        return (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast
                or ip.is_unspecified or any(ip in n for n in nets))
    return values.map(lambda t: None if t is None else blocked(t))


@F.pandas_udf(T.LongType())
def _mapped_v4(values: pd.Series) -> pd.Series:
    def inner(text):
        try:
            ip = ipaddress.IPv6Address(text).ipv4_mapped
        except (ValueError, TypeError):
            return None
        return None if ip is None else int(ip)
    return values.map(inner).astype("Int64")


def ip_blocked(text: Column, *, ipv6: bool = True) -> Column:
    """True for private, reserved, multicast and unreadable addresses.

    ``ipv6=False`` skips the Python step where a table holds dotted addresses only.
    """
    bare = F.substring_index(text, "%", 1)
    number = ipv4_number(bare)
    if not ipv6:
        return F.when(number.isNull(), True).otherwise(blocked_v4(number))
    wide = F.when(F.contains(bare, F.lit(":")), bare)
    mapped = _mapped_v4(wide)
    return (F.when(number.isNotNull(), blocked_v4(number)).when(mapped.isNotNull(), blocked_v4(mapped))
            .when(wide.isNotNull(), _blocked_v6(wide)).otherwise(True))


def admit_hosts(resolved: DataFrame, *, ipv6: bool = True) -> DataFrame:
    """One row per host of (host, ip): refused unless every address is safe.

    A host without any address is a row with a NULL ip.
    """
    judged = resolved.withColumn("blocked", F.when(F.col("ip").isNotNull(), ip_blocked(F.col("ip"), ipv6=ipv6)))
    return judged.groupBy("host").agg(F.count("ip").alias("n_addresses"), F.bool_or("blocked").alias("b")).select(
        "host", "n_addresses", F.when(F.col("n_addresses") == 0, "target_resolution_failed").when(
            F.col("b"), "ssrf_ip_blocked").alias("code"))


# ---------------------------------------------------------------- robots

def robots_rules(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(origin, fetched, groups) of (origin, text, fetched): one row per origin.

    ``groups`` is an ordered array of (agents, rules) with rules in file order; every window below is bounded by one file.
    With a ``limit`` longer files count as not fetched.
    """
    ok = F.col("fetched") & F.col("text").isNotNull()
    if limit is not None:
        ok = ok & (F.octet_length("text") <= limit)
    files = files.withColumn("fetched", F.coalesce(ok, F.lit(False)))
    lines = files.select("origin", "fetched", F.posexplode_outer(
        F.when(F.col("fetched"), F.split("text", r"\r\n|\r|\n"))).alias("seq", "raw"))
    name = F.lower(F.trim(F.substring_index(F.col("line"), ":", 1)))
    value = F.try_url_decode(F.replace(F.trim(F.get(F.split("line", ":", 2), F.lit(1))), F.lit("+"), F.lit("%2B")))
    lines = (lines.withColumn("line", F.trim(F.substring_index("raw", "#", 1)))
             .withColumn("value", value)
             .withColumn("kind", F.when(F.col("raw") == "", "blank").when(F.col("value").isNull(), None)
                         .when(name == "user-agent", "agent").when(name.isin("allow", "disallow"), name)
                         .when(name.isin("crawl-delay", "request-rate"), "other")))
    w = Window.partitionBy("origin").orderBy("seq")
    useful = lines.filter("kind IS NOT NULL")
    before = F.lag("kind").over(w)
    opens = (F.col("kind") == "blank") | ((F.col("kind") == "agent") & (F.coalesce(before, F.lit("blank")) != "agent"))
    part = F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    useful = useful.withColumn("_opens", opens).withColumn("part", part)
    rule = F.when(F.col("kind").isin("allow", "disallow"), F.struct(
        "seq", (F.col("value").alias("prefix")),
        ((F.col("kind") == "allow") | (F.col("value") == "")).alias("allow")))
    groups = useful.groupBy("origin", "part").agg(
        F.collect_list(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"),
        F.sort_array(F.collect_list(rule)).alias("rules"),
        F.bool_or(~F.col("kind").isin("agent", "blank")).alias("closed"))
    groups = groups.filter((F.size("agents") > 0) & F.col("closed"))
    per_origin = groups.groupBy("origin").agg(F.sort_array(F.collect_list(
        F.struct("part", "agents", "rules"))).alias("groups"))
    return files.select("origin", "fetched").join(per_origin, "origin", "left")


def robots_allowed(path: Column, agent: str = "*", groups: Column | None = None, fetched: Column | None = None) -> Column:
    """First matching rule of the agent's group decides; no group or rule means allowed."""
    groups = F.col("groups") if groups is None else groups
    fetched = F.col("fetched") if fetched is None else fetched
    name = agent.split("/")[0].lower()
    named = F.filter(groups, lambda g: ~F.array_contains(g["agents"], "*") & F.exists(
        g["agents"], lambda a: F.contains(F.lit(name), a)))
    general = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    rules = F.coalesce(F.get(named, F.lit(0))["rules"], F.get(general, F.lit(0))["rules"])
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    hits = F.filter(rules, lambda r: (r["prefix"] == "*") | (r["prefix"] == "") | path.startswith(r["prefix"]))
    verdict = F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))
    return F.coalesce(fetched, F.lit(False)) & F.coalesce(path.startswith("/"), F.lit(False)) & verdict


def robots_filter(pages: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Add ``allowed`` to pages with columns origin and path.

    Rules are one row per origin, so a hot origin only widens the page side; AQE splits it.
    """
    return pages.join(rules, "origin", "left").withColumn(
        "allowed", robots_allowed(F.col("path"), agent)).drop("groups", "fetched")
