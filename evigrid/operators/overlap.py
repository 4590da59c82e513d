"""Contamination audit between splits through content digests.

Signals are equi-joins on digests, never a comparison of all pairs. Three exact views of the same result, from small to large:

* ``overlap_groups``: one row per shared digest, with the number of pairs it links;
* ``overlap_cases``: one row per case with its decision, signals and link counts;
* ``overlap_pairs``: one row per pair with a signal. Its size is that of the answer; the first two are linear in the input and
  are what an audit of large shared groups should read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import (as_array, as_object, as_text, canonical_json, digest, pointer_get,
                                     set_digest, type_tag)
from ..functions.texts import is_sensitive
from ..functions.walks import nested_subtrees, structures
from ..session import cut_lineage
from .collect import first_match

# Signal names, strong ones first.
STRONG = ("S1_same_family_id", "S2_exact_structural_signature", "S3_exact_oracle_result_hash",
          "S4_exact_record_set", "S5_exact_response_payload")
WEAK = ("W1_partial_record_overlap", "W2_nested_response_subtree_overlap", "W3_endpoint_composition_match",
        "W4_pagination_semantics_match", "W5_failure_code_match", "W6_repair_disposition_match")
S1, S2, S3, S4, S5 = STRONG
W1, W2, W3, W4, W5, W6 = WEAK

VIEW_COLUMNS = ("case_id", "split", "family_id", "family_signature_digest", "oracle_result_sha256", "record_hashes",
                "response_payload_hashes", "nested_subtree_hashes", "endpoint_composition_signature",
                "pagination_signature", "failure_code", "repair_disposition")
# Columns an audit may publish: ids, decisions, counts and digests, never source data.
PUBLIC_COLUMNS = frozenset((
    "left_case_id", "right_case_id", "case_id", "split", "decision", "strong_signals", "weak_signals", "signal",
    "digest", "cases", "splits", "pairs", "links", "shared_records", "left_records", "right_records",
    "shared_payloads", "payload_digest", "shared_subtrees", "subtree_digest", "record_set_digest", "held_pairs",
    "overall_decision", "pair_count", "block", "manual_review", "auto_pass"))
DECISION_RANK = {"auto_pass": 0, "manual_review": 1, "block": 2}


def _case(case: Column | None = None):
    return (lambda name: F.col(name)) if case is None else (lambda name: case[name])


def scalar_signals(case: Column | None = None) -> dict[str, Column]:
    """Signal → the one digest of a case that must be equal; NULL never matches."""
    c = _case(case)
    return {S1: c("family_id"), S2: c("family_signature_digest"), S3: c("oracle_result_sha256"),
            S4: F.when(F.size(c("record_hashes")) > 0, set_digest(c("record_hashes"))),
            W3: c("endpoint_composition_signature"), W4: c("pagination_signature"), W5: c("failure_code"),
            W6: F.when(c("repair_disposition") != "none", c("repair_disposition"))}


def checked_views(views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable views, refused rows with a code): ids must be present and unique."""
    repeated = views.groupBy("case_id").agg(F.count("*").alias("_n"))
    judged = views.join(repeated, "case_id", "left").withColumn("code", F.when(
        F.coalesce("case_id", F.lit("")) == "", "empty_case_id").when(F.col("_n") > 1, "duplicate_case_id"))
    return judged.filter("code IS NULL").drop("_n", "code"), judged.filter("code IS NOT NULL").select("case_id", "code")


def signal_keys(views: DataFrame) -> DataFrame:
    """(signal, digest, case_id, split, record_set, records): one row per digest of a case."""
    record_set = scalar_signals()[S4]
    single = [F.struct(F.lit(s).alias("signal"), d.alias("digest")) for s, d in scalar_signals().items()]

    def each(signal, column):
        return F.transform(F.array_distinct(F.col(column)),
                           lambda d: F.struct(F.lit(signal).alias("signal"), d.alias("digest")))

    many = [each(S5, "response_payload_hashes"), each(W1, "record_hashes"), each(W2, "nested_subtree_hashes")]
    keys = F.filter(F.concat(F.array(*single), *[F.coalesce(m, F.array().cast(
        "array<struct<signal:string,digest:string>>")) for m in many]), lambda k: k["digest"].isNotNull())
    rows = views.select("case_id", "split", record_set.alias("_set"), F.size("record_hashes").alias("records"), F.explode(keys).alias("k"))
    # W1 counts only pairs whose record sets differ, so its keys carry the set as well.
    return rows.select("k.signal", "k.digest", "case_id", "split",
                       F.when(F.col("k.signal") == W1, F.col("_set")).alias("record_set"), "records")


def _linked(keys: DataFrame) -> DataFrame:
    """Members per (signal, digest, split, record_set) with the number of partners of one member.

    Partners sit in another split and, for W1, have another record set:
    all - same split - same set + same split and set. Every step is a partial aggregate, and the
    joined tables have one row per digest and split, whatever the size of the group.
    """
    cell = keys.groupBy("signal", "digest", "split", "record_set").agg(F.count("*").alias("n_cell"))
    by_split = cell.groupBy("signal", "digest", "split").agg(F.sum("n_cell").alias("n_split"))
    total = by_split.groupBy("signal", "digest").agg(F.sum("n_split").alias("n"), F.count("*").alias("splits")).filter("splits > 1")
    by_set = cell.filter("record_set IS NOT NULL").groupBy("signal", "digest", "record_set").agg(F.sum("n_cell").alias("n_set"))
    out = (cell.join(total, ["signal", "digest"]).join(by_split, ["signal", "digest", "split"])
           .join(by_set, ["signal", "digest", "record_set"], "left"))
    same_set = F.when(F.col("record_set").isNotNull(), F.col("n_set") - F.col("n_cell")).otherwise(0)
    return out.withColumn("partners", F.col("n") - F.col("n_split") - same_set)


def overlap_groups(views: DataFrame) -> DataFrame:
    """Shared digests: members, splits and the exact number of cross-split pairs they link."""
    linked = _linked(signal_keys(views))
    return linked.groupBy("signal", "digest").agg(
        F.first("n").alias("cases"), F.first("splits").alias("splits"),
        (F.sum(F.col("n_cell") * F.col("partners")) / 2).cast("bigint").alias("pairs")).filter("pairs > 0")


def overlap_cases(views: DataFrame) -> DataFrame:
    """Worst decision and fired signals per case, with the links behind them; no pair is built."""
    keys = signal_keys(views)
    linked = _linked(keys).filter("partners > 0").select("signal", "digest", "split", "record_set", "partners")
    k, g = keys.alias("k"), linked.alias("g")
    same = F.col("k.record_set").eqNullSafe(F.col("g.record_set"))
    for c in ("signal", "digest", "split"):
        same = same & (F.col(f"k.{c}") == F.col(f"g.{c}"))
    hits = k.join(g, same).select("k.case_id", "k.split", "k.signal", "g.partners")
    per_case = hits.groupBy("case_id", "split").agg(
        F.sort_array(F.collect_set("signal")).alias("signals"), F.sum("partners").alias("links"))
    return (views.select("case_id", "split").join(per_case, ["case_id", "split"], "left")
            .withColumn("strong_signals", F.filter(F.coalesce("signals", F.array().cast("array<string>")), lambda s: s.startswith("S")))
            .withColumn("weak_signals", F.filter(F.coalesce("signals", F.array().cast("array<string>")), lambda s: s.startswith("W")))
            .withColumn("decision", decide(F.col("strong_signals"), F.col("weak_signals")))
            .withColumn("links", F.coalesce("links", F.lit(0))).drop("signals"))


def decide(strong: Column, weak: Column) -> Column:
    """Any strong signal blocks, any weak one asks for review; counts never escalate."""
    return F.when(F.size(strong) > 0, "block").when(F.size(weak) > 0, "manual_review").otherwise("auto_pass")


def compare(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    """Every signal of (left, right) view structs, with counts and digests as evidence."""
    a, b = scalar_signals(left), scalar_signals(right)
    equal = {s: F.coalesce(a[s] == b[s], F.lit(False)) for s in a}
    shared = lambda c: F.coalesce(F.array_intersect(left[c], right[c]), F.array().cast("array<string>"))
    first_left = left["case_id"] < right["case_id"]
    out = (pairs.withColumn("_eq", F.struct(*[equal[s].alias(s) for s in equal]))
           .withColumn("_records", shared("record_hashes")).withColumn("_payloads", shared("response_payload_hashes"))
           .withColumn("_subtrees", shared("nested_subtree_hashes")))
    fired = {**{s: F.col("_eq")[s] for s in equal}, S5: F.size("_payloads") > 0,
             W1: (F.size("_records") > 0) & ~F.col("_eq")[S4], W2: F.size("_subtrees") > 0}
    names = lambda group: F.filter(F.array(*[F.when(fired[s], F.lit(s)) for s in group]), lambda s: s.isNotNull())
    pick = lambda x, y: F.when(first_left, x).otherwise(y)
    hashed = lambda c: F.when(F.size(c) > 0, set_digest(F.col(c)))
    return out.withColumn("strong_signals", names(STRONG)).withColumn("weak_signals", names(WEAK)).select(
        pick(left["case_id"], right["case_id"]).alias("left_case_id"),
        pick(right["case_id"], left["case_id"]).alias("right_case_id"),
        decide(F.col("strong_signals"), F.col("weak_signals")).alias("decision"), "strong_signals", "weak_signals",
        F.size("_records").alias("shared_records"),
        pick(F.size(left["record_hashes"]), F.size(right["record_hashes"])).alias("left_records"),
        pick(F.size(right["record_hashes"]), F.size(left["record_hashes"])).alias("right_records"),
        F.size("_payloads").alias("shared_payloads"), hashed("_payloads").alias("payload_digest"),
        F.size("_subtrees").alias("shared_subtrees"), hashed("_subtrees").alias("subtree_digest"))


def _held_elsewhere(views: DataFrame) -> DataFrame:
    """The signal keys whose digest some split other than the largest holds, stored.

    A digest of two splits is always one of them, so no pair is lost; where the other splits are small, their digests are sent to all tasks and the
    keys of the largest split, mostly its own, are neither shuffled nor worked out again.
    """
    keys = signal_keys(views)
    largest = views.where("split IS NOT NULL").groupBy("split").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "split").first()
    # Written before the join, so that its size is known there.
    wanted = cut_lineage(keys.where(F.col("split") != F.lit(largest and largest["split"])).select("signal", "digest").distinct())
    return cut_lineage(keys.join(wanted, ["signal", "digest"], "left_semi"))


def overlap_pairs(views: DataFrame, block: int = 1000) -> DataFrame:
    """Cross-split pairs with at least one signal, with counts and digests as evidence.

    Everything about a pair is told by the digests it shares, so pairs are grouped hits of one join on digests and no
    view travels with them. Two splits of a digest meet: the larger side is dealt into chunks of about ``block`` members and meets the other one chunk
    by chunk, so a hot digest is spread over many tasks and no more rows are compared than there are pairs. Views must have unique, non-empty ids (``checked_views``).
    """
    keys = _held_elsewhere(views)
    sizes = keys.groupBy("signal", "digest", "split").agg(F.count("*").alias("n"))
    low, high = (sizes.select("signal", "digest", F.col("split").alias(x), F.col("n").alias(f"n_{x}")) for x in ("low", "high"))
    larger = F.greatest("n_low", "n_high")
    meets = cut_lineage(low.join(high, ["signal", "digest"]).where("low < high").select(
        "signal", "digest", "low", "high", (F.col("n_low") == larger).alias("low_dealt"), F.ceil(larger / block).cast("int").alias("chunks")))
    key = ["signal", "digest", "low", "high", "chunk"]

    def side(name, dealt, of):
        """Members of one split of every two that meet: in one chunk each where they are dealt, else in all."""
        own = F.pmod(F.xxhash64("case_id"), F.col("chunks")).cast("int")
        chunks = F.when(dealt, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
        rows = keys.withColumnRenamed("split", name).join(meets, ["signal", "digest", name])
        return rows.select(*key[:-1], F.explode(chunks).alias("chunk"), F.struct(F.col("case_id").alias("id"), "records").alias(of))

    # Members of one split never meet each other.
    both = side("low", F.col("low_dealt"), "l").join(side("high", ~F.col("low_dealt"), "h"), key).where("l.id <> h.id")
    first, last = F.least("l", "h"), F.greatest("l", "h")  # by id
    hits = both.select(first["id"].alias("left_case_id"), last["id"].alias("right_case_id"), "signal", "digest",
                       first["records"].alias("left_records"), last["records"].alias("right_records"))
    of = lambda s: F.when(F.col("signal") == s, F.col("digest"))
    pairs = hits.groupBy("left_case_id", "right_case_id").agg(
        F.collect_set("signal").alias("_hit"), F.count(of(W1)).cast("int").alias("shared_records"),
        F.first("left_records").alias("left_records"), F.first("right_records").alias("right_records"),
        F.collect_set(of(S5)).alias("_payloads"), F.collect_set(of(W2)).alias("_subtrees"))
    # Equal record sets are S4; W1 is for sets that differ.
    has = lambda s: F.array_contains("_hit", s) & ((~F.array_contains("_hit", S4)) if s == W1 else F.lit(True))
    names = lambda group: F.filter(F.array(*[F.when(has(s), F.lit(s)) for s in group]), lambda s: s.isNotNull())
    hashed = lambda c: F.when(F.size(c) > 0, set_digest(F.col(c)))
    out = pairs.withColumn("strong_signals", names(STRONG)).withColumn("weak_signals", names(WEAK))
    return out.select(
        "left_case_id", "right_case_id", decide(F.col("strong_signals"), F.col("weak_signals")).alias("decision"), "strong_signals",
        "weak_signals", "shared_records", "left_records", "right_records", F.size("_payloads").alias("shared_payloads"),
        hashed("_payloads").alias("payload_digest"), F.size("_subtrees").alias("shared_subtrees"), hashed("_subtrees").alias("subtree_digest"))


def pair_count(views: DataFrame) -> DataFrame:
    """Number of cross-split pairs, by arithmetic."""
    sizes = views.groupBy("split").agg(F.count("*").alias("n"))
    return sizes.agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("bigint").alias("pair_count"))


def audit_order(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("left_case_id", "right_case_id")


def severity(decision: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in DECISION_RANK.items() for x in p]), decision)


def report_order(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc(severity(F.col("decision"))), "left_case_id", "right_case_id")


def screen_candidates(candidates: DataFrame, views: DataFrame) -> DataFrame:
    """New cases against the known ones: a row for every pair with a signal; the others are ``auto_pass`` by absence.

    Both sides go through the digest join of ``overlap_pairs``, each as a split of its own, so any number of candidates can come at once.
    """
    both = candidates.withColumn("split", F.lit("candidate")).unionByName(views.withColumn("split", F.lit("known")))
    return overlap_pairs(both)


def screen_candidate(candidate: DataFrame, views: DataFrame) -> DataFrame:
    """One new case against every known one, with a row also for those it passes: a projection over ``views``, no join.

    ``candidate`` must hold exactly one view; Spark fails the query otherwise.
    """
    one = candidate.select(F.struct(*VIEW_COLUMNS)).scalar()
    known = views.select(F.struct(*VIEW_COLUMNS).alias("known")).withColumn("candidate", one)
    return compare(known.filter(F.col("known.case_id") != F.col("candidate.case_id")), F.col("candidate"), F.col("known"))


def decision_rollup(pairs: DataFrame) -> DataFrame:
    """Counts per decision and the worst one."""
    counted = pairs.agg(F.count("*").alias("pair_count"), *[
        F.count_if(F.col("decision") == k).alias(k) for k in DECISION_RANK])
    return counted.withColumn("overall_decision", F.when(F.col("block") > 0, "block").when(
        F.col("manual_review") > 0, "manual_review").otherwise("auto_pass"))


def assert_public(df: DataFrame) -> DataFrame:
    """Refuse an output with any column that is not on the public list."""
    for name in df.columns:
        if name not in PUBLIC_COLUMNS:
            raise ValueError(f"leak_guard_violation:{name}")
    return df


# ---------------------------------------------------------------- views from documents

# Type names inside signatures, request keys that page.
TYPE_NAMES = {"null": "NoneType", "boolean": "bool", "integer": "int", "number": "float", "string": "str",
              "array": "list", "object": "dict"}
PAGE_KEYS = ("cursor", "offset", "page", "page_number", "page_token")


def type_name(v: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p]), type_tag(v))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


_DEEPER = "\0"


def shape_text(v: Column, levels: int = 10) -> Column:
    """Name-free shape of a value as JSON text: kinds only, repeated shapes once, sensitive members left out.

    A shape quotes the shapes inside it, so its text doubles with every level; values nested deeper than ``levels`` have none (NULL).
    """
    text = _shape(v, levels)
    return F.when(~F.contains(text, F.lit(_DEEPER)), text)


def _shape(v: Column, levels: int) -> Column:
    if levels == 0:
        return F.lit(_DEEPER)
    members = F.map_values(F.map_filter(as_object(v), lambda k, c: ~is_sensitive(k)))
    parts = F.transform(F.coalesce(as_array(v), members), lambda c: _shape(c, levels - 1))
    inner = F.array_join(F.transform(F.sort_array(F.array_distinct(parts)), _quoted), ", ")
    kind = F.when(as_object(v).isNotNull(), "object").when(as_array(v).isNotNull(), "array")
    return F.when(kind.isNull(), F.concat(F.lit('"'), type_name(v), F.lit('"'))).otherwise(
        F.concat(F.lit('["'), kind, F.lit('", ['), inner, F.lit("]]")))


def _keys(v: Column) -> Column:
    return F.coalesce(F.map_keys(as_object(v)), F.array().cast("array<string>"))


def page_kind(query: Column, body: Column) -> Column:
    keys = F.concat(_keys(query), _keys(body))
    return F.when(F.array_contains(keys, "cursor"), "cursor").when(F.array_contains(keys, "offset"), "offset").otherwise("page_number")


def page_location(query: Column, body: Column) -> Column:
    names = F.array(*map(F.lit, PAGE_KEYS))
    return F.when(F.arrays_overlap(_keys(query), names), "query").when(
        F.arrays_overlap(_keys(body), names), "json_body").otherwise("none")


def continuation_flags(responses: Column) -> Column:
    """Sorted names of top-level booleans over all responses."""
    names = F.transform(responses, lambda b: F.map_keys(F.map_filter(as_object(b), lambda k, v: type_tag(v) == "boolean")))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(names, lambda n: n.isNotNull()))))


def stop_signal(responses: Column) -> Column:
    total = F.exists(responses, lambda b: F.coalesce(type_tag(pointer_get(b, "/total")) == "integer", F.lit(False)))
    return F.when(total, "total_present").when(F.size(continuation_flags(responses)) > 0, "flag_only").otherwise("none")


def _json_list(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, _quoted), ","), F.lit("]"))


def _flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def _container(body: Column) -> Column:
    """Coarse response container as canonical JSON text."""
    kids = F.coalesce(as_array(body), F.map_values(as_object(body)))
    kinds = F.coalesce(F.sort_array(F.array_distinct(F.transform(kids, type_name))), F.array().cast("array<string>"))
    has_list = F.coalesce(F.array_contains(F.transform(F.map_values(as_object(body)), type_tag), "array"), F.lit(False))
    root = F.when(as_object(body).isNotNull(), "object").when(as_array(body).isNotNull(), "array").when(
        type_tag(body).isin("null", "missing"), "null").otherwise(type_name(body))
    return F.concat(F.lit('{"child_kinds":'), _json_list(kinds), F.lit(',"has_array_child":'), _flag(has_list),
                    F.lit(',"root":"'), root, F.lit('"}'))


def _by_digest(texts: Column) -> Column:
    """JSON texts in the order of their digests."""
    ranked = F.sort_array(F.transform(texts, lambda t: F.struct(F.sha2(t, 256).alias("d"), t.alias("t"))))
    return F.array_join(F.transform(ranked, lambda x: x["t"]), ",")


def _member(e: Column, name: str) -> Column:
    return pointer_get(e, "/" + name)


def _present(v: Column) -> Column:
    return F.size(_keys(v)) > 0


def endpoint_composition(endpoints: Column) -> Column:
    def one(e):
        q, b = _member(e, "query"), _member(e, "request_body")
        return F.concat(F.lit('{"body_placement":'), _flag(_present(b)), F.lit(',"method":'), canonical_json(_member(e, "method")),
                        F.lit(',"pagination_location":"'), page_location(q, b), F.lit('","query_placement":'), _flag(_present(q)),
                        F.lit(',"response_container":'), _container(pointer_get(e, "/responses/0")), F.lit("}"))
    body = _by_digest(F.transform(endpoints, one))
    return F.sha2(F.concat(F.lit('{"endpoint_count":'), F.size(endpoints).cast("string"), F.lit(',"endpoints":['), body, F.lit("]}")), 256)


def pagination_signature(endpoints: Column) -> Column:
    """Digest of how the endpoints page, NULL when none does."""
    paging = F.filter(endpoints, lambda e: page_location(_member(e, "query"), _member(e, "request_body")) != "none")

    def one(e):
        q, b, answers = _member(e, "query"), _member(e, "request_body"), as_array(_member(e, "responses"))
        return F.concat(F.lit('{"continuation_flag":'), _json_list(continuation_flags(answers)), F.lit(',"method":'),
                        canonical_json(_member(e, "method")), F.lit(',"page_kind":"'), page_kind(q, b), F.lit('","page_location":"'),
                        page_location(q, b), F.lit('","stop_signal":"'), stop_signal(answers), F.lit('"}'))
    body = _by_digest(F.transform(paging, one))
    return F.when(F.size(paging) > 0, F.sha2(F.concat(F.lit('{"pagination":['), body, F.lit("]}")), 256))


def family_signature(endpoints: Column) -> Column:
    """Structural signature as canonical JSON text: method, paging, query use and body structure (its digest, at any depth) per endpoint."""
    def rest(e):
        q, b = _member(e, "query"), _member(e, "request_body")
        return F.concat(F.lit('","method":'), canonical_json(_member(e, "method")), F.lit(',"paging":"'), page_kind(q, b), F.lit('","query_present":'),
                        _flag(_present(q)), F.lit("}"))
    bodies = F.transform(endpoints, lambda e: pointer_get(e, "/responses/0"))
    parts = structures(bodies, F.transform(endpoints, lambda e: F.lit('{"body_structure":"')), F.transform(endpoints, rest))
    return F.concat(F.lit('{"endpoints":['), F.array_join(F.sort_array(parts), ","), F.lit("]}"))


def normalize_views(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(views, refused): one digest view per case from its Variant documents.

    ``documents``: case, oracle, fixture, family_signature (all VARIANT). Bad input becomes a row with a code.
    """
    c, o, f = F.col("case"), F.col("oracle"), F.col("fixture")
    text = lambda v: F.when(type_tag(v) == "string", as_text(v))
    get = pointer_get
    endpoints, records = as_array(get(f, "/endpoints")), get(o, "/records")
    disposition = text(get(c, "/repair_expectation/policy_disposition"))
    blank = lambda v: F.coalesce(v, F.lit("")) == ""
    answers = F.transform(endpoints, lambda e: as_array(get(e, "/responses")))
    optional_text = lambda v: v.isNull() | type_tag(v).isin("string", "null")
    rows = as_array(records)
    code = first_match(
        (as_object(c).isNull() | as_object(o).isNull() | as_object(f).isNull(), "invalid_projection_input"),
        (blank(text(get(c, "/id"))), "missing_case_id"), (blank(text(get(c, "/split"))), "missing_split"),
        (blank(text(get(c, "/family_id"))), "missing_family_id"), (blank(disposition), "missing_repair_disposition"),
        (endpoints.isNull() | (F.size(endpoints) == 0), "missing_endpoints"),
        (F.exists(endpoints, lambda e: type_tag(get(e, "/method")) != "string"), "invalid_endpoint"),
        (F.exists(answers, lambda a: a.isNull() | (F.size(a) == 0)), "invalid_response_sequence"),
        (~F.coalesce(type_tag(records), F.lit("null")).isin("missing", "null", "array")
         | F.coalesce(F.exists(rows, lambda r: as_object(r).isNull()), F.lit(False)), "invalid_records"),
        (~optional_text(get(o, "/result_sha256")), "invalid_oracle_result_sha256"),
        (~optional_text(get(o, "/expected_error_code")), "invalid_failure_code"))
    judged = documents.withColumn("code", code)
    bodies = F.flatten(answers)
    none = F.array().cast("array<string>")
    sorted_set = lambda a: F.sort_array(F.array_distinct(F.coalesce(a, none)))
    views = judged.filter("code IS NULL").select(
        text(get(c, "/id")).alias("case_id"), text(get(c, "/split")).alias("split"), text(get(c, "/family_id")).alias("family_id"),
        digest(F.col("family_signature")).alias("family_signature_digest"), text(get(o, "/result_sha256")).alias("oracle_result_sha256"),
        sorted_set(F.transform(rows, digest)).alias("record_hashes"), sorted_set(F.transform(bodies, digest)).alias("response_payload_hashes"),
        sorted_set(nested_subtrees(bodies)).alias("nested_subtree_hashes"),
        endpoint_composition(endpoints).alias("endpoint_composition_signature"),
        pagination_signature(endpoints).alias("pagination_signature"), text(get(o, "/expected_error_code")).alias("failure_code"),
        disposition.alias("repair_disposition"))
    return views, judged.filter("code IS NOT NULL").select(text(get(c, "/id")).alias("case_id"), "code")


def family_leakage(families: DataFrame) -> DataFrame:
    """Signatures used on more than one split. ``families``: id, split, signature_digest."""
    return families.groupBy("signature_digest").agg(
        F.sort_array(F.collect_set("split")).alias("splits"), F.count("*").alias("families")).filter(F.size("splits") > 1)
