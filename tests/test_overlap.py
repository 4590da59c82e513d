"""Overlap goldens, and the digest joins against a comparison of all pairs."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from evigrid.functions.json_values import digest_value
from evigrid.operators import overlap as O

FLAT = [{"rows": [{"no": n, "town": t} for n, t in part], "more": more, "total": 5}
        for part, more in (([(11, "Ulm"), (12, "Brno"), (13, "Graz")], True), ([(14, "Pau"), (15, "Lodz")], False))]
RECORDS = [r for page in FLAT for r in page["rows"]]
NESTED = [{"box": {"parts": [{"code": c, "info": {"label": w}}], "size": 1}} for c, w in (("q1", "bolt"), ("q2", "cog"))]
NESTED_RECORDS = [{"code": "q1", "label": "bolt"}, {"code": "q2", "label": "cog"}]


def endpoint(responses, method="GET", query=None, body=None):
    return {"request_id": "r", "method": method, "url": "http://127.0.0.1/", "query": {"page": "1"} if query is None else query,
            "request_body": body, "responses": responses}


def case(i, split, family, records, endpoints, disposition="none", code=None):
    return ({"id": i, "split": split, "family_id": family, "repair_expectation": {"policy_disposition": disposition}},
            {"records": records, "result_sha256": digest_value(records) if records else None, "expected_error_code": code}, {"endpoints": endpoints})


def views(spark, cases):
    rows = [tuple(json.dumps(x) for x in c) for c in cases]
    df = spark.createDataFrame(rows, "c string, o string, f string").select(
        *[F.parse_json(a).alias(b) for a, b in (("c", "case"), ("o", "oracle"), ("f", "fixture"))])
    df = df.withColumn("family_signature", F.parse_json(F.coalesce(O.family_signature(
        F.try_variant_get("fixture", "$.endpoints", "array<variant>")), F.lit("{}"))))
    return O.normalize_views(df)


def test_bundle_goldens(spark):
    good, bad = views(spark, [
        case("flat_case", "development", "get_flat", RECORDS, [endpoint(FLAT)]),
        case("multi_case", "frozen_evaluation", "get_multi", RECORDS, [endpoint(FLAT), endpoint([{"count": 4, "label": "summary"}])]),
        case("nested_case", "frozen_evaluation", "nested", NESTED_RECORDS, [endpoint(NESTED)]),
        case("broken", "", "x", None, [endpoint(FLAT)])])
    assert [(r.case_id, r.code) for r in bad.collect()] == [("broken", "missing_split")]
    good = good.cache()
    pairs = {(r.left_case_id, r.right_case_id): r for r in O.overlap_pairs(good).collect()}
    hit = pairs["flat_case", "multi_case"]
    assert hit.decision == "block" and [s[:2] for s in hit.strong_signals] == ["S3", "S4", "S5"]
    # Ids, decision and digests only; no source value can show.
    O.assert_public(O.overlap_pairs(good))
    assert "Brno" not in str(pairs)
    reuse, _ = views(spark, [case("reuse", "development", "new_family", NESTED_RECORDS, [endpoint(NESTED, "POST", {}, None)])])
    row = {r.right_case_id: r for r in O.screen_candidate(reuse, good.filter("case_id <> 'reuse'")).collect() if r.left_case_id == "reuse"}
    row.update({r.left_case_id: r for r in O.screen_candidate(reuse, good).collect() if r.right_case_id == "reuse"})
    assert row["nested_case"].decision == "block" and [s[:2] for s in row["nested_case"].strong_signals] == ["S3", "S4", "S5"]
    assert [s[:2] for s in row["nested_case"].weak_signals] == ["W2"]
    fresh = [{"sku": "DEMO-0001"}]
    clean, _ = views(spark, [case("clean", "development", "other", fresh, [endpoint([{"payload": {"rows": fresh, "marker": "a"}}], "POST", {}, None)])])
    assert {r.decision for r in O.screen_candidate(clean, good).collect()} == {"auto_pass"}
    assert O.decision_rollup(O.screen_candidate(reuse, good)).first().overall_decision == "block"
    batch = {(r.left_case_id, r.right_case_id): r.decision for r in O.screen_candidates(reuse.unionByName(clean), good).collect()}
    assert batch["nested_case", "reuse"] == "block" and not any("clean" in k for k in batch)


def random_views(spark, n, seed):
    rng = random.Random(seed)
    some = lambda k, m: sorted({f"h{rng.randrange(m)}" for _ in range(rng.randrange(k))})
    rows = []
    for i in range(n):
        # A third of all cases are copies of one another: one hot group per signal.
        copy = rng.random() < 0.33
        rows.append((f"c{i:03d}", rng.choice(["a", "b", "c"]), "hot" if copy else f"f{rng.randrange(40)}", f"s{rng.randrange(60)}",
                     rng.choice([None, f"o{rng.randrange(30)}"]), ["h1", "h2"] if copy else some(4, 50), ["p"] if copy else some(3, 90),
                     some(3, 80), f"w{rng.randrange(70)}", rng.choice([None, f"g{rng.randrange(40)}"]), rng.choice([None, f"e{rng.randrange(20)}"]),
                     rng.choice(["none", "none", "rejected"])))
    schema = ("case_id string, split string, family_id string, family_signature_digest string, oracle_result_sha256 string, record_hashes array<string>, "
              "response_payload_hashes array<string>, nested_subtree_hashes array<string>, endpoint_composition_signature string, "
              "pagination_signature string, failure_code string, repair_disposition string")
    return rows, spark.createDataFrame(rows, schema)


def brute(rows):
    out = {}
    for a, b in itertools.combinations(rows, 2):
        if a[1] == b[1]:
            continue
        same_set = bool(a[5]) and set(a[5]) == set(b[5])
        fired = [n for n, hit in (
            ("S1", a[2] == b[2]), ("S2", a[3] == b[3]), ("S3", a[4] is not None and a[4] == b[4]), ("S4", same_set), ("S5", bool(set(a[6]) & set(b[6]))),
            ("W1", not same_set and bool(set(a[5]) & set(b[5]))), ("W2", bool(set(a[7]) & set(b[7]))), ("W3", a[8] == b[8]),
            ("W4", a[9] is not None and a[9] == b[9]), ("W5", a[10] is not None and a[10] == b[10]), ("W6", a[11] != "none" and a[11] == b[11])) if hit]
        if fired:
            out[tuple(sorted((a[0], b[0])))] = tuple(fired)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_digest_joins_equal_all_pairs(spark, seed):
    rows, df = random_views(spark, 60, seed)
    want = brute(rows)
    short = lambda r: tuple(s[:2] for s in [*r.strong_signals, *r.weak_signals])
    got = {(r.left_case_id, r.right_case_id): short(r) for r in O.overlap_pairs(df, block=7).collect()}
    assert got == want
    # Case roll-up and group counts, computed without pairs.
    sides = {}
    for pair, fired in want.items():
        for c in pair:
            sides.setdefault(c, set()).update(fired)
    cases = {r.case_id: set(short(r)) for r in O.overlap_cases(df).collect()}
    assert cases == {r[0]: sides.get(r[0], set()) for r in rows}
    groups = {}
    for r in O.overlap_groups(df).collect():
        groups[r.signal[:2]] = groups.get(r.signal[:2], 0) + r.pairs
    for s in ("S1", "S2", "S3", "S4", "W3", "W4", "W5", "W6"):
        assert groups.get(s, 0) == sum(s in f for f in want.values())


def test_a_group_of_many_pairs_stays_exact(spark):
    """220 copies in two splits link 12,100 pairs, and one decision each."""
    rows, df = random_views(spark, 1, 3)
    one = list(rows[0])
    one[2], one[5], one[6], one[7] = "hot", ["h1", "h2"], ["p"], ["s1", "s2"]
    many = [tuple([f"c{i:03d}", "a" if i % 2 else "b", *one[2:]]) for i in range(220)]
    views = spark.createDataFrame(many, df.schema)
    pairs = O.overlap_pairs(views, block=50)
    assert pairs.count() == 12_100 and pairs.filter("decision = 'block' and shared_records = 2 and shared_subtrees = 2").count() == 12_100
    assert O.overlap_groups(views).filter("signal like 'S1%'").first().pairs == 12_100
    assert {r.links > 0 and r.decision for r in O.overlap_cases(views).collect()} == {"block"}


def test_refused_ids_and_leak_guard(spark):
    _, df = random_views(spark, 4, 1)
    good, bad = O.checked_views(df.unionByName(df.limit(1)))
    assert {r.code for r in bad.collect()} == {"duplicate_case_id"} and good.count() == 3
    with pytest.raises(ValueError, match="leak_guard_violation"):
        O.assert_public(df)


def test_keys_of_one_split_alone_are_not_kept(spark):
    """Of 300 cases in one split and 2 in another only digests that both hold are joined; families of one split never meet."""
    _, df = random_views(spark, 1, 3)
    case = lambda i, split, family: (f"c{i:03d}", split, family, f"sig{i}", None, [f"r{i}"], [f"p{i}"], [], f"comp{i}", None, None, "none")
    rows = [case(i, "large", "hot" if i % 2 else "own") for i in range(300)] + [case(300, "small", "hot"), case(301, "tiny", "hot")]
    views = spark.createDataFrame(rows, df.schema)
    assert O._held_elsewhere(views).filter("split = 'large'").count() == 150
    assert O.overlap_pairs(views, block=40).count() == 150 + 150 + 1
    assert O.overlap_pairs(views.filter("split = 'large'")).count() == 0 == O.overlap_pairs(views.limit(0)).count()
