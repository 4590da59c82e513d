"""Files of any size, digest trees, ablation corpora, loading by references."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from evigrid.session import cut_lineage
from evigrid.sources import bundles as B, documents as D


def test_files_of_any_size(spark, tmp_path):
    """A sparse file of 3 GiB and files around the limit of one value; a block is all a task holds of a large one."""
    (tmp_path / "empty.bin").touch()
    (tmp_path / "at limit.bin").write_bytes(b"a" * 1000)
    (tmp_path / "more%20é.bin").write_bytes(bytes(range(256)) * 40)
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(3 << 30)
    want, zero = {}, bytes(1 << 24)
    for p in tmp_path.iterdir():
        state = hashlib.sha256()
        if p.name == "sparse.bin":
            for _ in range((3 << 30) >> 24):
                state.update(zero)
        else:
            state.update(p.read_bytes())
        if p.stat().st_size:  # Spark lists no empty files
            want[p.name] = (state.hexdigest(), p.stat().st_size)
    actual = D.file_manifest(spark, str(tmp_path), whole=1000, block=1 << 20).cache()
    assert {r.filename: (r.sha256, r.size_bytes) for r in actual.collect()} == want
    changed = actual.withColumn("sha256", F.when(F.col("filename") == "sparse.bin", "0" * 64).otherwise(F.col("sha256")))
    assert {r.filename: r.status for r in D.verify_manifest(changed, actual).collect()} == {n: "artifact_changed" if n == "sparse.bin" else "ok" for n in want}


def plain_top(entries, levels):
    """Tree of one bundle, node by node."""
    text = lambda *x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    nodes = [(sha(text(k, r))[:levels], sha(text(k, r, s))) for k, r, s in entries]
    for level in range(levels, -1, -1):
        parts = {}
        for node, d in nodes:
            parts.setdefault(node[:level], []).append(f"{node}:{d}")
        nodes = [(part, sha("\n".join(sorted(below)))) for part, below in parts.items()]
    return nodes[0][1]


def test_digest_tree(spark):
    rng = random.Random(1)
    entries = [(b, rng.choice(["file", "source"]), f"evaluation/{rng.randrange(300)}é.json", f"{rng.randrange(9)}") for b in (1, 2) for _ in range(200)]
    df = spark.createDataFrame(entries, "bundle_id int, kind string, ref string, sha256 string")
    for levels in (0, 1, 3):
        top = {r.bundle_id: (r.digest, r.entries) for r in B.digest_tree(df, levels).where("level = 0").collect()}
        assert top == {b: (plain_top([e[1:] for e in entries if e[0] == b], levels), 200) for b in (1, 2)}
    other = [e if i not in (3, 250) else (*e[:3], "x") for i, e in enumerate(entries)]
    new = spark.createDataFrame(random.sample(other, len(other)), df.schema)
    got = {tuple(r) for r in B.tree_difference(B.digest_tree(df, 2), B.digest_tree(new, 2), 2).collect()}
    part = lambda e: hashlib.sha256(json.dumps(e[1:3], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:2]
    assert got == {(e[0], part(e)) for e in (entries[3], entries[250])}
    assert B.tree_difference(B.digest_tree(df, 2), B.digest_tree(df.orderBy("ref"), 2), 2).isEmpty()
    assert B.digest_tree(df.limit(0), 2).isEmpty()


def test_frozen_bundles(spark):
    """A file edited together with manifest and record is found by the pinned digest alone."""
    docs = spark.createDataFrame([(1, "evaluation/a.json", '{"v":1}')], "bundle_id int, ref string, j string").select("bundle_id", "ref", F.parse_json("j").alias("document"))
    sources = spark.createDataFrame([(1, "evaluation/s.py", "a\r\nb")], "bundle_id int, ref string, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kind = "bundle_id int, kind string, ref string, sha256 string"
    good = [(1, "file", "evaluation/a.json", sha('{"v":1}')), (1, "source", "evaluation/s.py", sha("a\nb"))]
    top = lambda rows: plain_top([r[1:] for r in rows], B.LEVELS)
    required = sources.select("bundle_id", "ref")

    def errors(rows, recorded, pinned):
        stated = spark.createDataFrame([(1, recorded, pinned)], "bundle_id int, recorded string, pinned string")
        return {(r.subject, r.code) for r in B.bundle_errors(spark.createDataFrame(rows, kind), docs, sources, stated, required).collect()}

    old = [(1, "file", "evaluation/a.json", sha('{"v":0}')), good[1]]
    assert errors(good, top(good), top(good)) == errors(good, top(good), None) == set()
    assert errors(good, top(good), top(old)) == {("", "manifest_not_frozen")}
    assert errors(old, top(old), top(old)) == {("evaluation/a.json", "file_hash_mismatch")}
    assert errors(good, top(old), None) == {("", "manifest_hash_mismatch")}
    assert errors(good[:1], top(good[:1]), None) == {("evaluation/s.py", "incomplete_source_inventory")}


def test_ablation_corpora(spark):
    base = {"id": "a", "title": "t", "terms": ["x", "y"], "guidance": "g"}
    extra = {"e1": {}, "e2": {"features": {"method": "GET"}}, "e3": {"features": {"method": "GET"}, "failure_modes": [], "repairability": {}}}
    rows = [(c, 1, {**base, **x}) for c, x in extra.items()]
    rows += [(c, 2, {**base, **x, "terms": ["y", "x"] if c == "e3" else ["x", "y"]}) for c, x in extra.items()]
    rows += [(c, 3, {**base, **x} if c != "e3" else {**base, **x, "features": {"method": "POST"}}) for c, x in extra.items()]
    rows += [("e1", 4, base), ("e1", 4, base), ("e2", 4, {**base, **extra["e2"]}), ("e1", 5, "text"), ("e2", 6, {**base, "features": {"method": "PUT"}}),
             ("e2", 7, {**base, "features": {"colour": "GET"}})]
    df = spark.createDataFrame([(c, p, json.dumps(d)) for c, p, d in rows], "corpus string, place int, j string").select("corpus", "place", F.parse_json("j").alias("document"))
    got = {tuple(r) for r in B.ablation_errors(df).collect()}
    lost = "ablation_identity_changed"
    assert got == {(2, "", lost), (3, "", "ablation_features_changed"), (4, "", lost), (5, "", lost), (6, "", lost), (7, "", lost),
                   (5, "e1", "invalid_ablation_fields"), (6, "e2", "invalid_feature_metadata"), (7, "e2", "invalid_feature_metadata")}


def test_loading_by_references(spark, tmp_path):
    files = {"a": ["b", "c"], "b": ["c"], "c": [], "d": ["e"], "e": ["d"], "f": ["d"], "g": ["../x", "gone"], "unread": ["a"], "self": ["self"]}
    (tmp_path / "evaluation").mkdir()
    for name, to in files.items():
        (tmp_path / "evaluation" / f"{name}.json").write_text(json.dumps({"one": {"ref": f"evaluation/{to[0]}.json"} if to else 1, "two": f"evaluation/{to[1]}.json" if len(to) > 1 else None}))
    (tmp_path / "evaluation" / "bad.json").write_text('{"a":NaN}')
    texts = D.read_documents(spark, str(tmp_path))
    roots = spark.createDataFrame([(f"evaluation/{r}.json",) for r in ("a", "a", "f", "g", "bad", "self")], "ref string")
    got = {r.ref[11:-5]: (r.code, r.has) for r in B.reference_closure(texts, roots, ["/one/ref", "/two"]).select(
        "ref", "code", F.col("document").isNotNull().alias("has")).collect()}
    cyclic, lost = ("cyclic_reference", False), ("missing_or_escaping_reference", False)
    assert got == {"a": (None, True), "b": (None, True), "c": (None, True), "f": cyclic, "d": cyclic, "e": cyclic, "self": cyclic, "g": (None, True),
                   "../x": lost, "gone": lost, "bad": ("invalid_json", False)}
    assert B.reference_closure(texts, roots.limit(0), ["/two"]).isEmpty()


def test_assembled_references_are_joined_by_shuffle(spark):
    """No side of the reference joins is sent whole to every task, however small its estimate; repeats and nulls stay as they are."""
    texts = {f"evaluation/{kind}/{i}.json": '{"rows":[]}' for kind in ("oracles", "inputs", "labels") for i in range(5)}
    for i in range(6):  # the last names an oracle that is not there
        texts[f"evaluation/cases/{i}.json"] = json.dumps({"id": f"c{i}", "split": "development", "family_id": f"f{i % 3}", "retrieval_labels": {}, **{
            part: {"ref": f"evaluation/{part}s/{i}.json".replace("fixtures", "inputs")} for part in ("oracle", "fixture")}})
    rows = [*texts.items(), ("evaluation/oracles/1.json", '{"rows":[1]}'), (None, "{}")]
    docs = cut_lineage(spark.createDataFrame(rows, "ref string, text string").select("ref", F.parse_json("text").alias("document")))
    refs = spark.createDataFrame([(f"evaluation/cases/{i}.json",) for i in range(6)] + [("evaluation/cases/none.json",)], "ref string")
    families = spark.createDataFrame([(f"f{i}", "development") for i in range(2)], "id string, split string").withColumn("signature", F.parse_json(F.lit("null")))
    families = cut_lineage(families)
    cases = D.assemble_cases(docs, refs, families)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (cases, D.referenced_paths(cases))]
    assert all("BroadcastHashJoin" not in p and p.count("SortMergeJoin") == 5 for p in plans)
    got = cases.groupBy("case_id").agg(F.count("*").alias("n"), F.count("oracle").alias("oracles"), F.count("family_split").alias("known")).collect()
    assert {r.case_id: (r.n, r.oracles, r.known) for r in got} == {
        None: (1, 0, 0), "c0": (1, 1, 1), "c1": (2, 2, 2), "c2": (1, 1, 0), "c3": (1, 1, 1), "c4": (1, 1, 1), "c5": (1, 0, 0)}
    paths = {r.ref for r in D.referenced_paths(cases).collect()}
    assert paths == {None, "evaluation/cases/none.json", *(f"evaluation/{k}/{i}.json" for k in ("cases", "oracles", "inputs") for i in range(6))}
