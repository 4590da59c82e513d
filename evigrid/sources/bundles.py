"""Bundles of files: digest trees, freezing, ablation corpora, and loading by following references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import as_text, canonical_json, digest, pointer_get
from ..functions.texts import source_digest
from ..operators.collect import first_match
from ..plans.knowledge import FEATURES
from ..session import cut_lineage
from .documents import valid_reference

#: Levels below the top of a digest tree; a node of the lowest level holds the entries of one of 16^LEVELS parts.
LEVELS = 4


# ---------------------------------------------------------------- digest trees

def digest_tree(entries: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Digests over the entries (bundle_id, kind, ref, sha256) of manifests: one row per node as (bundle_id, level, node, digest, entries).

    An entry's part is the first ``levels`` hex digits of the digest of its kind and ref; a node above is the digest of at most 16
    below, the top (level 0) stands for the whole manifest. The order of entries has no influence; repeated entries count. Every level is
    an aggregate over a sixteenth of the nodes of the one below, so no task holds a manifest.
    """
    line = lambda *c: F.to_json(F.to_variant_object(F.array(*[F.coalesce(F.col(x), F.lit("")) for x in c])))
    nodes = entries.select("bundle_id", F.substring(F.sha2(line("kind", "ref"), 256), 1, levels).alias("node"),
                           F.sha2(line("kind", "ref", "sha256"), 256).alias("digest"), F.lit(1).cast("long").alias("entries"))
    found = []
    for level in range(levels, -1, -1):
        part = F.substring("node", 1, level)
        below = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "node", "digest"))), "\n")
        nodes = nodes.groupBy("bundle_id", part.alias("part")).agg(F.sha2(below, 256).alias("digest"), F.sum("entries").alias("entries"))
        nodes = cut_lineage(nodes.select("bundle_id", F.lit(level).alias("level"), F.col("part").alias("node"), "digest", "entries"))
        found.append(nodes)
    return reduce(DataFrame.unionByName, reversed(found))


def tree_difference(old: DataFrame, new: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Parts (bundle_id, node) of the lowest level in which two trees differ, found from the top down.

    A level is compared only below nodes that differ, so what two versions share is not read past its highest common node.
    """
    differing = None
    for level in range(levels + 1):
        sides = [t.filter(F.col("level") == level).select("bundle_id", "node", F.col("digest").alias(d)) for t, d in ((old, "d_old"), (new, "d_new"))]
        if differing is not None:
            sides = [s.withColumn("above", F.substring("node", 1, level - 1)).join(
                differing.withColumnRenamed("node", "above"), ["bundle_id", "above"], "left_semi").drop("above") for s in sides]
        both = sides[0].join(sides[1], ["bundle_id", "node"], "full")
        # Written, since the next level reads it twice.
        differing = cut_lineage(both.filter(~F.col("d_old").eqNullSafe(F.col("d_new"))).select("bundle_id", "node"))
    return differing


# ---------------------------------------------------------------- frozen bundles

def bundle_errors(entries: DataFrame, documents: DataFrame, sources: DataFrame, stated: DataFrame, required: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(bundle_id, subject, code): every failed check of a bundle's digests.

    ``entries``: bundle_id, kind (file or source), ref, sha256 of a manifest. ``documents``: bundle_id, ref, document (VARIANT).
    ``sources``: bundle_id, ref, text. ``stated``: bundle_id, recorded, pinned, the top of the manifest's tree as recorded beside it and as kept
    outside the bundle when it was frozen; without a pinned one the bundle is not frozen. ``required``: bundle_id, ref of the sources a manifest has
    to name, no more and no less. Subject is a ref, or empty for the bundle itself.

    Files, sources and manifest are checked against the digests, those against the recorded top, that against the pinned one: a file edited
    together with its manifest and the record is still found by the last step.
    """
    top = digest_tree(entries, levels).filter("level = 0").select("bundle_id", "digest")
    itself = stated.join(top, "bundle_id", "left")
    own = [itself.filter(~F.col("digest").eqNullSafe(F.col("recorded"))).select("bundle_id", F.lit("").alias("subject"), F.lit("manifest_hash_mismatch").alias("code")),
           itself.filter(F.col("pinned").isNotNull() & ~F.col("recorded").eqNullSafe(F.col("pinned"))).select(
               "bundle_id", F.lit("").alias("subject"), F.lit("manifest_not_frozen").alias("code"))]
    actual = documents.select("bundle_id", F.lit("file").alias("kind"), "ref", digest(F.col("document")).alias("actual")).unionByName(
        sources.select("bundle_id", F.lit("source").alias("kind"), "ref", source_digest(F.col("text")).alias("actual")))
    named = entries.select("bundle_id", "kind", "ref", F.col("sha256").alias("expected"))
    inside = F.coalesce(valid_reference(F.col("ref")), F.lit(False))
    held = named.join(actual, ["bundle_id", "kind", "ref"], "left").withColumn("code", first_match(
        (~inside | F.col("actual").isNull(), "missing_or_escaping_reference"),
        (~F.col("actual").eqNullSafe(F.col("expected")), "hash_mismatch"))).filter("code IS NOT NULL")
    code = F.when(F.col("code") == "hash_mismatch", F.concat_ws("_", "kind", "code")).otherwise(F.col("code"))
    changed = held.select("bundle_id", F.col("ref").alias("subject"), code.alias("code"))
    both = named.filter("kind = 'source'").select("bundle_id", "ref", F.lit(1).alias("has")).distinct().join(
        required.select("bundle_id", "ref", F.lit(1).alias("needs")).distinct(), ["bundle_id", "ref"], "full")
    inventory = both.filter("has IS NULL OR needs IS NULL").select("bundle_id", F.col("ref").alias("subject"), F.lit("incomplete_source_inventory").alias("code"))
    return reduce(DataFrame.unionByName, [*own, changed, inventory])


# ---------------------------------------------------------------- ablation corpora

# Members of a knowledge row, and what the second and third corpus add.
IDENTITY = ("guidance", "id", "terms", "title")
ADDED = {"e1": (), "e2": ("features",), "e3": ("failure_modes", "features", "repairability")}


def ablation_errors(corpora: DataFrame) -> DataFrame:
    """(place, corpus, code) of three corpora that have to differ in added members only.

    ``corpora``: corpus (e1, e2, e3), place, document (VARIANT). Rows of one place are compared: their identity (id, title, terms, guidance) over
    all three, their features over the last two. A place that a corpus lacks or has twice breaks identity. Corpus is empty where
    it is the comparison that fails. A place has a handful of rows, so nothing hot arises from any value.
    """
    rows = corpora.select("corpus", "place", "document", F.map_keys(F.try_variant_get("document", "$", "map<string,variant>")).alias("names"),
                          F.try_variant_get("document", "$.features", "map<string,string>").alias("features"))
    wanted = F.lit(None).cast("array<string>")
    for corpus, added in ADDED.items():
        wanted = F.when(F.col("corpus") == corpus, F.array(*[F.lit(x) for x in sorted((*IDENTITY, *added))])).otherwise(wanted)
    known = F.lit(True)
    for name, values in FEATURES.items():
        known = known & F.coalesce(F.col("features")[name].isin(*sorted(map(str, values))), ~F.map_contains_key("features", F.lit(name)))
    known = known & F.forall(F.map_keys("features"), lambda k: k.isin(*FEATURES))
    member = lambda n: F.coalesce(canonical_json(pointer_get(F.col("document"), "/" + n)), F.lit("-"))
    rows = rows.withColumn("code", first_match(
        (~F.sort_array(F.coalesce("names", F.array().cast("array<string>"))).eqNullSafe(wanted), "invalid_ablation_fields"),
        (F.col("features").isNotNull() & ~F.coalesce(known, F.lit(False)), "invalid_feature_metadata")))
    rows = rows.withColumn("identity", F.sha2(F.to_json(F.to_variant_object(F.array(*map(member, IDENTITY)))), 256)).withColumn("own", F.sha2(member("features"), 256))
    single = rows.filter("code IS NOT NULL").select("place", "corpus", "code")
    later = lambda c: F.when(F.col("corpus") != "e1", F.col(c))
    places = rows.groupBy("place").agg(
        F.count("*").alias("n"), F.count_distinct("corpus").alias("of"), F.min("identity").alias("i0"), F.max("identity").alias("i1"),
        F.min(later("own")).alias("f0"), F.max(later("own")).alias("f1"))
    whole = (F.col("n") == 3) & (F.col("of") == 3)
    code = first_match((~whole | (F.col("i0") != F.col("i1")), "ablation_identity_changed"), (F.col("f0") != F.col("f1"), "ablation_features_changed"))
    pairs = places.withColumn("code", code).filter("code IS NOT NULL").select("place", F.lit("").alias("corpus"), "code")
    return single.unionByName(pairs)


# ---------------------------------------------------------------- loading by references

def references(document: Column, pointers: list[str]) -> Column:
    """The texts at ``pointers`` of a document; those that are absent or no text are none."""
    return F.filter(F.array(*[as_text(pointer_get(document, p)) for p in pointers]), lambda r: r.isNotNull())


def reference_closure(texts: DataFrame, roots: DataFrame, pointers: list[str]) -> DataFrame:
    """The documents reached from ``roots`` (ref), as (ref, document, code), one row per reference.

    ``texts``: ref, text, unique per ref. Round by round the references of the documents just reached are looked up; only what a reference names is
    parsed, each once. Codes: ``missing_or_escaping_reference`` (outside the tree, or no such file), ``invalid_json``, ``cyclic_reference`` (on a
    cycle, or leading into one). Refused documents are not followed and have no document. There are as many rounds as the longest chain.
    """
    frontier = cut_lineage(roots.select("ref").distinct())
    found, edges = [], []
    while not frontier.isEmpty():
        inside = F.coalesce(valid_reference(F.col("ref")), F.lit(False))
        read = frontier.join(texts.select("ref", "text"), "ref", "left").withColumn("document", F.when(inside, F.try_parse_json("text")))
        read = read.withColumn("code", first_match((~inside | F.col("text").isNull(), "missing_or_escaping_reference"), (F.col("document").isNull(), "invalid_json")))
        found.append(cut_lineage(read.select("ref", "document", "code")))
        edges.append(cut_lineage(found[-1].select("ref", F.explode(F.array_distinct(references(F.col("document"), pointers))).alias("to"))))
        known = reduce(DataFrame.unionByName, [f.select("ref") for f in found])
        frontier = cut_lineage(edges[-1].select(F.col("to").alias("ref")).distinct().join(known, "ref", "left_anti"))
    if not found:
        return texts.select("ref", F.parse_json(F.lit("null")).alias("document"), F.lit("").alias("code")).limit(0)
    every, links = reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, edges)
    # Documents without references are taken away with the links to them until none is left to take; what remains leads into a cycle.
    left = links.count()
    while left:
        links = cut_lineage(links.join(links.select(F.col("ref").alias("to")).distinct(), "to", "left_semi"))
        before, left = left, links.count()
        if before == left:
            break
    cyclic = links.select("ref").distinct().withColumn("cyclic", F.lit(True))
    out = every.join(cyclic, "ref", "left")
    code = F.when(F.col("cyclic"), "cyclic_reference").otherwise(F.col("code"))
    return out.select("ref", F.when(F.col("cyclic").isNull(), F.col("document")).alias("document"), code.alias("code"))
