"""JSON documents: strict reading, bundles, file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.json_values import as_array, as_text, digest, pointer_get
from ..operators.collect import first_match

#: Files up to WHOLE bytes are read as one value; larger ones go through the digest in pieces of BLOCK bytes.
WHOLE, BLOCK = 64 << 20, 8 << 20
# A reference stays inside the tree: plain relative parts, no drive, no backslash.
_REF = r"^evaluation(?:/(?!\.{1,2}(?:/|$))[^/\\:]+)+$"


def valid_reference(ref: Column) -> Column:
    return ref.rlike(_REF)


def strict_json(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``document`` and ``code``: repeated keys, NaN and Infinity make a document unreadable."""
    out = documents.withColumn("document", F.try_parse_json(text))
    return out.withColumn("code", first_match(
        (~F.coalesce(valid_reference(F.col("ref")), F.lit(False)), "invalid_relative_reference"),
        (F.col("document").isNull(), "invalid_json")))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every JSON file below ``root`` as (ref, text); ``ref`` is relative to ``root``."""
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True))
    base = root.rstrip("/") + "/"
    return files.select(F.substring_index(F.col("_metadata.file_path"), base, -1).alias("ref"), F.col("value").alias("text"))


def assemble_cases(documents: DataFrame, case_refs: DataFrame, families: DataFrame) -> DataFrame:
    """Cases with oracle, fixture, labels and family: equi joins on references.

    ``documents``: ref, document. ``case_refs``: ref. ``families``: id, split, signature (VARIANT).
    A reference without document leaves a NULL document. Both tables have a row per file, far more than their estimate
    tells where they are unfolded from stored bundles, so the joins are by shuffle: no task holds all references of a side.
    """
    documents, families = documents.hint("merge"), families.hint("merge")
    cases = case_refs.join(documents, "ref", "left").withColumnRenamed("ref", "case_ref").withColumnRenamed("document", "case")
    get = lambda p: as_text(pointer_get(F.col("case"), p))
    cases = cases.select("case_ref", "case", get("/id").alias("case_id"), get("/split").alias("split"), get("/family_id").alias("family_id"),
                         get("/oracle/ref").alias("oracle_ref"), get("/fixture/ref").alias("fixture_ref"), get("/retrieval_labels/ref").alias("labels_ref"))
    for part in ("oracle", "fixture", "labels"):
        cases = cases.join(documents.select(F.col("ref").alias(f"{part}_ref"), F.col("document").alias(part)), f"{part}_ref", "left")
    known = families.select(F.col("id").alias("family_id"), F.col("split").alias("family_split"), F.col("signature").alias("family_signature"))
    return cases.join(known, "family_id", "left")


def inventory_errors(manifest: DataFrame, documents: DataFrame, referenced: DataFrame) -> DataFrame:
    """(ref, code): manifest hashes, actual files and referenced paths must be one set.

    ``manifest``: ref, sha256. ``documents``: ref, document. ``referenced``: ref. Every reference is one row
    on each side, so the joins have no hot key.
    """
    m = manifest.select("ref", F.col("sha256").alias("expected"))
    a = documents.select("ref", digest(F.col("document")).alias("actual"))
    r = referenced.select("ref").distinct().withColumn("named", F.lit(True))
    df = m.join(a, "ref", "full").join(r, "ref", "full")
    return df.withColumn("code", first_match(
        (F.col("expected").isNotNull() & F.col("actual").isNull(), "missing_or_escaping_reference"),
        (F.col("expected") != F.col("actual"), "file_hash_mismatch"),
        (F.col("named").isNotNull() & F.col("expected").isNull(), "incomplete_hash_inventory"),
        (F.col("expected").isNotNull() & F.col("named").isNull(), "incomplete_hash_inventory"),
        (F.col("expected").isNull(), "unindexed_json_asset"))).filter("code IS NOT NULL").select("ref", "code")


def referenced_paths(cases: DataFrame) -> DataFrame:
    """Union of every path an assembled case names."""
    return cases.select(F.explode(F.array("case_ref", "oracle_ref", "fixture_ref", "labels_ref")).alias("ref")).distinct()


def case_errors(cases: DataFrame, corpus_ids: DataFrame, signature: Column) -> DataFrame:
    """(case_id, code) of assembled cases: family, dependency hashes and label references."""
    repeated = cases.groupBy("case_id").agg(F.count("*").alias("_n"))
    labels = cases.select("case_id", F.explode(F.concat(*[F.transform(
        F.coalesce(as_array(pointer_get(F.col("labels"), "/" + n)), F.array().cast("array<variant>")),
        lambda v: F.struct(F.lit(n).alias("list"), as_text(v).alias("id")))
        for n in ("relevant_case_ids", "failure_relevant_case_ids")])).alias("l")).select("case_id", "l.*")
    twice = labels.groupBy("case_id", "list", "id").agg(F.count("*").alias("c")).filter("c > 1").select("case_id")
    unknown = labels.join(corpus_ids.select(F.col("case_id").alias("id")), "id", "left_anti").select("case_id")
    bad = twice.unionByName(unknown).distinct().withColumn("_labels", F.lit(True))
    df = cases.join(repeated, "case_id", "left").join(bad, "case_id", "left")
    stated = lambda n: as_text(pointer_get(F.col("case"), "/hashes/" + n))
    wrong = F.lit(False)
    for doc, name in (("fixture", "fixture"), ("oracle", "oracle"), ("labels", "retrieval_labels")):
        wrong = wrong | ~F.coalesce(digest(F.col(doc)) == stated(name), F.lit(False))
    return df.withColumn("code", first_match(
        ((F.col("_n") > 1) | F.col("family_split").isNull(), "duplicate_case_or_unknown_family"),
        ((F.col("split") != F.col("family_split")) | (digest(signature) != digest(F.col("family_signature"))), "family_signature_mismatch"),
        (F.coalesce("_labels", F.lit(False)), "invalid_retrieval_labels"),
        (wrong, "case_dependency_hash_mismatch"))).filter("code IS NOT NULL").select("case_id", "code")


# ---------------------------------------------------------------- registered files

def open_file(path: str):
    """A file's bytes as a stream: a path of the machine's own or mounted folders, else of a store that Arrow knows."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow import fs
    system, inner = fs.FileSystem.from_uri("s3" + path[3:] if scheme == "s3a" else path)
    return system.open_input_stream(inner)


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*", whole: int = WHOLE, block: int = BLOCK, opener=open_file) -> DataFrame:
    """(filename, sha256, size_bytes) of every file in a folder, whatever its size; Spark lists no empty ones.

    Spark lists the files and deals them to tasks by size. A file of more than ``whole`` bytes is streamed by its task, ``block`` bytes at a
    time, so a task's memory does not follow its files. ``opener`` gives the stream of a path; one that cannot be opened fails the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("filename")

    def stream(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            paths, digests = batch.column(1).to_pylist(), []
            for path in paths:
                state = hashlib.sha256()
                with opener(path) as file:
                    while part := file.read(block):
                        state.update(part)
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), batch.column(2)], ["filename", "sha256", "size_bytes"])

    small = files.filter(F.col("length") <= whole).select(name, F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    # The filter and the columns reach the scan, so no content is read here.
    large = files.filter(F.col("length") > whole).select(name, "path", F.col("length").alias("size_bytes"))
    return small.unionByName(large.mapInArrow(stream, "filename string, sha256 string, size_bytes long"))


def verify_manifest(entries: DataFrame, actual: DataFrame) -> DataFrame:
    """(filename, status): ok, missing, unindexed or artifact_changed."""
    e = entries.select("filename", F.col("sha256").alias("e_sha"), F.col("size_bytes").alias("e_size"), F.lit(True).alias("e"))
    a = actual.select("filename", F.col("sha256").alias("a_sha"), F.col("size_bytes").alias("a_size"), F.lit(True).alias("a"))
    return e.join(a, "filename", "full").select("filename", first_match(
        (F.col("a").isNull(), "missing"), (F.col("e").isNull(), "unindexed"),
        ((F.col("a_size") != F.col("e_size")) | (F.col("a_sha") != F.col("e_sha")), "artifact_changed"), (F.lit(True), "ok")).alias("status"))
