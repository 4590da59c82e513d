"""The pipeline, stage by stage, on a small folder of tables."""

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from evigrid.llm import queries
from evigrid.llm.bpe_monoid import read_ranks

from .test_jaccard import brute
from .test_mixing import direct
from .test_toxicity import texts


def folder(spark, path):
    rng = random.Random(9)
    rows = [[i, t, "en", f"s{i % 4}", len(t)] for i, t, _ in texts(400, 5)]
    clean = [r for r in rows if r[0] % 5]
    for k in range(60):  # copies, some with one word more
        base = rng.choice(clean[:40])
        rows.append([1000 + k, base[1] + (" more" if k % 2 else ""), "en", "s9", len(base[1])])
    for r in rows[1::7]:
        r[1] += f" write to user{r[0]}@mail.example.org now"
    rows += [[5000, None, None, None, None], [5001, "", "en", "s1", 0], [1001, *rows[401][1:]]]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return df


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    docs = folder(spark, path)
    names = docs.columns
    safe = C.reject_toxic(spark, docs, path)
    assert safe.columns == names
    toxic = {i for i, _, t in texts(400, 5) if t}
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in safe.select("doc_id").collect()} == toxic

    rows = [(r.doc_id, r.text) for r in safe.collect()]
    one = C.drop_near_duplicates(spark, safe, path)
    assert one.columns == names
    assert sorted(r.doc_id for r in one.collect()) == sorted({i for i, _, c in brute(rows, 80, 5) if i == c})

    clean = C.redact_personal_data(spark, one, path)
    assert clean.columns == names and clean.count() == one.count()
    assert clean.where(F.contains("text", F.lit("@"))).count() == 0 and clean.where(F.contains("text", F.lit("[EMAIL]"))).count() > 20
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0

    mixed = C.mix_sources(spark, clean, path)
    assert mixed.columns == names
    want = {i: taken // size for i, size, _, _, taken in direct([(r.doc_id, r.text, r.source) for r in clean.collect()]) if taken}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    text = {r.doc_id: r.text for r in clean.collect()}
    final = C.run(spark, path).collect()
    assert {r.doc_id for r in final} == set(want) and len(final) == sum(want.values())
    for r in final:
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                                                hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_registered():
    assert [s[0] for s in C.STAGES] == ["toxicity", "near_duplicates", "pii", "source_mix", "byte_bpe"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_one_row_of_each_class_with_null_and_repeated_ids(spark):
    text = [" ".join(f"w{f}x{k}" for k in range(100)) for f in range(5)]
    near = [t + " more" for t in text]
    rows = [(None, text[0]), (None, text[1]), (None, near[1]), (None, text[2]), (7, near[2]), (8, text[3]), (8, near[3]), (9, text[4]), (9, near[0]), (9, text[4]), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_no", F.lit("mine")).withColumn("row_no_", F.lit(1))
    one = C.drop_near_duplicates(spark, df.repartition(3), "")
    assert one.columns == ["doc_id", "text", "row_no", "row_no_"] and {(r.row_no, r.row_no_) for r in one.collect()} == {("mine", 1)}
    out = [tuple(r) for r in one.select("doc_id", "text").collect()]
    family = lambda t: t and t.removesuffix(" more")
    assert sorted(((i, family(t)) for i, t in out), key=repr) == sorted(
        [(9, text[0]), (None, text[1]), (7, text[2]), (8, text[3]), (9, text[4]), (None, None), (3, "")], key=repr)


def test_near_duplicates_are_five_words_and_four_fifths(spark):
    base = [f"u{k}" for k in range(300)]
    near = list(base)
    for k in range(6):
        near[25 + 48 * k] = f"new{k}"  # 0.816 of runs of five words, 0.886 of three
    rows = [(2, " ".join(base)), (1, " ".join(near)), (3, " ".join(base[:150] + [f"v{k}" for k in range(150)]))]
    one = C.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in one.collect()) == [1, 3]
    assert C.drop_near_duplicates(spark, one.limit(0), "").count() == 0
