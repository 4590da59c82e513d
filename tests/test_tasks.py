"""Windows over hot keys, the task state machine, repair, scoring, sinks and streams."""

import json
import random

import pytest
from pyspark.sql import Window, functions as F

from evigrid.operators import contracts as C, paging as P, repair as R, scoring as S, trace as T, windows as W
from evigrid.plans.specs import ExtractionPlan
from evigrid.sources import documents as D, sinks
from evigrid.streaming import jobs as ST
from evigrid.workloads import inputs as I


def hot_events(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.randrange(1000), i) for i in range(n)]
    return spark.createDataFrame(rows, "task_id string, t int, i int")


def test_chunked_windows_equal_plain_ones(spark):
    df = hot_events(spark)
    chunk = F.floor(F.col("t") / 50)
    w = Window.partitionBy("task_id").orderBy("t", "i")
    plain = {r.i: (r.n, r.p, r.c) for r in df.select("i", F.row_number().over(w).alias("n"), F.lag("i").over(w).alias("p"),
                                                      F.count("*").over(Window.partitionBy("task_id")).alias("c")).collect()}
    a = {r.i: (r.n, r.c) for r in W.sequence_numbers(df, ["task_id"], ["t", "i"], chunk, "n", "c").collect()}
    b = {r.i: r.p for r in W.previous_values(df, ["task_id"], ["t", "i"], chunk, {"i": "p"}).collect()}
    assert {i: (a[i][0], b[i], a[i][1]) for i in plain} == plain
    pages = {r.i: (r.page_no, r.pos, r.has_next) for r in W.paginate(df, ["task_id"], ["t", "i"], 7, chunk).collect()}
    assert pages == {i: ((n - 1) // 7 + 1, (n - 1) % 7, ((n - 1) // 7 + 1) * 7 < c) for i, (n, _, c) in plain.items()}


def machine(requests):
    """One request after the other, as a plain loop."""
    state, log = None, []
    for status in requests:
        new = status
        if state in T.TERMINAL or status == state:
            continue
        if state == T.CANCELLING and status not in ("cancelled", "interrupted"):
            if status not in T.TERMINAL:
                continue
            new = "cancelled"
        if state in T.STAGES and status in T.STAGES and T.STAGES.index(status) <= T.STAGES.index(state):
            continue
        state = new
        log.append(new)
    return log


def test_state_machine_equals_the_loop(spark):
    rng = random.Random(7)
    tasks = {f"t{i}": [rng.choice(T.STATUSES) if rng.random() < 0.25 else rng.choice(T.STAGES) for _ in range(rng.randrange(1, 14))] for i in range(150)}
    df = spark.createDataFrame([(t, n, s) for t, seq in tasks.items() for n, s in enumerate(seq)], "task_id string, n int, status string").repartition(5)
    got = {r.task_id: [e.status for e in r.timeline] for r in T.lifecycle_state(df, ["n"]).collect()}
    assert got == {t: machine(seq) for t, seq in tasks.items()}


def test_any_page_reads_its_range_alone(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(300), i, f"t{i}") for i in range(2000)]
    order = [F.desc("k"), "i"]
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = P.page_index(spark.createDataFrame(rows, "k int, i int, name string").repartition(5), order)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert index.total == 2000 and len(index.parts) > 2
    for page in (1, 2, 57, 199, 200, 201, 1_000_000):
        got = index.page(page, 10)
        assert [tuple(r) for r in got.collect()] == want[page * 10 - 10:page * 10]
        assert len(got.inputFiles()) <= 2
    sizes = [b - a for a, b in zip((0, *index.upto), index.upto)]
    inside = sizes[0] // 10 - 1  # a page well within the first range
    assert len(index.page(inside, 10).inputFiles()) == 1
    assert P.page_index(spark.createDataFrame([], "k int, i int"), order).page(1, 10).count() == 0
    for page, size in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError, match="invalid_page"):
            index.page(page, size)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from evigrid.session import shared_folder
    conf = lambda found: SimpleNamespace(get=lambda key, default=None: found.get(key, default))
    session = lambda master, found: SimpleNamespace(conf=conf({"spark.sql.warehouse.dir": "file:/w/"}), sparkContext=SimpleNamespace(master=master, getConf=lambda: conf(found)))
    assert shared_folder(session("spark://h:1", {"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_folder(session("local[4]", {})) == "file:/w"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn", {}))


def test_streams_equal_batch_and_resume(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"t{rng.randrange(12)}", n, rng.choice(T.STATUSES[:7])) for n in range(200)]
    schema = "task_id string, n int, status string"
    out = str(tmp_path)
    for part in (rows[100:], rows[:100]):  # the later half arrives first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(out + "/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(out + "/in")
        ST.lifecycle_stream(stream, ["n"], out + "/state", out + "/cursor")
    got = {r.task_id: [e.status for e in r.timeline] for r in ST.latest(spark, out + "/state", "task_id").collect()}
    want = {r.task_id: [e.status for e in r.timeline] for r in T.lifecycle_state(spark.createDataFrame(rows, schema), ["n"]).collect()}
    assert got == want
    tail = lambda: ST.event_tail(spark.readStream.schema(schema).parquet(out + "/in").withColumnRenamed("n", "seq"), 20, out + "/tail", out + "/tc")
    tail()
    spark.createDataFrame([("t0", 999, "created")], schema).write.mode("append").parquet(out + "/in")
    tail()
    assert spark.read.parquet(out + "/tail").count() == 179 + 1


def test_trace_view_with_missing_and_malformed_parts(spark):
    tasks = spark.createDataFrame([("a", "m", "2026-01-01"), ("b", "m", "2026-01-01")], "task_id string, model string, created_at string")
    life = T.lifecycle_state(spark.createDataFrame([("a", i, s) for i, s in enumerate(("created", "observing", "analyzing", "failed"))],
                                                   "task_id string, n int, status string"), ["n"])
    report = json.dumps({"status": "failed", "count": True, "pages": 2, "error": "duplicate_id", "error_repairable": False, "elapsed_seconds": 1.5})
    failure = json.dumps({"schema_version": 1, "failure_phase": "execution", "failure_context": {"error_code": "duplicate_id", "category": 3}, "case_ids": ["x", 1],
                          "knowledge_gate": {"applied": True}})
    files = [("a", n, c) for n, c in (("report.json", report), ("plan.json", '{"fields":{"id":"/id"}}'), ("repair.json", '{"attempts":[1],"proposals":[]}'),
                                      ("failure_retrieval.json", failure), ("evidence.json", "[1,2]"), ("stray.txt", "x"))]
    art = spark.createDataFrame(files, "task_id string, filename string, content string").withColumn("sha256", F.sha2("content", 256)).withColumn("size_bytes", F.lit(1).cast("bigint"))
    rows = {r.task_id: r for r in T.trace_view(tasks, life, art).collect()}
    a, b = rows["a"], rows["b"]
    assert a.phase == "terminal" and a.outcome["count"] is None and a.outcome["pages"] == 2 and a.outcome["error_repairable"] is False
    assert a.evidence.observing.observations == 2 and a.evidence.analyzing.plan_fields == ["id"] and a.evidence.executing is None
    assert a.failure_retrieval.case_ids == ["x"] and a.failure_retrieval.failure_context.category is None and a.repair.document.attempts == 1
    assert [f.filename for f in a.artifacts] == sorted(f[1] for f in files if f[1] != "stray.txt")
    assert b.timeline_available is False and b.artifacts == [] and b.failure_retrieval is None and b.phase == "running"
    states = {r.key: r.state for r in T.trace_steps(life).collect()}
    assert states == {"observing": "reached", "analyzing": "failed", "executing": "absent", "verifying": "absent"}


def test_repair_goldens(spark):
    plan = ("/missing", "/total")
    body = json.dumps({"items": [{"id": 1}], "total": 1})
    two = json.dumps({"items": [{"id": 1}], "other": [{"id": 2}], "total": 1})
    plans = spark.createDataFrame([(i, "req_001", plan[0], {"id": "/id"}, "id", "query", "page", None, plan[1]) for i in (1, 2)],
                                  "source_id int, request_id string, items_pointer string, fields map<string,string>, unique_key string, "
                                  "pagination_location string, page_parameter string, has_next_pointer string, total_pointer string")
    obs = spark.createDataFrame([(1, body), (2, two)], "source_id int, body string").select(
        "source_id", F.lit("req_001").alias("request_id"), F.lit("GET").alias("method"), F.lit("http://127.0.0.1/").alias("url"),
        F.create_map(F.lit("page"), F.lit("1")).alias("query"), F.lit(None).cast("variant").alias("request_body"), "body")
    pages = obs.select("source_id", F.lit(1).alias("page_no"), "body")
    summary, audit = R.repair_and_rerun(pages, plans, obs, ["id"], max_pages=3)
    s = {r.source_id: r for r in summary.collect()}
    assert (s[1].status, s[1]["count"], s[1].completeness, s[1].repair_outcome) == ("succeeded", 1, "complete", "applied")
    assert (s[2].status, s[2].error_code, s[2].repair_outcome) == ("failed", "pointer_not_found", "rejected")
    a = {r.source_id: r for r in audit.collect()}[1]
    assert a.original_plan_hash == "7f084e9e55ac7aeb84ae402bb0920bf53d993dcdde252a32ba170f3b04d37563"
    assert a.candidate_plan_hash == "9c9ad0a8eef032e07d250f3f0b098807d905c0975dfaeafc886365c964d56d9e"
    assert (a.modified_fields, a.reason_code, a.validation_result, a.proposal_reason) == (["items_pointer"], "repairable", "valid", "pointer_relocated")
    assert R.audit_violations(audit).count() == 0
    assert ExtractionPlan("req_001", "/items", {"id": "/id"}, "id", total_pointer="/total").content_hash() == a.candidate_plan_hash


def test_scores(spark):
    docs = lambda rows: spark.createDataFrame([(t, i + 1, json.dumps(r)) for t, rs in rows.items() for i, r in enumerate(rs)],
                                               "task_id int, ordinal int, j string").withColumn("document", F.parse_json("j"))
    good = [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]
    answers = docs({t: good for t in range(1, 7)})
    oracle = answers.select("task_id").distinct().select("task_id", F.lit(2).alias("record_count"), F.lit(1).alias("page_count"),
        F.lit("complete").alias("completeness"), F.create_map(*[F.lit(x) for x in ("id", "integer", "v", "string")]).alias("schema"), F.lit("id").alias("unique_key"))
    rows = {1: good, 2: good[::-1], 3: [good[0], {"id": 2, "v": 5}], 4: [good[0], good[0]], 5: good[:1], 6: good}
    reports = spark.createDataFrame([(t, "succeeded" if t < 6 else "failed", 1, "complete", True, True, t == 1) for t in rows],
                                    "task_id int, status string, pages int, completeness string, " + ", ".join(f"{f} boolean" for f in S.FLAGS))
    out = {r.task_id: (r.task_success, r.delivery_success) for r in S.score_tasks(reports, docs(rows), oracle, answers, reports, docs(rows)).collect()}
    assert out == {1: (True, True), **{t: (False, False) for t in range(2, 7)}}


def test_result_sets_are_compared_by_first_rows_and_counts(spark):
    """Types come from the first row of a task; null places, repeated keys and tasks without rows on one side."""
    rows = [(1, 1, '{"id":1,"a":1}'), (1, 2, '{"id":2,"a":"x"}'), (2, 1, '{"id":1}'), (2, 2, '{"id":1}'), (3, None, '{"id":1}'), (4, 1, '{"id":1}')]
    other = [(1, 2, '{"id":1,"a":1}'), (1, 1, '{"id":2,"a":"x"}'), (2, 1, '{"id":1}'), (2, 2, '{"id":1}'), (3, None, '{"id":1}')]
    load = lambda r: spark.createDataFrame(r, "task_id long, ordinal long, text string").select("task_id", "ordinal", F.parse_json("text").alias("document"))
    tasks = spark.createDataFrame([(t, 1, "complete", 2) for t in (1, 2, 3, 4, 5)], "task_id long, pages int, completeness string, expected_total long")
    got = {r.task_id: (r.record_count, r.field_types, r.unique_keys, r.records, r.matches) for r in S.compare_results(tasks, tasks, load(rows), load(other), "id").collect()}
    assert got == {1: (True, False, True, True, False), 2: (True, True, False, True, False), 3: (True, True, True, True, True),
                   4: (False, False, True, False, False), 5: (True, True, True, True, True)}
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    assert I.dealt(rows, "k", most=10).rdd.getNumPartitions() == 10


def test_documents_sinks_and_contracts(spark, tmp_path):
    refs = ["evaluation/a.json", "evaluation/a/b.json", "evaluation/../x", "evaluation//x", "/evaluation/x", "evaluation/a/", "evaluation/./x", "evaluation/a:b", "other/x"]
    df = spark.createDataFrame([(r, "{}") for r in refs], "ref string, text string")
    assert [r.code is None for r in D.strict_json(df).collect()] == [True, True] + [False] * 7
    folder = str(tmp_path)
    (tmp_path / "evaluation").mkdir()
    (tmp_path / "evaluation" / "x.json").write_text('{"a":\n1}')
    assert [tuple(r) for r in D.read_documents(spark, folder).collect()] == [("evaluation/x.json", '{"a":\n1}')]
    rows = spark.createDataFrame([("=1+1", 1.5, None), ("ok,\"q\"", -2.0, "x")], "`=h` string, n double, t string").coalesce(1)
    sinks.write_csv(rows, folder + "/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes().decode()
    assert text.split("\r\n")[:2] == ["\ufeff'=h,n,t", "'=1+1,1.5,"] and '"ok,""q"""' in text
    with pytest.raises(Exception, match="non_finite_number"):
        sinks.write_json(spark.createDataFrame([(float("nan"),)], "x double"), folder + "/json")
    versions = spark.createDataFrame([('{"version":1}',), ('{"version":true}',), ('{"version":2}',), ("[]",)], "j string").select(
        C.dispatch_version(F.parse_json("j"), F.lit(2)))
    assert [r[0] for r in versions.collect()] == ["mixed_case_schema_version", "unknown_case_version", None, "unknown_case_version"]
