"""Queries: task lifecycle, timelines, trace view, paging of task tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace as T
from ..operators.windows import sequence_numbers
from . import inputs as I
from .registry import query

REQ = """
WITH req AS (SELECT user_id AS task_id, event_id, ts, date_trunc('millisecond', ts) AS ms, props, event_type,
  CASE WHEN event_id%211=0 THEN 'succeeded' WHEN event_id%223=0 THEN 'interrupted' WHEN event_id%151=0 THEN 'cancelling'
   WHEN event_type='signup' THEN 'created' WHEN event_type='view' THEN 'observing' WHEN event_type='click' THEN 'analyzing'
   WHEN event_type='purchase' THEN 'executing' WHEN event_id%37=0 THEN 'failed' ELSE 'verifying' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
"""
LIFE = REQ + """
, idx AS (SELECT *, CASE status WHEN 'created' THEN 0 WHEN 'observing' THEN 1 WHEN 'analyzing' THEN 2 WHEN 'executing' THEN 3 WHEN 'verifying' THEN 4 END AS i,
  status IN ('succeeded','failed','cancelled','interrupted') AS fin FROM req),
cut AS (SELECT task_id, min(rn) FILTER (fin) AS t_end FROM idx GROUP BY 1),
cut2 AS (SELECT task_id, t_end, (SELECT min(rn) FROM idx x WHERE x.task_id=cut.task_id AND x.status='cancelling' AND (t_end IS NULL OR x.rn<t_end)) AS t_can FROM cut),
seen AS (SELECT idx.*, t_end, t_can, max(i) OVER (PARTITION BY task_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM idx JOIN cut2 USING (task_id)),
log AS (SELECT task_id, event_id, rn, CASE WHEN fin AND t_can IS NOT NULL AND status<>'interrupted' THEN 'cancelled' ELSE status END AS status FROM seen
  WHERE (i IS NOT NULL AND i > coalesce(before,-1) AND rn < coalesce(least(t_end,t_can), t_end, t_can, 1e18)) OR rn=t_end OR rn=t_can)
"""


def requests(spark, d):
    e, k = F.col("event_id"), F.col("event_type")
    status = (F.when(e % 211 == 0, "succeeded").when(e % 223 == 0, "interrupted").when(e % 151 == 0, "cancelling")
              .when(k == "signup", "created").when(k == "view", "observing").when(k == "click", "analyzing")
              .when(k == "purchase", "executing").when(e % 37 == 0, "failed").otherwise("verifying"))
    return I.table(spark, d, "events").select(F.col("user_id").alias("task_id"), "event_id", "ts", status.alias("status"), "props", "event_type")


def hour():
    """Pieces of a task's time line."""
    return F.date_trunc("hour", F.col("ts"))


@query("lifecycle_batch", LIFE + "SELECT task_id, event_id, status, CAST(row_number() OVER (PARTITION BY task_id ORDER BY rn) AS INTEGER) AS seq FROM log")
def lifecycle_batch(spark, d):
    log = T.event_log(T.lifecycle_state(requests(spark, d), ["ts", "event_id"]))
    return log.select("task_id", F.col("at.event_id").alias("event_id"), "status", "seq")


@query("event_sequence", REQ + "SELECT event_id, rn AS seq FROM req")
def event_sequence(spark, d):
    return T.event_sequence(requests(spark, d), ["ts", "event_id"], hour()).select("event_id", "seq")


@query("stage_durations", REQ + """
, d AS (SELECT *, epoch_us(ms - lag(ms) OVER (PARTITION BY task_id ORDER BY rn)) / 1e6 AS dur FROM req)
SELECT task_id, status, round(coalesce(arg_min(dur, rn) FILTER (dur IS NOT NULL OR rn=1), -1.0), 3) AS duration_s FROM (
  SELECT task_id, status, rn, coalesce(dur, -1.0) AS dur FROM d) GROUP BY ALL""")
def stage_durations(spark, d):
    events = requests(spark, d).withColumn("ms", F.date_trunc("millisecond", F.col("ts")).cast("timestamp"))
    out = T.stage_durations(events, ["ts", "event_id"], "ms", hour())
    return out.select("task_id", "status", F.coalesce("duration_s", F.lit(-1.0)).alias("duration_s"))


@query("trace_steps", LIFE + """
, fin AS (SELECT task_id, arg_max(status, rn) AS status FROM log GROUP BY 1),
st AS (SELECT t.task_id, coalesce(f.status,'created') AS status, key, position, EXISTS (SELECT 1 FROM log l WHERE l.task_id=t.task_id AND l.status=key) AS hit
  FROM (SELECT DISTINCT task_id FROM req) t LEFT JOIN fin f USING (task_id), (VALUES ('observing',0),('analyzing',1),('executing',2),('verifying',3)) s(key, position)),
w AS (SELECT *, max(CASE WHEN hit THEN position END) OVER (PARTITION BY task_id) AS last FROM st)
SELECT task_id, key, CASE WHEN NOT hit AND status IN ('succeeded','failed','cancelled','interrupted') THEN 'absent' WHEN NOT hit THEN 'pending'
  WHEN position=last AND status IN ('failed','cancelled','interrupted') THEN 'failed' ELSE 'reached' END AS state FROM w""")
def trace_steps(spark, d):
    return T.trace_steps(T.lifecycle_state(requests(spark, d), ["ts", "event_id"])).select("task_id", "key", "state")


def artifacts(spark, d):
    """Registered files of every task, from its events; some contents are malformed on purpose."""
    per = requests(spark, d).groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    t = F.col("task_id")
    report = F.when(t % 5 == 0, F.lit("{")).otherwise(F.to_json(F.struct(
        F.lit("succeeded").alias("status"), F.col("bought").alias("count"),
        F.when(t % 3 == 0, F.lit("two")).otherwise(F.lit("")).alias("pages"), F.lit("complete").alias("completeness"),
        F.col("n").alias("model_calls"), F.lit(1.5).alias("elapsed_seconds"))))
    plan = F.when(t % 4 == 0, F.lit('{"fields":["id"]}')).otherwise('{"fields":{"amount":"/a","id":"/i"}}')
    retrieval = F.to_json(F.struct(F.lit(True).alias("enabled"), F.lit("BM25Okapi").alias("algorithm"), F.struct((t % 2 == 0).alias("applied")).alias("gate"),
                                   F.array(F.struct(F.lit("page_items").alias("id")), F.struct(F.format_string("case_%d", t).alias("id"))).alias("cases")))
    evidence = F.to_json(F.array_repeat(F.struct(F.lit("r").alias("request_id")), (t % 6).cast("int")))
    files = F.array(*[F.struct(F.lit(n).alias("filename"), c.alias("content")) for n, c in (
        ("report.json", report), ("plan.json", plan), ("retrieval.json", retrieval), ("evidence.json", evidence))])
    return per.select("task_id", F.inline(files)).withColumn("sha256", F.sha2("content", 256)).withColumn(
        "size_bytes", F.octet_length("content").cast("bigint"))


@query("trace_join", LIFE + """
, fin AS (SELECT task_id, arg_max(status, rn) AS status FROM log GROUP BY 1),
per AS (SELECT task_id, count(*) AS n, count(*) FILTER (event_type='purchase') AS bought FROM req GROUP BY 1)
SELECT task_id, coalesce(f.status,'created') AS status, CASE WHEN f.status IN ('succeeded','failed','cancelled','interrupted') THEN 'terminal' ELSE 'running' END AS phase,
  CASE WHEN task_id%5=0 THEN -1 ELSE bought END AS count, CASE WHEN task_id%5=0 THEN -1 ELSE n END AS model_calls, CAST(-1 AS BIGINT) AS pages,
  CASE WHEN task_id%5=0 THEN '' ELSE 'complete' END AS completeness,
  CASE WHEN NOT EXISTS (SELECT 1 FROM log l WHERE l.task_id=per.task_id AND l.status='analyzing') THEN '' WHEN task_id%4=0 THEN '' ELSE 'amount,id' END AS plan_fields,
  CASE WHEN NOT EXISTS (SELECT 1 FROM log l WHERE l.task_id=per.task_id AND l.status='analyzing') THEN '' ELSE 'page_items,case_' || task_id END AS case_ids,
  CAST(4 AS INTEGER) AS files FROM per LEFT JOIN fin f USING (task_id)""")
def trace_join(spark, d):
    req = requests(spark, d)
    tasks = req.groupBy("task_id").agg(F.min("ts").cast("string").alias("created_at")).withColumn("model", F.lit("m"))
    view = T.trace_view(tasks, T.lifecycle_state(req, ["ts", "event_id"]), artifacts(spark, d))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return view.select(
        "task_id", "status", "phase", F.coalesce("outcome.count", F.lit(-1)).alias("count"), F.coalesce("model_calls", F.lit(-1)).alias("model_calls"),
        F.coalesce("outcome.pages", F.lit(-1)).alias("pages"), F.coalesce("outcome.completeness", F.lit("")).alias("completeness"),
        listed("evidence.analyzing.plan_fields").alias("plan_fields"), listed("evidence.analyzing.retrieval.case_ids").alias("case_ids"),
        F.size("artifacts").alias("files"))


@query("usage_rollup", """
SELECT user_id AS task_id, count(*) AS model_calls, CAST(coalesce(sum(CASE WHEN user_id%9=0 THEN NULL ELSE CAST(json_extract_string(props,'$.k') AS BIGINT) END), -1) AS BIGINT) AS input_tokens
FROM events GROUP BY 1""")
def usage_rollup(spark, d):
    tokens = F.when(F.col("user_id") % 9 != 0, F.get_json_object("props", "$.k").cast("bigint"))
    calls = I.table(spark, d, "events").select(F.col("user_id").alias("task_id"), tokens.alias("input_tokens"))
    return T.usage_rollup(calls).select("task_id", "model_calls", F.coalesce("input_tokens", F.lit(-1)).alias("input_tokens"))


@query("result_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 25 OFFSET 50")
def result_page(spark, d):
    return T.result_page(I.table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 3, 25)


@query("list_recent", "SELECT event_id, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def list_recent(spark, d):
    return T.list_recent(I.table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 2, 20).select("event_id", "total")


@query("events_after", REQ + "SELECT task_id, event_id, rn AS seq FROM req WHERE rn>10 AND rn<=110")
def events_after(spark, d):
    numbered = T.event_sequence(requests(spark, d), ["ts", "event_id"], hour())
    return T.events_after(numbered, 10).select("task_id", "event_id", "seq")


@query("first_n_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn<=30")
def first_n_per_group(spark, d):
    """Thirty per group: Spark's group limit keeps thirty per task before the shuffle."""
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return I.table(spark, d, "documents").select("source", "doc_id", rank.alias("rn")).filter("rn <= 30").drop("rn")


@query("turn_pages", """
SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1)//3+1 AS BIGINT) AS page_no FROM conversations""")
def turn_pages(spark, d):
    turns = sequence_numbers(I.table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000), "rn")
    return turns.select("conv_id", "turn", (F.floor((F.col("rn") - 1) / 3) + 1).alias("page_no"))
