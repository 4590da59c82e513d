"""Task lifecycle: state machine, timeline, durations and the joined trace view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import as_array, as_object, as_text, pointer_get, type_tag
from .paging import page_index
from .windows import previous_values, sequence_numbers

# The lifecycle vocabulary in order.
STAGES = ("created", "observing", "analyzing", "executing", "verifying")
TERMINAL = ("succeeded", "failed", "cancelled", "interrupted")
CANCELLING = "cancelling"
STATUSES = (*STAGES, CANCELLING, *TERMINAL)
# Files a task may register, one of each.
ARTIFACT_NAMES = ("evidence.json", "cloud_payload.json", "plan.json", "result.json", "report.json", "report.md", "retrieval.json",
                  "collector.py", "collector_result.json", "collector_verification.json", "repair.json", "failure_retrieval.json")


def first_occurrences(requests: DataFrame, order: list[str], task: str = "task_id") -> DataFrame:
    """One row per task: the first request of every status. Ten minima, combined before the
    shuffle, so a task with very many requests stays cheap."""
    at = F.struct(*order)
    return requests.groupBy(task).agg(*[F.min(F.when(F.col("status") == s, at)).alias(s) for s in STATUSES])


def lifecycle_state(requests: DataFrame, order: list[str], task: str = "task_id") -> DataFrame:
    """Accepted transitions of the monotone state machine: (task, status, timeline).

    The first terminal request ends the task. After ``cancelling`` only that end counts, as
    cancelled unless interrupted. Before, a stage is entered only when no later stage was
    entered earlier, so first occurrences alone decide. ``timeline`` is an ordered array of (at, status).
    """
    firsts = first_occurrences(requests, order, task)
    end = F.least(*[F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("at"), F.lit(s).alias("status"))) for s in TERMINAL])
    df = firsts.withColumn("_end", end)
    alive = lambda c: F.col(c).isNotNull() & (F.col("_end").isNull() | (F.col(c) < F.col("_end.at")))
    df = df.withColumn("_cancel", F.when(alive(CANCELLING), F.col(CANCELLING)))
    entries = []
    for i, stage in enumerate(STAGES):
        # A stage counts when it opens the task or follows only lower stages.
        ok = alive(stage) & (F.col("_cancel").isNull() | (F.col(stage) < F.col("_cancel")))
        for later in STAGES[i + 1:]:
            ok = ok & (F.col(later).isNull() | (F.col(stage) < F.col(later)))
        entries.append(F.when(ok, F.struct(F.col(stage).alias("at"), F.lit(stage).alias("status"))))
    entries.append(F.when(F.col("_cancel").isNotNull(), F.struct(F.col("_cancel").alias("at"), F.lit(CANCELLING).alias("status"))))
    final = F.when(F.col("_cancel").isNotNull() & (F.col("_end.status") != "interrupted"), "cancelled").otherwise(F.col("_end.status"))
    entries.append(F.when(F.col("_end").isNotNull(), F.struct(F.col("_end.at").alias("at"), final.alias("status"))))
    timeline = F.sort_array(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    df = df.withColumn("timeline", timeline)
    newest = F.try_element_at(F.transform("timeline", lambda e: e["status"]), F.lit(-1))
    return df.select(task, F.coalesce(newest, F.lit("created")).alias("status"), "timeline")


def event_log(lifecycle: DataFrame, task: str = "task_id") -> DataFrame:
    """Accepted transitions as rows: (task, seq, status, at)."""
    rows = lifecycle.select(task, F.posexplode("timeline").alias("p", "e"))
    return rows.select(task, (F.col("p") + 1).alias("seq"), F.col("e.status").alias("status"), F.col("e.at").alias("at"))


def event_sequence(events: DataFrame, order: list[str], chunk: Column, task: str = "task_id") -> DataFrame:
    return sequence_numbers(events, [task], order, chunk, "seq")


def stage_durations(events: DataFrame, order: list[str], ts: str, chunk: Column, task: str = "task_id") -> DataFrame:
    """Seconds since the event before, for the first record of every status of a task.

    The task's very first event has no duration.
    """
    before = previous_values(events, [task], order, chunk, {ts: "_before"})
    seconds = F.bround((F.unix_micros(ts) - F.unix_micros("_before")) / 1e6, 3)
    return before.groupBy(task, "status").agg(F.min_by(seconds, F.struct(*order)).alias("duration_s"),
                                              F.min(F.struct(*order)).alias("first")).drop("first")


def trace_steps(lifecycle: DataFrame, task: str = "task_id") -> DataFrame:
    """State of each stage after ``created``: reached, failed, pending or absent, with its duration."""
    stages = STAGES[1:]
    terminal = F.col("status").isin(*TERMINAL)
    entered = F.transform("timeline", lambda e: e["status"])
    last = F.try_element_at(F.filter(F.array(*map(F.lit, stages)), lambda s: F.array_contains(entered, s)), F.lit(-1))
    df = lifecycle.withColumn("_last", last).withColumn("_terminal", terminal)
    step = lambda s: F.struct(F.lit(s).alias("key"), F.lit(stages.index(s)).alias("position"), F.when(
        ~F.array_contains(entered, s), F.when(F.col("_terminal"), "absent").otherwise("pending")).when(
        (F.col("_last") == s) & F.col("_terminal") & (F.col("status") != "succeeded"), "failed").otherwise("reached").alias("state"))
    return df.select(task, "status", F.inline(F.array(*[step(s) for s in stages])))


# ---------------------------------------------------------------- paging of task tables

def result_page(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of a result. For more than one page keep the ``page_index``."""
    return page_index(rows, order).page(page, size)


def list_recent(tasks: DataFrame, created: str, tie: str, page: int, size: int) -> DataFrame:
    """One page of the tasks, newest first, with their number as ``total``."""
    index = page_index(tasks, [F.desc(created), tie])
    return index.page(page, size).withColumn("total", F.lit(index.total).cast("bigint"))


def events_after(events: DataFrame, after: int, limit: int = 100) -> DataFrame:
    """Events past a cursor, ``limit`` per task: ``seq`` has no gaps, so this is a range filter."""
    return events.filter((F.col("seq") > after) & (F.col("seq") <= after + limit))


# ---------------------------------------------------------------- trace view

def _text(v: Column) -> Column:
    return F.when(type_tag(v) == "string", as_text(v))


def _integer(v: Column) -> Column:
    return F.when(type_tag(v) == "integer", as_text(v).try_cast("bigint"))


def _number(v: Column) -> Column:
    return F.when(type_tag(v).isin("integer", "number"), as_text(v).try_cast("double"))


def _boolean(v: Column) -> Column:
    return F.when(type_tag(v) == "boolean", as_text(v) == "true")


def trace_view(tasks: DataFrame, lifecycle: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One nested row per task; malformed or missing evidence becomes NULL.

    ``tasks``: task_id, model, created_at. ``lifecycle``: see ``lifecycle_state``. ``artifacts``:
    task_id, filename, sha256, size_bytes, content (JSON text); only the dozen registered names count, once each.
    """
    names = ("report.json", "plan.json", "evidence.json", "retrieval.json", "repair.json", "failure_retrieval.json", "result.json")
    one = artifacts.filter(F.col("filename").isin(*ARTIFACT_NAMES)).groupBy("task_id", "filename").agg(
        F.min(F.struct("sha256", "size_bytes", "content")).alias("f")).select("task_id", "filename", "f.*")
    docs = one.groupBy("task_id").agg(
        *[F.max(F.when(F.col("filename") == n, F.col("content"))).alias(n.split(".")[0]) for n in names],
        F.sort_array(F.collect_list(F.struct("filename", "sha256", "size_bytes"))).alias("artifacts"))
    df = tasks.join(lifecycle, "task_id", "left").join(docs, "task_id", "left")
    df = df.withColumns({n.split(".")[0]: F.try_parse_json(n.split(".")[0]) for n in names})
    doc = lambda n, p: pointer_get(F.col(n), p)
    report = lambda p: doc("report", "/" + p)
    count = lambda v: F.when(as_array(v).isNotNull(), F.size(as_array(v)))
    entered = F.transform("timeline", lambda e: e["status"])
    terminal = F.col("status").isin(*TERMINAL)
    ids = F.filter(F.transform(as_array(doc("retrieval", "/cases")), lambda c: _text(pointer_get(c, "/id"))), lambda i: i.isNotNull())
    observing = F.struct(_text(report("source")).alias("source"), count(F.col("evidence")).alias("observations"))
    analyzing = F.struct(_integer(report("model_calls")).alias("model_calls"),
                         F.map_keys(as_object(doc("plan", "/fields"))).alias("plan_fields"),
                         F.when(as_object(F.col("retrieval")).isNotNull(), F.struct(
                             _boolean(doc("retrieval", "/enabled")).alias("enabled"), _text(doc("retrieval", "/algorithm")).alias("algorithm"),
                             _boolean(doc("retrieval", "/gate/applied")).alias("gate_applied"),
                             F.coalesce(ids, F.array().cast("array<string>")).alias("case_ids"))).alias("retrieval"))
    executing = F.struct(F.coalesce(count(F.col("result")).cast("bigint"), _integer(report("count"))).alias("count"),
                         _integer(report("pages")).alias("pages"), _boolean(report("repair_attempted")).alias("repair_attempted"))
    verifying = F.struct(_text(report("completeness")).alias("completeness"), _integer(report("expected_total")).alias("expected_total"))
    reached = lambda s, v: F.when(F.array_contains(entered, s), v)
    outcome = F.struct(*[_text(report(n)).alias(n) for n in ("status", "completeness", "error", "error_type", "error_category")],
                       *[_integer(report(n)).alias(n) for n in ("count", "pages", "expected_total")],
                       _boolean(report("error_repairable")).alias("error_repairable"))
    repair = F.struct(_boolean(report("repair_attempted")).alias("attempted"), _integer(report("repair_count")).alias("count"),
                      _text(report("repair_outcome")).alias("outcome"), _boolean(report("repair_applied")).alias("applied"),
                      F.when(count(doc("repair", "/attempts")).isNotNull() & count(doc("repair", "/proposals")).isNotNull(), F.struct(
                          count(doc("repair", "/attempts")).alias("attempts"), count(doc("repair", "/proposals")).alias("proposals"))).alias("document"))
    fr = lambda p: doc("failure_retrieval", p)
    context = F.when(as_object(fr("/failure_context")).isNotNull(), F.struct(*[
        _text(fr(f"/failure_context/{n}")).alias(n) for n in ("error_code", "category", "phase")]))
    diagnosis = F.when(as_object(F.col("failure_retrieval")).isNotNull(), F.struct(
        _integer(fr("/schema_version")).alias("schema_version"), _text(fr("/failure_phase")).alias("failure_phase"),
        context.alias("failure_context"),
        F.coalesce(F.filter(F.transform(as_array(fr("/case_ids")), _text), lambda i: i.isNotNull()),
                   F.array().cast("array<string>")).alias("case_ids"),
        _boolean(fr("/knowledge_gate/applied")).alias("knowledge_gate_applied")))
    return df.select(
        F.lit(1).alias("trace_schema_version"), "task_id", "status", F.when(terminal, "terminal").otherwise("running").alias("phase"),
        _text(report("source")).alias("source"), "model", _integer(report("model_calls")).alias("model_calls"),
        _number(report("elapsed_seconds")).alias("elapsed_seconds"), (F.coalesce(F.size("timeline"), F.lit(0)) > 0).alias("timeline_available"),
        "created_at", "timeline", F.struct(
            reached("observing", observing).alias("observing"), reached("analyzing", analyzing).alias("analyzing"),
            reached("executing", executing).alias("executing"), reached("verifying", verifying).alias("verifying")).alias("evidence"),
        outcome.alias("outcome"), repair.alias("repair"), diagnosis.alias("failure_retrieval"),
        F.coalesce("artifacts", F.array().cast("array<struct<filename:string,sha256:string,size_bytes:bigint>>")).alias("artifacts"))


def usage_rollup(calls: DataFrame, task: str = "task_id") -> DataFrame:
    """Model calls and tokens per task; a task whose usage is unknown stays NULL, not 0."""
    parts = ("input_tokens", "output_tokens", "cache_hit_tokens", "cache_miss_tokens")
    return calls.groupBy(task).agg(F.count("*").alias("model_calls"), *[F.sum(c).alias(c) for c in parts if c in calls.columns])
