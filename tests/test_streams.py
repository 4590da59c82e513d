"""Page checks with state: any arrival order, restarts, silence, against the batch run."""

import datetime
import json
import random

from evigrid.operators.collect import run_collection
from evigrid.plans.specs import ExtractionPlan, FieldSpec
from evigrid.streaming import jobs as ST
from evigrid.streaming.integrity import Blocks, Sources, _rules

PLAN = ExtractionPlan("req_001", "/items", {"sku": "/sku", "title": "/title", "amount": "/amount"}, "sku", has_next_pointer="/more", total_pointer="/total")
SCHEMA = "source_id long, page_no int, body string"
COLUMNS = ("status", "error_code", "error_page", "count", "pages", "expected_total", "completeness", "record_limit_reached")


def bodies(rng, n_pages):
    """Pages of a source, with one fault in most of them."""
    size, extra = rng.randrange(1, 4), rng.choice([0, 0, 0, 1, -1])
    rows = [{"sku": i, "title": f"t{i}", "amount": 1.5 * i} for i in range(1, n_pages * size + 1)]
    out = [{"items": rows[p * size:(p + 1) * size], "total": len(rows) + extra, "more": p + 1 < n_pages} for p in range(n_pages)]
    page, k = rng.choice(out), rng.randrange(14)
    fault = [lambda: page.update(total="x"), lambda: page.pop("total"), lambda: page.update(more=1), lambda: page.pop("more"), lambda: page.update(items={}),
             lambda: page.update(rows=page.pop("items")), lambda: page["items"].append(dict(rows[0])), lambda: page["items"][0].update(amount="9"),
             lambda: page["items"][-1].pop("title"), lambda: page["items"][0].update(sku=""), lambda: page.update(total=-2), lambda: page.update(items=[], more=True),
             lambda: page["items"][0].update(title=None)]
    if k < len(fault):
        fault[k]()
    texts = [json.dumps(b) for b in out]
    if rng.random() < 0.1:
        texts[rng.randrange(n_pages)] = rng.choice(["", "[1", "7", "null"])
    return texts


def streamed(spark, parts, out, options, per_batch=2):
    """Every part is written and processed by a run of its own, from the checkpoint of the one before."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(out + "/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(out + "/in")
        ST.page_integrity_stream(stream, PLAN, None, out + "/state", out + "/cursor", **options)
    return {r.source_id: r for r in ST.latest(spark, out + "/state", "source_id").collect()}


def test_any_order_and_restarts_equal_batch(spark, tmp_path):
    for seed, options in ((1, {}), (2, {"specs": (FieldSpec("sku", "integer"), FieldSpec("title", "string", False)), "max_records": 5, "max_pages": 4})):
        rng = random.Random(seed)
        rows = []
        for source in range(120):
            texts = bodies(rng, rng.randrange(1, 7))
            gone = rng.randrange(1, 8)  # some sources have a gap
            rows += [(source, p + 1, t) for p, t in enumerate(texts) if rng.random() < 0.9 or p + 1 != gone]
        rng.shuffle(rows)
        third = len(rows) // 3
        parts = [rows[:third], rows[third:2 * third] + rows[:20], rows[2 * third:]]  # some pages come twice
        got = streamed(spark, parts, str(tmp_path / str(seed)), options)
        want = {r.source_id: r for r in run_collection(spark.createDataFrame(rows, SCHEMA), PLAN, **options).summary.collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert [got[k][c] for c in COLUMNS] == [r[c] for c in COLUMNS], (k, [x for x in sorted(rows) if x[0] == k])


def test_pages_wait_and_silent_sources_end(spark, tmp_path):
    rows = [{"sku": i, "title": "t", "amount": 1} for i in range(1, 7)]
    page = lambda at, p: (1, p, json.dumps({"items": rows[2 * p - 2:2 * p], "total": 6, "more": p < 3}), datetime.datetime(2026, 1, 1, 0, at))
    other = lambda at, p: (2, p, json.dumps({"items": rows[p - 1:p], "total": 6, "more": True}), datetime.datetime(2026, 1, 1, 0, at))
    out, schema = str(tmp_path), SCHEMA + ", arrived timestamp"
    seen = []
    for part in ([page(0, 1), page(0, 3), other(0, 1)], [other(30, 2)], [page(31, 2), other(31, 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(out + "/in")
        stream = spark.readStream.schema(schema).parquet(out + "/in")
        ST.page_integrity_stream(stream, PLAN, None, out + "/state", out + "/cursor", arrived="arrived", silence_ms=600_000)
        seen.append({r.source_id: r for r in ST.latest(spark, out + "/state", "source_id").collect()})
    view = [[(k, r["count"], r.waiting, r.closed, r.completeness) for k, r in sorted(s.items())] for s in seen]
    assert view == [[(1, 2, 1, False, "partial"), (2, 1, 0, False, "partial")], [(1, 2, 0, True, "partial"), (2, 2, 0, False, "partial")],
                    [(1, 2, 0, True, "partial"), (2, 3, 0, False, "partial")]]


def test_a_closed_source_leaves_no_state():
    """Keys and waiting pages are dropped where there are any, by the last page or by silence; nothing else is asked of the state."""
    class Part:
        def __init__(self, value=None):
            self.value, self.calls = value, 0

        def get(self):
            return self.value

        def clear(self):
            self.calls += 1

    def forgets(page, waiting, code):
        p = Sources(["id"], set(), {}, None, None, None)
        p.pending, p.keys = Part(), Part()
        run = {"next": page + 1, "waiting": waiting, "code": code, "alarm": None}
        p._forget(run)
        assert run["waiting"] == 0
        return p.pending.calls, p.keys.calls

    assert forgets(1, 0, "stop") == (0, 0)
    assert forgets(2, 0, "stop") == (0, 1) and forgets(1, 3, "invalid_total") == (1, 0)
    assert forgets(1, 2, None) == (1, 1)  # silent after its first page


class Shared(dict):
    """A map of the state that counts its calls."""
    calls = 0

    def getValue(self, key):
        Shared.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        Shared.calls += 1
        self[key] = value

    def containsKey(self, key):
        Shared.calls += 1
        return key in self

    def removeKey(self, key):
        Shared.calls += 1
        self.pop(key, None)


class Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, Shared())


def facts(page, last, key=None):
    return json.dumps({"no_node": False, "no_list": False, "n": 3, "total": 3 * last, "total_type": "integer", "more_type": "boolean", "more": str(page < last).lower(),
                       "types": [[{"t": "integer", "pos": 0}]], "keys": [f"integer:{3 * page + i}" for i in range(2)] + [key or f"integer:{3 * page + 2}"]})


def block(batches):
    """(newest summary per source, maps left, calls per batch) of batches of (source, page, facts) that share one block."""
    handle, latest, calls = Handle(), {}, []
    for rows in batches:
        p = Blocks("bigint", ["id"], set(), _rules(["id"], set(), ()), None, None)
        p.init(handle)
        Shared.calls = 0
        latest |= {r.source_id: r for r in p.handleInputRows((7,), [(*r, 7) for r in rows], None)}
        calls.append(Shared.calls)
    return latest, {k: v for k, v in handle.maps.items() if v and k != "runs"}, calls


def test_a_source_of_a_block_costs_two_calls():
    pages = [(s, p) for s in range(50) for p in range(1, 6)]
    batches = [[(s, p, facts(p, 5)) for s, p in pages if p % 2 == k] for k in (0, 1)]
    latest, left, calls = block(batches)
    assert {(r["count"], r.pages, r.completeness, r.closed, r.waiting) for r in latest.values()} == {(15, 5, "complete", True, 0)} and len(latest) == 50
    assert calls == [100, 100] and not left


def test_long_sources_keep_entries_of_their_own(monkeypatch):
    """Keys and waiting pages beyond those held with their source are found again, and dropped when it ends."""
    from evigrid.streaming import integrity as G

    rng = random.Random(3)
    for held_keys, held_pages in ((0, 0), (4, 2), (256, 64)):
        monkeypatch.setattr(G, "HELD_KEYS", held_keys)
        monkeypatch.setattr(G, "HELD_PAGES", held_pages)
        rows = [(s, p, facts(p, 8, "integer:4" if s == 2 and p == 7 else None)) for s in range(4) for p in range(1, 9) if (s, p) != (3, 6)]
        rng.shuffle(rows)
        rows = [r for r in rows if r[:2] != (1, 1)] + [r for r in rows if r[:2] == (1, 1)]
        latest, left, _ = block([rows[k:k + 5] for k in range(0, len(rows), 5)])
        got = {s: (r.status, r.error_code, r["count"], r.waiting, r.closed) for s, r in latest.items()}
        assert got == {0: ("succeeded", None, 24, 0, True), 1: ("succeeded", None, 24, 0, True), 2: ("failed", "duplicate_id", 0, 0, True),
                       3: ("succeeded", None, 15, 2, False)}
        assert {k[0] for m in left.values() for k in m} == ({3} if held_keys < 15 else set())
