"""Page and record checks as pages arrive, in any order, with the state of every source in the state store.

What a page tells on its own (types, faults of single records, totals) is worked out on the stream with column expressions, so bodies
never reach the state. The state of a source holds its next page number, running count, last total, first field types, the keys
seen so far and the pages that wait for one before them. A batch reads and writes what its own pages need, nothing of the history.

A key of the state costs a batch of rows each way and each call a round trip to the JVM, so sources are dealt into blocks that share a key, and
a source is read in one call and written in another, with its first keys and waiting pages. Timers belong to keys: sources that silence
can close are keys on their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.collect import LIMIT, SCALARS, STOP, _read_body, _sample_code, first_match
from ..plans.specs import FIELD_TYPES, ExtractionPlan, FieldSpec

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

SUMMARY = ("status string, error_code string, error_page int, count bigint, pages bigint, expected_total bigint, completeness string, "
           "record_limit_reached boolean, waiting bigint, closed boolean")

EMPTY = ("missing", "null")

#: Keys of the state that sources are dealt over. Part of the stored state: a checkpoint goes on only with the number it began with.
BLOCKS = 1024
#: Keys and waiting pages that are read and written with their source; further ones have entries of their own.
HELD_KEYS, HELD_PAGES = 256, 64


def _rules(names: list[str], optional: set[str], specs: tuple[FieldSpec, ...]) -> dict[str, int]:
    """Number of every record check, in the order in which the first one decides."""
    order = [f"missing {n}" for n in names if n not in optional]
    order += [f"{kind} {n}" for n in names for kind in ("type", "finite")]
    order += ["key", "duplicate"] + [f"{kind} {s.name}" for s in specs for kind in (("required", "spec") if s.required else ("spec",))]
    return {rule: k for k, rule in enumerate([*order, "limit"])}


def page_facts(pages: DataFrame, plan: ExtractionPlan | DataFrame, names: list[str] | None = None, specs: tuple[FieldSpec, ...] = (),
               carry: tuple[str, ...] = ()) -> DataFrame:
    """``source_id``, ``page_no``, ``facts`` (JSON) of every page, all a check needs of it without the other pages, and the carried columns."""
    names = list(plan.fields) if isinstance(plan, ExtractionPlan) else list(names)
    optional = {s.name for s in specs if not s.required}
    number = _rules(names, optional, specs)
    df = _read_body(pages.where("page_no >= 1").select("source_id", "page_no", "body", *carry), names, plan)
    items = F.coalesce("_items", F.array().cast(df.schema["_items"].dataType))
    first = F.get(F.col("_items"), F.lit(0))
    required = [i for i, n in enumerate(names) if n not in optional]
    sample = F.when(F.col("request_id").isNull(), F.lit("unknown_request_id")).when(
        F.col("reject").isNull() & (F.col("page_no") == 1),
        _sample_code(F.col("_node"), F.col("_items"), first, F.col("_total.t"), F.col("_more.t"), F.col("total_pointer"), F.col("has_next_pointer"), required))

    def fault(item: Column, place: Column) -> Column:
        key = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), item[i])]), F.col("unique_key"))
        found = []
        for i, n in enumerate(names):
            tag, text = item[i]["t"], item[i]["s"]
            if n not in optional:
                found.append((tag == "missing", f"missing {n}", "pointer_not_found"))
            found.append(((tag == "number") & text.isin("Infinity", "-Infinity", "NaN"), f"finite {n}", "non_finite_number"))
        found.append((~key["t"].isin("integer", "string") | (key["s"] == ""), "key", "invalid_unique_key"))
        for s in specs:
            tag = item[names.index(s.name)]["t"]
            if s.required:
                found.append((tag.isin(*EMPTY), f"required {s.name}", "required_field_missing"))
            found.append((~tag.isin(*EMPTY) & ~tag.isin(*FIELD_TYPES[s.type]), f"spec {s.name}", "requested_field_type_mismatch"))
        return F.array_min(F.filter(F.array(*[F.when(c, F.struct(place.alias("pos"), F.lit(number[rule]).alias("check"), F.lit(code).alias("code")))
                                              for c, rule, code in found]), lambda e: e.isNotNull()))

    def first_places(i: int) -> Column:
        """(type, first position) of every type that field ``i`` has on the page."""
        tags = F.transform(items, lambda x: x[i]["t"])
        return F.transform(F.array_distinct(tags), lambda t: F.struct(t.alias("t"), (F.array_position(tags, t) - 1).alias("pos")))

    total = F.when(F.col("total_pointer").isNotNull() & (F.col("_total.t") == "integer"), F.col("_total.s").try_cast("bigint"))
    keys = F.transform(items, lambda x: F.element_at(F.create_map(*[v for i, n in enumerate(names) for v in (
        F.lit(n), F.concat(x[i]["t"], F.lit(":"), F.coalesce(x[i]["s"], F.lit(""))))]), F.col("unique_key")))
    facts = F.struct(
        F.when(F.col("reject") != "expected_object_or_list", F.col("reject")).alias("reject"), (F.col("_node") == "missing").alias("no_node"),
        F.col("_items").isNull().alias("no_list"), F.size(items).alias("n"), sample.alias("sample"), total.alias("total"),
        F.when(F.col("total_pointer").isNotNull(), F.coalesce("_total.t", F.lit("missing"))).alias("total_type"),
        F.when(F.col("has_next_pointer").isNotNull(), F.coalesce("_more.t", F.lit("missing"))).alias("more_type"), F.col("_more.s").alias("more"),
        F.array_min(F.filter(F.transform(items, fault), lambda e: e.isNotNull())).alias("fault"),
        F.array(*[first_places(i) for i in range(len(names))]).alias("types"), keys.alias("keys"))
    return df.select("source_id", "page_no", F.to_json(facts).alias("facts"), *carry)


class Sources(StatefulProcessor):
    """Checks the pages of a source in order; pages ahead of their turn wait, a page that came before is not read again."""

    RUN = ("next int, count bigint, previous bigint, types array<string>, page int, code string, code_page int, total bigint, waiting bigint, closed boolean, alarm bigint")
    PARTS = tuple(c.split()[0] for c in RUN.split(", "))

    def __init__(self, names: list[str], optional: set[str], number: dict[str, int], max_pages: int | None, max_records: int | None, silence_ms: int | None):
        self.names, self.optional, self.number = names, optional, number
        self.max_pages, self.max_records, self.silence_ms = max_pages, max_records, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", self.RUN)
        self.pending = handle.getMapState("pending", "page int", "facts string")
        self.keys = handle.getMapState("keys", "key string", "page int")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        stored = self.run.get()  # None for a new source; each call of the state is a round trip to the JVM
        run = self._run(stored)
        if run["closed"]:
            return
        new: dict[int, str] = {}
        heard = None
        for r in rows:
            if self.silence_ms is not None:
                heard = r[3] if heard is None else max(heard, r[3])
            if self._inside(run, r.page_no) and (r.page_no not in new or r.facts < new[r.page_no]):
                new[r.page_no] = r.facts
        self._advance(run, new)
        if not run["closed"] and self.silence_ms is not None:
            if run["alarm"] is not None:
                self.handle.deleteTimer(run["alarm"])
            run["alarm"] = max(int(heard.timestamp() * 1000) + self.silence_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(run["alarm"])
        self.run.update(tuple(run.values()))
        if run["page"]:
            yield self._summary(key, run)

    def _run(self, stored: Iterable | None) -> dict:
        """The state of a source by name; that of a new one where nothing is stored."""
        return dict(zip(self.PARTS, stored or (1, 0, None, [None] * len(self.names), 0, None, None, None, 0, False, None), strict=True))

    def _inside(self, run: dict, page: int) -> bool:
        return page >= run["next"] and (self.max_pages is None or page <= self.max_pages)

    def _advance(self, run: dict, new: dict[int, str]) -> None:
        """Check the pages whose turn it is; the others wait."""
        while not run["closed"]:
            facts = new.pop(run["next"], None)
            if run["waiting"] and self.pending.containsKey((run["next"],)):
                facts = self.pending.getValue((run["next"],))[0]  # the one that came first
                self.pending.removeKey((run["next"],))
                run["waiting"] -= 1
            if facts is None:
                break
            self._check(run, json.loads(facts))
        if run["closed"]:
            self._forget(run)
            return
        for page, facts in new.items():
            if not self.pending.containsKey((page,)):
                self.pending.updateValue((page,), (facts,))
                run["waiting"] += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A source that was silent for too long is closed as it stands; pages behind a gap never count."""
        run = self._run(self.run.get())
        run["closed"], run["alarm"] = True, None
        self._forget(run)
        self.run.update(tuple(run.values()))
        if run["page"]:
            yield self._summary(key, run)

    def _forget(self, run: dict) -> None:
        if run["waiting"]:
            self.pending.clear()
        if run["next"] > 2 or run["code"] is None:  # a page that ends its source has left no keys, pages before it have
            self.keys.clear()
        run["waiting"] = 0
        if run["alarm"] is not None:
            self.handle.deleteTimer(run["alarm"])
            run["alarm"] = None

    def _check(self, run: dict, f: dict) -> None:
        """The next page in order: its earliest event closes the source."""
        get, page = f.get, run["next"]
        total, count = get("total"), run["count"] + f["n"]
        events = []
        if page == 1 and get("sample"):
            events.append((-1, 0, 0, get("sample")))
        if (code := self._page_code(run, f, total)) is not None:
            events.append((0, 0, 0, code))
        events += self._record_events(run, f)
        if (code := self._end_code(f, total, count)) is not None:
            events.append((2, 0, 0, code))
        run.update(page=page, next=page + 1, total=total, previous=total)
        if not events:
            run["count"] = count
            return
        stage, pos, _, code = min(events)
        run.update(code=code, code_page=0 if stage < 0 else page, closed=True, count=count if code == STOP else run["count"] + pos + 1 if code == LIMIT else 0)

    @staticmethod
    def _page_code(run: dict, f: dict, total) -> str | None:
        kind = f.get("total_type")
        if f.get("reject"):
            return f["reject"]
        if f["no_node"] or f["no_list"]:
            return "pointer_not_found" if f["no_node"] else "items_not_list"
        if kind == "missing":
            return "pointer_not_found"
        if kind is not None and (kind != "integer" or (total is not None and total < 0)):
            return "invalid_total"
        return "total_changed" if kind is not None and None not in (total, run["previous"]) and total != run["previous"] else None

    @staticmethod
    def _end_code(f: dict, total, count: int) -> str | None:
        flag, has_total = f.get("more_type"), f.get("total_type") is not None
        if flag is None:
            more = f["n"] > 0 and (total is None or count < total)
        else:
            more = f.get("more") == "true" if flag == "boolean" else None
        if has_total and total is not None and count > total:
            return "too_many_items"
        if flag is not None and flag != "boolean":
            return "pointer_not_found" if flag == "missing" else "invalid_has_next"
        if more:
            return "empty_page_with_next" if not f["n"] else None
        return "incomplete_items" if has_total and total is not None and count != total else STOP

    def _record_events(self, run: dict, f: dict) -> list[tuple[int, int, int, str]]:
        events = []
        if f.get("fault"):
            events.append((1, f["fault"]["pos"], f["fault"]["check"], f["fault"]["code"]))
        types = list(run["types"])
        for i, (name, places) in enumerate(zip(self.names, f["types"], strict=True)):
            here = {p["t"]: p["pos"] for p in places}
            kept = {t: pos for t, pos in here.items() if t not in EMPTY}
            if types[i] is None and kept:
                types[i] = min(kept, key=kept.get)
            wrong = [pos for t, pos in (kept if name in self.optional else here).items() if t not in SCALARS or t != types[i]]
            if wrong:
                events.append((1, min(wrong), self.number[f"type {name}"], "field_type_changed"))
        run["types"] = types
        seen: set[str] = set()
        for pos, key in enumerate(f["keys"]):
            if key in seen or (run["next"] > 1 and self.keys.containsKey((key,))):
                events.append((1, pos, self.number["duplicate"], "duplicate_id"))
                break
            seen.add(key)
        if self.max_records is not None and run["count"] + f["n"] >= self.max_records:
            events.append((1, self.max_records - 1 - run["count"], self.number["limit"], LIMIT))
        flag = f.get("more_type")
        if not events and (f.get("more") == "true" if flag is not None else f["n"] > 0):  # else this page ends the source
            for key in seen:
                self.keys.updateValue((key,), (run["next"],))
        return events

    def _summary(self, key, run: dict) -> Row:
        code = run["code"]
        good = code in (None, STOP, LIMIT)
        complete = None if not good else "partial" if code != STOP else "complete" if run["total"] is not None else "stop_condition_only"
        return Row(source_id=key[0], status="succeeded" if good else "failed", error_code=None if good else code, error_page=None if good else run["code_page"],
                   count=run["count"], pages=run["page"] if good else run["code_page"], expected_total=run["total"] if good else None,
                   completeness=complete, record_limit_reached=code == LIMIT, waiting=run["waiting"], closed=run["closed"])


class Entries:
    """A map of one source of a block: its first ``most`` entries are held with the source, further ones have entries of their own.

    ``rows`` (source, name) holds those, ``lists`` (source, number) their names, one list for every turn of the source that added any, so that ``clear`` finds them.
    """

    def __init__(self, rows, lists, most: int):
        self.rows, self.lists, self.most = rows, lists, most

    def open(self, source, held: dict, count: int) -> None:
        self.source, self.held, self.count, self.added = source, held, count, []

    def close(self) -> tuple[dict, int]:
        """What to hold with the source, and the number of its lists."""
        if self.added:
            self.lists.updateValue((self.source, self.count), (json.dumps(self.added),))
            self.count, self.added = self.count + 1, []
        return self.held, self.count

    def _further(self) -> bool:
        return self.count > 0 or bool(self.added)

    def containsKey(self, key: tuple) -> bool:
        return str(key[0]) in self.held or (self._further() and self.rows.containsKey((self.source, str(key[0]))))

    def getValue(self, key: tuple) -> tuple:
        name = str(key[0])
        return (self.held[name],) if name in self.held else tuple(self.rows.getValue((self.source, name)))

    def updateValue(self, key: tuple, value: tuple) -> None:
        name = str(key[0])
        if name in self.held or len(self.held) < self.most and not (self._further() and self.rows.containsKey((self.source, name))):
            self.held[name] = value[0]
        else:
            self.rows.updateValue((self.source, name), (str(value[0]),))
            self.added.append(name)

    def removeKey(self, key: tuple) -> None:
        name = str(key[0])
        if self.held.pop(name, None) is None:
            self.rows.removeKey((self.source, name))

    def clear(self) -> None:
        for name in self.added:
            self.rows.removeKey((self.source, name))
        for k in range(self.count):
            for name in json.loads(self.lists.getValue((self.source, k))[0]):
                self.rows.removeKey((self.source, name))
            self.lists.removeKey((self.source, k))
        self.held, self.count, self.added = {}, 0, []


class Blocks(Sources):
    """``Sources`` where many of them share a key of the state; for sources that end by their pages alone."""

    def __init__(self, kind: str, *rules):
        super().__init__(*rules, None)
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = f"source {self.kind}"
        part = lambda name, most: Entries(handle.getMapState(name, f"{one}, name string", "value string"),
                                          handle.getMapState(f"{name}_lists", f"{one}, number int", "names string"), most)
        self.runs = handle.getMapState("runs", one, "run string")
        self.keys, self.pending = part("keys", HELD_KEYS), part("pending", HELD_PAGES)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        sources: dict = {}
        for source, page, facts, _ in rows:
            pages = sources.setdefault(source, {})
            if page not in pages or facts < pages[page]:
                pages[page] = facts
        for source, pages in sources.items():
            stored = self.runs.getValue((source,))
            run, keys, pending = json.loads(stored[0]) if stored else (None, ({}, 0), ({}, 0))
            run = self._run(run)
            if run["closed"]:
                continue
            self.keys.open(source, *keys)
            self.pending.open(source, *pending)
            self._advance(run, {page: facts for page, facts in pages.items() if self._inside(run, page)})
            self.runs.updateValue((source,), (json.dumps((list(run.values()), self.keys.close(), self.pending.close())),))
            if run["page"]:
                yield self._summary((source,), run)

    def _forget(self, run: dict) -> None:
        self.pending.clear()  # no call where nothing has an entry of its own; lists of pages that had their turn are left otherwise
        self.keys.clear()
        run["waiting"] = 0


def page_integrity(pages: DataFrame, plan: ExtractionPlan | DataFrame, names: list[str] | None = None, *, specs: tuple[FieldSpec, ...] = (),
                   max_pages: int | None = None, max_records: int | None = None, arrived: str | None = None, silence_ms: int | None = None) -> DataFrame:
    """The streaming summary of every source a batch touched: the columns of a batch run's summary, ``waiting`` (pages behind a gap)
    and ``closed`` (ended, failed, or silent).

    With ``arrived`` (a timestamp column) and ``silence_ms`` a source that had no page for that long, by the watermark, which lags by as
    much again, is closed as it stands; pages that arrive behind the watermark are not read then.
    Of a page that arrives twice the first one counts; of two in one batch the one whose facts sort first. Pages of a closed source are not read.
    """
    names = list(plan.fields) if isinstance(plan, ExtractionPlan) else list(names)
    optional = {s.name for s in specs if not s.required}
    rules = (names, optional, _rules(names, optional, specs), max_pages, max_records)
    kind = pages.schema["source_id"].dataType.simpleString()
    if silence_ms is not None:
        pages = pages.withWatermark(arrived, f"{silence_ms} milliseconds")
    # A batch may be few files: its pages are dealt over tasks before their bodies are read.
    pages = pages.repartition(2 * pages.sparkSession.sparkContext.defaultParallelism, "source_id")
    facts = page_facts(pages, plan, names, specs, (arrived,) if silence_ms is not None else ())
    if silence_ms is not None:
        return facts.groupBy("source_id").transformWithState(Sources(*rules, silence_ms), f"source_id {kind}, {SUMMARY}", "update", "eventTime")
    blocks = facts.withColumn("block", F.pmod(F.xxhash64("source_id"), F.lit(BLOCKS)).cast("int"))
    return blocks.groupBy("block").transformWithState(Blocks(kind, *rules), f"source_id {kind}, {SUMMARY}", "update", "none")
