"""Live traces span by span: keyed state hands a span on as soon as nothing that is
still to come can change it, and holds only what is open.

Two feeds meet per stream: build events and execution-log lines, each numbered
without gaps. Within a stream they are taken in the order of their numbers, so
shuffled or repeated arrival changes nothing; a gap waits until it is filled or the
stream is over. What the state holds:

- target and action entries by key (MapState): whether a target is known, the first
  and last of the children that went out, the actions that spawns can still meet;
- output ids and what they stand for now (MapState): an entry counts for the spawns
  after it, a later one of the same id replaces it;
- spawns that wait for their action, by their best candidate (MapState);
- the events that only the end of the build decides: targets, file sets, the root.

Each of these with few entries stands on a page beside the stream's own entry, so a
small stream meets the store once a batch, whatever it holds.

Handed on at once: fetches; tests and actions whose target is known (actions of an
invocation with an execution log stay open until it is over, for their spawns);
spawns whose best candidate is a known action, whichever of the two came first.
At the end (last message and drain time, a new start, or idle time) the rest goes
out together with a few rows that tell what already went, and the batch operators
build it. A span is clamped by the invocation's end only if that was known before
it: batch with Options(clamp="as_of") gives the same rows.

A log counts if an option names it, or with expect_log. What comes after the end
is told as `late`, as long as the stream is remembered."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import ids, labels
from ..operators import assemble, traces, typed
from ..sources import events as source
from ..sources import exec_log

#: What the processor hands on: phase is now, close, early or late; kind is event,
#: spawn, or whose child an early row tells; doc is JSON.
HANDED = T.StructType([T.StructField(n, t) for n, t in (("inv", T.StringType()), ("seq", T.LongType()), ("phase", T.StringType()), ("kind", T.StringType()), ("doc", T.StringType()))])
_DOC = (
    "raw string, event_time_ns bigint, uuid string, root_start bigint, config string, label string, start_ns bigint, end_ns bigint, "
    f"listed array<string>, actual {exec_log.FILES}, hash string, action struct<seq:bigint,label:string,mnemonic:string,output:string,start_ns:bigint,end_ns:bigint>, "
    "action_seq bigint, spawn_count bigint, told string, norm string, missed boolean"
)
#: What an entry stands for, as spawns are handed on with.
_STANDS = f"listed array<string>, actual {exec_log.FILES}, hash string"
_TOLD = "runner string, cache_hit boolean, remote_cacheable boolean, digest string"
#: Kinds of events that no span is built from.
_PASSED = (*source.IGNORED, "progress")


def numbered_events(stream: DataFrame) -> DataFrame:
    """file, seq, at, doc of build events (file, seq, at, raw and, if known,
    event_time_ns): the fields that decide, taken out in one pass."""
    kinds = {k: typed.KINDS[k][0][0] for k in ("started", "target_configured", "target_completed", "action_completed", "test_result", "configuration")}
    timed = stream if "event_time_ns" in stream.columns else stream.withColumn("event_time_ns", F.lit(None).cast("long"))
    parsed, _ = source.classify(timed)
    c = F.col

    def get(kind: str, name: str) -> Column:
        path, of = typed.KINDS[kind][1][name]
        return F.try_variant_get("v", path, of)

    def pick(name: str, *of: str) -> Column:
        return F.coalesce(*[F.when(c("event_type") == kinds[k], get(k, name)) for k in of])

    at = lambda kind: lambda n: c(n) if n == "event_time_ns" else get(kind, n)
    begins = {k: typed.times(k, at(k)) for k in ("started", "action_completed", "test_result")}
    start = F.coalesce(*[F.when(c("event_type") == kinds[k], x["start_ns"]) for k, x in begins.items()])
    test = begins["test_result"]
    end = F.when(c("event_type") == kinds["test_result"], test["start_ns"] + test["duration_ns"]).when(c("event_type") == kinds["action_completed"], begins["action_completed"]["end_ns"])
    listed = lambda n: F.coalesce(get("options_parsed", n), F.array().cast("array<string>"))
    options = F.concat(listed("cmd_line"), listed("explicit"))
    is_options = c("event_type") == "optionsParsed"
    label = pick("label", "target_configured", "target_completed", "action_completed", "test_result")
    doc = F.struct(
        F.lit("event").alias("what"), "raw", "event_time_ns", c("event_type").alias("type"), c("last_message").alias("last"), label.alias("label"), labels.normalize_label(F.coalesce(label, F.lit(""))).alias("norm"),
        F.coalesce(pick("mnemonic", "action_completed"), F.lit("")).alias("mnemonic"), F.coalesce(pick("output", "action_completed"), F.lit("")).alias("output"), pick("success", "action_completed").alias("success"), start.alias("start_ns"), end.alias("end_ns"),
        pick("uuid", "started").alias("uuid"), F.coalesce(pick("configuration", "action_completed"), pick("id", "configuration")).alias("config"), pick("mnemonic", "configuration").alias("name"),
        F.when(is_options, assemble.publishes_all(options)).alias("publishes"), F.when(is_options, F.exists(options, exec_log.names_log)).alias("logs"),
        ((c("event_type") == "buildFinished") | F.try_variant_get("v", f"$.buildMetrics{typed.METRICS['wall_time_ms'][1:]}", "bigint").isNotNull()).alias("ends"),
    )
    return parsed.select("file", "seq", "at", F.to_json(doc).alias("doc"))


def _told_of(log_id: str) -> tuple[Column, Column]:
    """The stream of a log and the number of its invocation."""
    return F.regexp_replace(log_id, "#[0-9]+$", ""), F.try_element_at(F.split(log_id, "#"), F.lit(-1)).try_cast("int")


def log_entries(stream: DataFrame) -> DataFrame:
    """inv, seq, doc and raw (of spawns) of execution-log lines (inv, seq, at, raw):
    what the outputs of a spawn are told by, and no more. The text of a spawn stands
    beside, so that it is neither written into JSON nor read out of it."""
    log, (files, path), (file, number) = exec_log.entries(stream), exec_log.stands_for(), _told_of("inv")
    spawn = F.col("kind") == "spawn"
    outs = F.try_variant_get("v", "$.spawn.outputs", "array<struct<outputId bigint, invalidOutputPath string>>")
    doc = F.struct("id", "kind", F.when(~spawn, files).alias("files"), F.when(~spawn, path).alias("path"), F.when(~spawn, F.try_variant_get("v", "$.invocation.hashFunctionName", "string")).alias("hash"), F.when(spawn, outs).alias("outs"))
    return log.select(F.concat_ws("#", file, number.cast("string")).alias("inv"), "seq", F.to_json(doc).alias("doc"), F.when(spawn, F.col("raw")).alias("raw"))


def numbered_entries(stream: DataFrame) -> DataFrame:
    """file, seq, at, doc of execution-log lines (inv, seq, at, raw)."""
    log, (files, path), (file, number) = exec_log.entries(stream), exec_log.stands_for(), _told_of("inv")
    get = lambda p, of="string": F.try_variant_get("v", p, of)
    spawn = F.col("kind") == "spawn"
    told = F.struct(get("$.spawn.runner").alias("runner"), F.coalesce(get("$.spawn.cacheHit", "boolean"), F.lit(False)).alias("cache_hit"), F.coalesce(get("$.spawn.remoteCacheable", "boolean"), F.lit(False)).alias("remote_cacheable"), get("$.spawn.digest.hash").alias("digest"))
    doc = F.struct(
        F.lit("entry").alias("what"), number.alias("number"), "id", "kind", F.when(~spawn, files).alias("files"), F.when(~spawn, path).alias("path"), F.when(spawn, F.col("raw")).alias("raw"),
        get("$.invocation.hashFunctionName").alias("hash"), get("$.spawn.outputs", "array<struct<outputId bigint, invalidOutputPath string>>").alias("outs"),
        F.when(spawn, labels.normalize_label(F.coalesce(get("$.spawn.targetLabel"), F.lit("")))).alias("norm"), F.when(spawn, F.coalesce(get("$.spawn.mnemonic"), F.lit(""))).alias("mnemonic"),
        F.when(spawn, F.to_json(told)).alias("told"), F.when(spawn, ~told["cache_hit"]).alias("missed"),
    )
    return log.select(file.alias("file"), "seq", "at", F.to_json(doc).alias("doc"))


_MISSING = object()
#: Entries of a map that stand on a page of its stream; larger ones go to the store.
_ON_PAGE = 64


class _Map:
    """A MapState of JSON values by text keys. What one call reads and writes is held
    until save(), so each key meets the store once, and a stream that begins (fresh)
    is not looked up at all; beyond `most` entries they are saved meanwhile.

    A map of few entries need not meet the store at all: its owner keeps page() with
    other such maps in one entry, and hands it back to begin()."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, most: int = 100_000) -> None:
        text = lambda n: T.StructType([T.StructField(n, T.StringType())])
        self.state, self.most = handle.getMapState(name, text("k"), text("v")), most
        self.begin()

    def begin(self, fresh: bool = False, page: dict | None = None) -> None:
        """A call for another key starts; fresh: the store holds nothing of it, and
        all there is stands on the page, if there is one."""
        self.held, self.changed, self.empty, self.whole = dict(page or {}), set(page or ()), fresh, fresh

    def page(self) -> dict | None:
        """All entries, if they are few and none is in the store; else None."""
        if not self.empty or len(self.held) > 2 * _ON_PAGE:
            return None
        there = dict(self.items())
        return there if len(there) <= _ON_PAGE else None

    def _load(self, key: str, new: bool = False):
        if key not in self.held:
            found = None if self.whole or new else self.state.getValue((key,))
            self.held[key] = _MISSING if found is None else json.loads(found[0])
        return self.held[key]

    def get(self, key, default=None, new: bool = False):
        """new: the store is known to have nothing under the key."""
        found = self._load(str(key), new)
        return default if found is _MISSING or found is None else found

    def put(self, key, value) -> None:
        self.held[str(key)] = value
        self.changed.add(str(key))
        if len(self.held) > self.most:
            self.save()

    def pop(self, key, default=None):
        value = self.get(key, default)
        if self.held[str(key)] is not _MISSING:
            self.held[str(key)] = _MISSING
            self.changed.add(str(key))
        return value

    def add(self, key, item) -> None:
        self.put(key, [*self.get(key, []), item])

    def items(self) -> list[tuple[str, object]]:
        if not self.whole:
            for k, v in self.state.iterator():
                self.held.setdefault(k[0], json.loads(v[0]))
            self.whole = True
        return [(k, v) for k, v in self.held.items() if v is not _MISSING]

    def clear(self) -> None:
        if not self.empty:
            self.state.clear()
        self.begin(fresh=True)

    def save(self) -> None:
        for key in self.changed:
            if self.held[key] is not _MISSING:
                self.state.updateValue((key,), (json.dumps(self.held[key]),))
            elif not self.empty:
                self.state.removeKey((key,))
        self.begin()


class _Log:
    """Output ids of one log and what they stand for: an entry before its use."""

    def __init__(self, ids) -> None:
        self.ids = ids

    def take(self, entry: dict) -> dict | None:
        """Keep an entry; of a spawn, what its outputs stand for, or None where one
        has no entry yet."""
        if entry.get("kind") != "spawn":
            if entry.get("id"):
                self.ids.put(entry["id"], [entry.get("path"), entry.get("files") or []])
            return None
        listed, actual = set(), []
        for out in entry.get("outs") or []:
            if out.get("invalidOutputPath") is not None:
                listed.add(out["invalidOutputPath"])
            if out.get("outputId") is None:
                continue
            known = self.ids.get(out["outputId"])
            if known is None:
                return None
            if out.get("invalidOutputPath") is None and known[0] is not None:
                listed.add(known[0])
            actual += known[1]
        return {"raw": entry.get("raw"), "listed": sorted(listed, key=lambda p: p.encode()), "actual": actual}

    def clear(self) -> None:
        self.ids.clear()


#: Log lines meet in this many groups by invocation, each with many small logs.
LOG_GROUPS = 4096
#: The small logs of a group are kept on this many pages.
_PAGES = 4
#: Ids of a log that stand on its page; those beyond have entries of their own.
_FEW = 16
#: Lines of a group that are taken at once.
_AT_ONCE = 50_000
#: Lines of a batch that may wait for others of it in memory, for each group.
_IN_MEMORY = 250_000


class _Ids:
    """What the ids of one log stand for: a few on its page, others in the store."""

    def __init__(self, inv: str, at: dict, store: _Map) -> None:
        self.inv, self.at, self.store = inv, at, store

    def get(self, key):
        few = self.at["ids"]
        return few[str(key)] if str(key) in few else self.store.get(f"{self.inv}\x01{key}") if self.at["more"] else None

    def put(self, key, value) -> None:
        few = self.at["ids"]
        if str(key) in few or len(few) < _FEW:
            few[str(key)] = value
        else:
            self.at["more"] = True
            self.store.put(f"{self.inv}\x01{key}", value)


#: Spawns of streamed logs: doc holds what _STANDS names; phase is now, or fault.
READ = T.StructType([T.StructField(n, t) for n, t in (("inv", T.StringType()), ("seq", T.LongType()), ("phase", T.StringType()), ("raw", T.StringType()), ("doc", T.StringType()))])


class LogReader(StatefulProcessor):
    """Spawns of logs with their outputs, in the order of each log's lines. One group
    holds many logs; of each the state keeps where it is (and how many lines wait),
    what its ids stand for, and the lines that wait for a gap. Small logs share
    pages, so that they do not go to the store one by one. Lines come in no order:
    those that wait for others of the same batch do so in memory, and go to the
    store, one by one, only if they are very many or the batch is over."""

    def __init__(self, first: int) -> None:
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        every = float("inf")  # saved after each lot
        self.ids, self.waiting, self.pages = (_Map(handle, n, every) for n in ("ids", "waiting", "pages"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lot, size = {}, 0
        for state in (self.ids, self.waiting, self.pages):
            state.begin()
        for frame in rows:
            for inv, seq, doc, raw in zip(frame["inv"].tolist(), frame["seq"].tolist(), frame["doc"].tolist(), frame["raw"].tolist(), strict=True):
                lot.setdefault(inv, {})[seq] = (doc, raw)
            size += len(frame)
            if size >= _AT_ONCE:
                yield self._take(lot)
                size = 0
                if sum(map(len, lot.values())) > _IN_MEMORY:
                    self._wait(lot)
        yield self._take(lot)
        self._wait(lot)
        self.pages.save()

    def _at(self, inv: str) -> dict:
        """Where a log is, on its page: changes to it are saved with the page."""
        number = zlib.crc32(inv.encode()) % _PAGES
        page = self.pages.get(number, {})
        self.pages.put(number, page)
        return page.setdefault(inv, {"next": self.first, "hash": None, "fault": False, "waiting": 0, "ids": {}, "more": False})

    def _take(self, lot: dict[str, dict[int, tuple[str, str | None]]]) -> pd.DataFrame:
        """The spawns among what is next in number; the lot keeps what has to wait."""
        out = []
        for inv, lines in list(lot.items()):
            at = self._at(inv)
            log = _Log(_Ids(inv, at, self.ids))
            while not at["fault"] and (line := self._next(inv, at, lines)) is not None:
                entry = json.loads(line[0])
                at["hash"] = entry.get("hash") or at["hash"]
                got = log.take(entry)
                if entry.get("kind") == "spawn":
                    at["fault"] = got is None
                    out.append((inv, at["next"], "now", line[1], json.dumps({"listed": got["listed"], "actual": got["actual"], "hash": at["hash"]})) if got else (inv, at["next"], "fault", None, None))
                at["next"] += 1
            later = {} if at["fault"] else {seq: line for seq, line in lines.items() if seq >= at["next"]}
            if later:
                lot[inv] = later
            else:
                del lot[inv]
        for state in (self.ids, self.waiting):
            state.save()
        return pd.DataFrame(out, columns=READ.names)

    def _wait(self, lot: dict[str, dict[int, tuple[str, str | None]]]) -> None:
        """Lines that wait go to the store."""
        for inv, lines in lot.items():
            at = self._at(inv)
            for seq, line in lines.items():
                place = f"{inv}\x01{seq}"
                at["waiting"] += self.waiting.get(place, new=not at["waiting"]) is None
                self.waiting.put(place, line)
        lot.clear()
        self.waiting.save()

    def _next(self, inv: str, at: dict, lines: dict[int, tuple[str, str | None]]) -> tuple[str, str | None] | None:
        """The line that is next in number, of this lot or one that waits."""
        came = lines.pop(at["next"], None)
        if at["waiting"] and (kept := self.waiting.pop(f"{inv}\x01{at['next']}")) is not None:
            at["waiting"] -= 1
            came = came or kept
        return came

    def close(self) -> None:
        pass


def log_spawns(lines: DataFrame, first: int = 0) -> DataFrame:
    """Spawns of streamed log lines, as exec_log.spawns() gives those of whole logs
    that are in order; those of a log from its first fault on are left out. State
    is one entry an output id, and lines that wait for a gap."""
    rows = log_entries(lines).withColumn("lot", F.pmod(F.xxhash64("inv"), F.lit(LOG_GROUPS)))
    read = rows.groupBy("lot").transformWithStateInPandas(statefulProcessor=LogReader(first), outputStructType=READ, outputMode="Append", timeMode="None")
    return _spawns(read.filter("phase = 'now'").select("inv", "seq", "raw", F.from_json("doc", _STANDS).alias("d")))


_PARTS = ("events", "lines", "held", "labels", "open", "configs", "actions", "pending")


class TraceBuilder(StatefulProcessor):
    """The trace of one stream. `first` is the number of its first event and line."""

    def __init__(self, drain_ms: int, idle_ms: int, forget_ms: int, first: int, expect_log: bool) -> None:
        self.drain_ms, self.idle_ms, self.forget_ms, self.first, self.expect_log = drain_ms, idle_ms, forget_ms, first, expect_log

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.log, self.meta_state = handle, _Log(_Map(handle, "ids")), _Map(handle, "meta")
        for name in _PARTS:
            setattr(self, name, _Map(handle, name))

    def _begin(self) -> dict | None:
        """The stream's state is read as it is needed; of a new one there is none."""
        self.meta_state.begin()
        known = self.meta_state.get("")
        pages = known.pop("pages", {}) if known else {}
        for name, state in self._maps():
            state.begin(fresh=known is None or name in pages, page=pages.get(name))
        return known

    def _maps(self) -> list[tuple[str, _Map]]:
        return [("ids", self.log.ids), *[(n, getattr(self, n)) for n in _PARTS]]

    def _save(self, meta: dict | None) -> None:
        """Keep the stream, or forget it (meta None). Maps of few entries are kept
        beside meta, so that a small stream is one entry of the store."""
        pages = {}
        for name, state in self._maps():
            there = state.page() if meta else None
            if there is None:
                state.save()
            else:
                pages[name] = there
        if meta:
            self.meta_state.put("", meta | {"pages": pages})
        else:
            self.meta_state.clear()
        self.meta_state.save()

    def _fresh(self, number: int, event: int) -> dict:
        return {"number": number, "event": event, "line": self.first, "uuid": None, "root_start": None, "started": False, "full": False, "ended": False, "logged": self.expect_log, "fault": False, "hash": None, "last": False, "fetch": None, "closed": False, "due": None}

    # events and lines in order

    def _run(self, force: bool = False) -> None:
        """Take what is next in number; with force, what is left whatever its number."""
        while True:
            m = self.meta
            if (event := self.events.pop(m["event"])) is not None:
                m["event"] += 1
                if not m["last"]:
                    self._event(m["event"] - 1, event)
            elif (line := self.lines.pop(f"{m['number']}#{m['line']}")) is not None:
                m["line"] += 1
                self._line(m["line"] - 1, line)
            elif force and (left := [int(k) for k, _ in self.events.items()]):
                m["event"] = min(left)
            elif force and (left := [int(k.split("#")[1]) for k, _ in self.lines.items() if k.startswith(f"{m['number']}#")]):
                m["line"] = min(left)
            else:
                return

    def _event(self, seq: int, e: dict) -> None:
        m, kind = self.meta, e["type"]
        if kind == "started":
            if m["started"]:
                self._finish()
                m = self.meta = self._fresh(m["number"] + 1, m["event"])
            m |= {"started": True, "uuid": e.get("uuid"), "root_start": e.get("start_ns")}
            self.held.put(seq, e)
            self._retry("\x00early")
        elif kind in ("actionCompleted", "testResult", "fetch"):
            if kind != "actionCompleted" or m["full"] or not e.get("success"):
                self._child(seq, e)
        elif kind not in _PASSED:
            self.held.put(seq, e)
        if kind == "optionsParsed":
            m["full"], m["logged"] = bool(e.get("publishes")), m["logged"] or bool(e.get("logs"))
        elif kind == "configuration" and e.get("config") is not None:
            self.configs.put(e["config"], e.get("name"))
        elif kind in ("targetConfigured", "targetCompleted") and e.get("label") is not None:
            self._mark(e["label"], seen=True)
            self._retry(e["label"])
        m["ended"] = m["ended"] or bool(e.get("ends"))
        m["last"] = m["last"] or bool(e.get("last"))

    def _mark(self, label: str, **told) -> dict:
        known = self.labels.get(label, {"seen": False, "tested": False, "out": False, "start": None, "seq": None, "end": None}) | told
        self.labels.put(label, known)
        return known

    def _retry(self, key: str) -> None:
        for seq in self.open.pop(key, []):
            e = self.held.pop(seq)
            if e is not None:
                self._child(seq, e, again=True)

    def _child(self, seq: int, e: dict, again: bool = False) -> None:
        """Hand a fetch, test or action on, or hold it until its target is known."""
        m, kind, label = self.meta, e["type"], e.get("label")
        if kind == "actionCompleted" and m["logged"] and not again:
            self._meet(seq, e)
        known = label is None or (self.labels.get(label) or {}).get("seen", False)
        named = e.get("config") is None or self.configs.get(e["config"]) is not None
        whole = kind == "fetch" or (known and kind == "testResult" and label is not None) or (known and named and e.get("end_ns") is not None and not m["logged"])
        if m["started"] and not m["ended"] and whole:
            config = (self.configs.get(e["config"]) if e.get("config") is not None else None)
            self._out(seq, "now", "event", {"raw": e["raw"], "event_time_ns": e.get("event_time_ns"), "uuid": m["uuid"], "root_start": m["root_start"], "config": config})
            start, end = e.get("start_ns"), e.get("end_ns")
            if kind == "fetch":
                came = e["event_time_ns"] if e.get("event_time_ns") is not None else m["root_start"]
                m["fetch"] = [min((x for x in ((m["fetch"] or [None])[0], came) if x is not None), default=None)]
            elif label is not None:
                got = self.labels.get(label)
                first = start is not None and (got["seq"] is None or seq < got["seq"])
                self._mark(label, out=True, tested=got["tested"] or kind == "testResult", start=start if first else got["start"], seq=seq if first else got["seq"], end=max((x for x in (got["end"], end) if x is not None), default=None))
            return
        self.held.put(seq, e)
        if not m["started"]:
            self.open.add("\x00early", seq)
        elif not known and not m["ended"]:
            self.open.add(label, seq)

    # spawns

    def _line(self, seq: int, entry: dict) -> None:
        m = self.meta
        if m["fault"]:
            return
        m["hash"] = entry.get("hash") or m["hash"]
        got = self.log.take(entry)
        if entry.get("kind") != "spawn":
            return
        m["fault"] = got is None
        if got:
            paths = [f.get("path") for f in got["actual"]]
            best = got["listed"][0] if got["listed"] else next((p for p in paths if p), "")
            spawn = got | {"seq": seq, "hash": m["hash"], "key": "\x01".join((entry["norm"], entry["mnemonic"], best)), "told": entry["told"], "missed": entry["missed"], "norm": entry["norm"]}
            self._spawn(spawn)

    def _meet(self, seq: int, e: dict) -> None:
        """Keep an action for its spawns, and take those that came before it."""
        m, key = self.meta, "\x01".join((e["norm"], e["mnemonic"], e["output"]))
        fixed = m["started"] and not m["ended"] and e.get("end_ns") is not None
        action = {"seq": seq, "label": e.get("label"), "mnemonic": e["mnemonic"], "output": e["output"], "start_ns": e.get("start_ns"), "end_ns": e.get("end_ns")}
        self.actions.put(key, {"action": action, "fixed": fixed, "count": 0, "first": None})
        for spawn in self.pending.pop(key, []):
            self._spawn(spawn)

    def _spawn(self, spawn: dict) -> None:
        m, known = self.meta, self.actions.get(spawn["key"])
        if known is None or not known["fixed"]:
            self.pending.add(spawn["key"], spawn)
            return
        first = known["first"]
        if first is None or spawn["seq"] < first["seq"]:
            first = {"seq": spawn["seq"], "told": spawn["told"], "norm": spawn["norm"], "missed": bool(first and first["missed"])}
        first["missed"] = first["missed"] or bool(spawn["missed"])
        self.actions.put(spawn["key"], known | {"count": known["count"] + 1, "first": first})
        self._out(spawn["seq"], "now", "spawn", {k: spawn[k] for k in ("raw", "listed", "actual", "hash")} | {"uuid": m["uuid"], "root_start": m["root_start"], "action": known["action"]})

    # out

    def _out(self, seq: int, phase: str, kind: str, doc: dict) -> None:
        self.rows.append((f"{self.file}#{self.meta['number']}", seq, phase, kind, json.dumps({k: v for k, v in doc.items() if v is not None})))

    def _finish(self) -> None:
        """Hand the rest of the invocation on, and forget it."""
        for seq, e in self.held.items():
            self._out(int(seq), "close", "event", {"raw": e["raw"], "event_time_ns": e.get("event_time_ns")})
        for _, spawns in self.pending.items():
            for s in spawns:
                self._out(s["seq"], "close", "spawn", {k: s[k] for k in ("raw", "listed", "actual", "hash")})
        for label, known in self.labels.items():
            if known["out"]:
                self._out(known["seq"] if known["seq"] is not None else -1, "early", "test" if known["tested"] else "action", {"label": label, "start_ns": known["start"], "end_ns": known["end"]})
        for _, a in self.actions.items():
            if a["count"]:
                self._out(a["first"]["seq"], "early", "spawn", {"action_seq": a["action"]["seq"], "spawn_count": a["count"], "told": a["first"]["told"], "norm": a["first"]["norm"], "missed": a["first"]["missed"]})
        if self.meta["fetch"]:
            self._out(-1, "early", "fetch", {"start_ns": self.meta["fetch"][0]})
        for state in (self.held, self.labels, self.open, self.configs, self.actions, self.pending, self.log):
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.file, self.rows, newest = key[0], [], 0
        m = self.meta = self._begin() or self._fresh(1, self.first)
        was_last = m["last"]
        for frame in rows:
            newest = max(newest, int(frame["at"].max().timestamp() * 1000))
            for seq, text in zip(frame["seq"], frame["doc"], strict=True):
                doc = json.loads(text)
                if m["closed"] or (doc["what"] == "entry" and (doc["number"] or 1) < m["number"]):
                    self._out(int(seq), "late", doc["what"], {"raw": doc.get("raw")})
                elif doc["what"] == "event" and seq >= m["event"]:
                    self.events.put(seq, doc)
                elif doc["what"] == "entry" and ((doc["number"] or 1) > m["number"] or seq >= m["line"]):
                    self.lines.put(f"{doc['number'] or 1}#{seq}", doc)
        self._run()
        m = self.meta
        if not m["closed"] and not (was_last and m["due"]):  # the drain time runs from the last message
            if m["due"]:
                self.handle.deleteTimer(m["due"])
            m["due"] = newest + (self.drain_ms if m["last"] else self.idle_ms)
            self.handle.registerTimer(m["due"])
        self._save(m)
        if self.rows:
            yield pd.DataFrame(self.rows, columns=HANDED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.file, self.rows = key[0], []
        m = self.meta = self._begin()
        if m and m["closed"]:
            m = None
        elif m:
            self._run(force=True)
            self._finish()
            for state in (self.events, self.lines):
                state.clear()
            m = self.meta | {"closed": True, "due": max(m["due"], timerValues.getCurrentWatermarkInMs()) + self.forget_ms}
            self.handle.registerTimer(m["due"])
        self._save(m)
        if self.rows:
            yield pd.DataFrame(self.rows, columns=HANDED.names)

    def close(self) -> None:
        pass


def handed_on(events: DataFrame, lines: DataFrame | None = None, drain_ms: int = 2300, idle_ms: int = 3_600_000, forget_ms: int = 3_600_000, first: int = 0, expect_log: bool = False, delay: str = "10 minutes") -> DataFrame:
    """What is final of the streams, row by row. events: file, seq, at, raw; lines:
    inv, seq, at, raw of the execution logs."""
    rows = numbered_events(events)
    rows = rows if lines is None else rows.unionByName(numbered_entries(lines))
    builder = TraceBuilder(drain_ms, idle_ms, forget_ms, first, expect_log)
    return rows.withWatermark("at", delay).groupBy("file").transformWithStateInPandas(statefulProcessor=builder, outputStructType=HANDED, outputMode="Append", timeMode="EventTime")


def _spawns(rows: DataFrame) -> DataFrame:
    """Spawns as exec_log.spawns() gives them: inv, seq, raw (known to be a spawn's
    text) and d with what _STANDS names. Only fields that are read are made."""
    log = rows.select("inv", "seq", F.try_parse_json("raw").alias("v"), F.lit("spawn").alias("kind"), "d.listed", "d.actual", F.col("d.hash").alias("hash_function"))
    return exec_log.finished(exec_log.spawn_fields(log, "listed", "actual", "hash_function"))


def spawn_rows(rows: DataFrame) -> DataFrame:
    """Spawns as exec_log.spawns() gives them, from handed-on rows."""
    return _spawns(rows.select("inv", "seq", F.from_json("doc", f"raw string, {_STANDS}").alias("d")).select("inv", "seq", "d.raw", "d"))


def spans_of(handed: DataFrame, options: assemble.Options = assemble.Options()) -> DataFrame:
    """The spans of one batch of handed-on rows, by the batch operators."""
    options, c = replace(options, clamp="as_of"), F.col
    rows = traces.stage(handed)
    told = rows.withColumn("d", F.from_json("doc", _DOC))
    now = told.filter("phase = 'now'")
    trace = ids.trace_id(F.coalesce("d.uuid", "inv"))
    none = F.lit(None).cast("long")
    about = now.select("inv", "seq", "kind", trace.alias("trace_id"), ids.span_id(trace, "root").alias("root_id"), c("d.root_start").alias("root_start"), none.alias("root_end"), none.alias("upper"), none.alias("completed_ns"), c("d.config").alias("_config"), c("d.action").alias("_action"))
    events, _ = source.classify(now.filter("kind = 'event'").select("inv", "seq", c("d.raw").alias("raw"), c("d.event_time_ns").alias("event_time_ns")))
    told_of = lambda kind: about.filter(c("kind") == kind).drop("kind")
    known = lambda kind: typed.table(events, kind).join(told_of("event").drop("_action"), ["inv", "seq"])
    acts = assemble.without_log(known("action_completed").withColumns({"owner": c("label"), "config_name": F.coalesce("_config", "configuration")}))
    spans = assemble.action_spans(acts, options).unionByName(assemble.test_spans(known("test_result").withColumn("owner", c("label")))).unionByName(assemble.fetch_spans(known("fetch")))
    met = told_of("spawn").select("inv", "trace_id", "root_start", "root_end", "upper", "completed_ns", "_action.*", F.lit(False).alias("orphan"))
    bounds = assemble.action_rows(met).select("inv", c("seq").alias("action_seq"), "action_span", "a_start", "a_end").distinct()
    spawned = spawn_rows(now.filter("kind = 'spawn'")).join(told_of("spawn").select("inv", "seq", "trace_id", c("_action.seq").alias("action_seq")), ["inv", "seq"])
    placed = spawned.join(bounds, ["inv", "action_seq"])
    spans = spans.unionByName(assemble.spawn_spans(placed, options))
    if rows.filter("phase = 'close'").isEmpty():
        return spans
    close = told.filter("phase = 'close'")
    held, _ = source.classify(close.filter("kind = 'event'").select("inv", "seq", c("d.raw").alias("raw"), c("d.event_time_ns").alias("event_time_ns")))
    early = told.filter("phase = 'early'")
    children = early.filter("kind <> 'spawn'").select("inv", "kind", "d.label", "d.start_ns", "d.end_ns", "seq")
    firsts = early.filter("kind = 'spawn'").select("inv", "d.action_seq", "d.spawn_count", "seq", F.from_json("d.told", _TOLD).alias("s"), "d.norm", "d.missed")
    rest = assemble.build(source.bronze(held), spawn_rows(close.filter("kind = 'spawn'")), options, assemble.Early(children, firsts))
    return spans.unionByName(rest)


def spans_to(write: Callable[[DataFrame, int], None], options: assemble.Options = assemble.Options()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over handed_on(): the spans of each batch go to `write`."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(spans_of(batch, options), number)

    return run


def late_rows(handed: DataFrame) -> DataFrame:
    """What came after the end of its invocation, for a table of its own."""
    return handed.filter("phase = 'late'").select("inv", "seq", F.get_json_object("doc", "$.raw").alias("raw"))


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Execution-log lines as a stream: inv, seq, at, raw. Files may come late."""
    return spark.readStream.schema("inv string, seq long, at timestamp, raw string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
