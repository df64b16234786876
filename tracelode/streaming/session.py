"""Replay of whole sessions as a stream: answers, tool results, compactions, overrides and forks, from one composite state.

Requests come in order of ``req`` and are of these kinds:

- ``answer``: the answer to a history (key: its hash). The first unused one of that hash, else the first unused one ('cursor').
- ``result``: the result of a call of a tool (tool, key: hash of its arguments), as answers are found, among results of that tool.
- ``result_id``: the result of a call by its id (key): the n-th request of an id takes the n-th result ('id').
- ``compaction``: the next compaction, if it was made after as many answers as have been served by now.
- ``override`` (key: a call's id, text): from here on that call's results have this text. In a fork it is the intervention.
- ``budget`` (n): tokens that a fork may use.

In a fork an answer that isn't recorded is asked of a live model, if it may be: 'refused' before the intervention has been served,
'spent' once the budget is used (n of an answer request is what it is reckoned to use), else 'live'; nothing falls back to another answer.

The state of a recording begins with what it recorded (see ``recorded``), once: queues by hash, what is left by place, results by id, the points of
compactions, in pages. A micro-batch reads the pages that its requests need, once, and writes those that changed, so its cost doesn't grow with the
recording; state outlives restarts in the query's checkpoint. Recordings are dealt over shards, each served by one call, as calls and frames
cost more than small recordings do. With ``idle`` a recording that has had no request for so long is forgotten by a timer; later requests miss.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.lineage import python_path
from .replay import STATE_STORE

REQUEST = "rec long, req long, kind string, tool string, key string, text string, n long"
RECORDED = "rec long, seq long, kind string, tool string, key string, call_id string, text string, n long"
OUT = "rec long, req long, kind string, via string, seq long, text string"
ANSWERS = "answer"
#: Keys over which recordings are dealt. State lies by shard and recording, so this can't change while a checkpoint is kept.
SHARDS = 1 << 10
#: Recorded rows of a page of state; a recording of no more has its state in one value.
PAGE = 256


class _Own:
    """What a recording's state holds, as far as it has been asked for; what changed is written once."""

    def __init__(self, rec: int, heads, pages, head: dict, stored: str | None):
        self.rec, self.heads, self.pages, self.head, self.stored = rec, heads, pages, head, stored
        self.read: dict[str, tuple[dict, str | None]] = {}

    def part(self, kind: str, of: str, number: int | None = None) -> dict:
        """The part of kind that holds an item: of a small recording all of them, else those of its page."""
        if self.head["pages"] == 1:
            return self.head["own"][kind]
        page = f"{kind}{of}/{number // PAGE}" if number is not None else f"{kind}{zlib.crc32(of.encode()) % self.head['pages']}"
        if page not in self.read:
            key = (self.rec, page)
            body = self.pages.getValue(key)[0] if self.stored is not None and self.pages.containsKey(key) else None
            self.read[page] = ({} if body is None else json.loads(body), body)
        return self.read[page][0]

    def write(self) -> None:
        for page, (part, was) in self.read.items():
            body = json.dumps(part) if part else None
            if body is None and was is not None:
                self.pages.removeKey((self.rec, page))
            elif body != was:
                self.pages.updateValue((self.rec, page), (body,))
            self.read[page] = (part, body)
        body = json.dumps(self.head)
        if body != self.stored:
            self.heads.updateValue((self.rec,), (body,))
            self.stored = body


class Session(StatefulProcessor):
    """Requests of a shard's recordings against their states."""

    def __init__(self, fork: bool, idle_ms: int | None):
        self.fork, self.idle_ms = fork, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A head has points (answers before each compaction, in order), their numbers, how many were taken, answers served, the fork's state, size and
        # cursor of each pool, how many pages there are and, of a small recording, all that pages would hold.
        self.heads = handle.getMapState("heads", "rec long", "body string")
        self.pages = handle.getMapState("pages", "rec long, page string", "body string")
        self.overrides = handle.getMapState("overrides", "rec long, call_id string", "text string")
        self.timer = handle.getValueState("timer", "at long")
        self.shard, self.begun = None, {}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        if key != self.shard:
            self.shard, self.begun = key, {}
        d = initialState
        rows = zip(*(d[c].tolist() for c in ("rec", "seq", "kind", "tool", "key", "call_id", "text", "n")), strict=True)
        came: dict[int, list[tuple]] = {}
        for rec, *row in rows:
            came.setdefault(int(rec), []).append(row)
        for rec, found in came.items():  # the rows of a recording may come in several frames
            before, was = self.begun.get(rec, ((), None))
            whole = [*before, *found]
            for page in was.read if was else ():
                self.pages.removeKey((rec, page))
            self.begun[rec] = (whole, self._begin(rec, whole))

    def _begin(self, rec: int, rows: list[list]) -> _Own:
        rows = sorted(rows, key=lambda r: r[0])
        points = [r for r in rows if r[1] == "compaction"]
        rows = [r for r in rows if r[1] != "compaction"]
        own = self._empty(rec)
        own.head |= {"points": [int(r[6]) for r in points], "seqs": [int(r[0]) for r in points], "pages": max(-(-len(rows) // PAGE), 1)}
        pools = own.head["pools"]
        for seq, kind, tool, h, call, text, _ in rows:
            pool, seq, call, text = _pool(kind, tool), int(seq), _text(call), _text(text)
            place = pools.setdefault(pool, [0, 0])[0]
            pools[pool][0] += 1
            own.part("s", pool, place)[_item(pool, place)] = [seq, call, text]
            if isinstance(h, str):
                own.part("q", _item(pool, h)).setdefault(_item(pool, h), []).append(place)
            if kind == "result" and call is not None:
                own.part("i", call).setdefault(call, []).append([seq, text])
        own.write()
        return own

    def _empty(self, rec: int) -> _Own:
        head = {"points": [], "seqs": [], "taken": 0, "answered": 0, "fork": [None, 0, None, False], "pools": {}, "pages": 1, "own": {"s": {}, "q": {}, "i": {}}, "overridden": False}
        return _Own(rec, self.heads, self.pages, head, None)

    def _open(self, rec: int) -> _Own:
        if not self.heads.containsKey((rec,)):
            return self._empty(rec)
        body = self.heads.getValue((rec,))[0]
        return _Own(rec, self.heads, self.pages, json.loads(body), body)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = pd.concat(list(rows)).sort_values(["rec", "req"])
        begun, self.shard, self.begun = self.begun if key == self.shard else {}, None, {}
        if self.idle_ms is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        out: list[tuple] = []
        columns = zip(*(asked[c].tolist() for c in ("rec", "req", "kind", "tool", "key", "text", "n")), strict=True)
        for rec, own_rows in groupby(columns, key=lambda r: r[0]):
            rec = int(rec)
            own = begun[rec][1] if rec in begun else self._open(rec)
            self._serve(own, own_rows, out)
            own.write()
        yield pd.DataFrame(out, columns=["rec", "req", "kind", "via", "seq", "text"]).astype({"rec": "int64", "req": "int64", "seq": "Int64"})

    def _serve(self, own: _Own, rows: Iterable[tuple], out: list[tuple]) -> None:
        head, fork = own.head, own.head["fork"]
        for _, req, kind, tool, h, said, n in rows:
            via, seq, text = None, None, None
            if kind == "override" and isinstance(h, str):
                self.overrides.updateValue((own.rec, h), (_text(said),))
                head["overridden"] = True
                fork[2], fork[3] = h, False
            elif kind in ("override", "budget"):
                fork[0] = fork[0] if kind == "override" or pd.isna(n) else int(n)
            elif kind == "answer":
                found = self._take(own, ANSWERS, h, not self.fork)
                if found is not None:
                    via, seq, _, text = found
                    head["answered"] += 1
                else:
                    via = self._live(fork, n) if self.fork else "miss"
            elif kind in ("result", "result_id"):
                found = self._take(own, _pool("result", tool), h, True) if kind == "result" else self._next_of(own, h)
                via = "miss"
                if found is not None:
                    via, seq, call, text = found
                    if call is not None and head["overridden"] and self.overrides.containsKey((own.rec, call)):
                        text = self.overrides.getValue((own.rec, call))[0]
                        fork[3] |= call == fork[2]
            elif kind == "compaction":
                via = "miss"
                if head["taken"] < len(head["points"]) and head["points"][head["taken"]] == head["answered"]:
                    via, seq = "compaction", head["seqs"][head["taken"]]
                    head["taken"] += 1
            else:
                via = "unknown kind"
            if via is not None:
                out.append((own.rec, int(req), kind, via, seq, text))

    @staticmethod
    def _take(own: _Own, pool: str, h: str, fall_back: bool) -> tuple | None:
        """The first unused slot of that hash, else, falling back, the first unused one: via, seq, call id, text."""
        if pool not in own.head["pools"]:
            return None
        use = lambda place: own.part("s", pool, place).pop(_item(pool, place), None)
        if isinstance(h, str):
            name = _item(pool, h)
            queues = own.part("q", name)
            places = queues.get(name, [])
            while places:
                got = use(places.pop(0))
                if not places:
                    del queues[name]
                if got is not None:  # else a request without its hash has taken it
                    return "hash", *got
        if not fall_back:
            return None
        size, cursor = own.head["pools"][pool]
        got = None
        while cursor < size and got is None:
            got = use(cursor)
            cursor += got is None
        own.head["pools"][pool][1] = cursor
        return None if got is None else ("cursor", *got)

    @staticmethod
    def _next_of(own: _Own, call: str) -> tuple | None:
        left = own.part("i", call) if isinstance(call, str) else {}
        if call not in left:
            return None
        seq, text = left[call].pop(0)
        if not left[call]:
            del left[call]
        return "id", seq, call, text

    @staticmethod
    def _live(fork: list, tokens) -> str:
        budget, used, intervention, served = fork
        if intervention is not None and not served:
            return "refused"
        if budget is not None and used >= budget:
            return "spent"
        fork[1] = used + (0 if pd.isna(tokens) else int(tokens))
        return "live"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.heads, self.pages, self.overrides, self.timer):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _pool(kind: str, tool) -> str:
    return f"result:{_text(tool) or ''}" if kind == "result" else ANSWERS


def _item(pool: str, name) -> str:
    return f"{name}@{pool}"


def _text(v) -> str | None:
    return v if isinstance(v, str) else None


def recorded(answers: DataFrame | None = None, results: DataFrame | None = None, compactions: DataFrame | None = None) -> DataFrame:
    """What sessions begin with: answers (rec, seq, hash), results (rec, seq, tool, hash, call_id, text) and compactions (rec, nth, answers_before); columns but the first two may be absent."""
    parts = []
    for d, kind, names in ((answers, "answer", {"hash": "key"}), (results, "result", {"hash": "key"}), (compactions, "compaction", {"nth": "seq", "answers_before": "n"})):
        if d is not None:
            d = d.withColumnsRenamed(names).withColumn("kind", F.lit(kind))
            parts.append(_as(d, RECORDED))
    if not parts:
        raise ValueError("a recording has answers, results or compactions")
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def requests(d: DataFrame, kind: str) -> DataFrame:
    """d (rec, req and what this kind of request has) as requests of one kind."""
    return _as(d.withColumn("kind", F.lit(kind)), REQUEST)


def _as(d: DataFrame, schema: str) -> DataFrame:
    fields = [f.split() for f in schema.split(", ")]
    return d.select(*[(F.col(n) if n in d.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def serve_sessions(asked: DataFrame, known: DataFrame, fork: bool = False, idle: float | None = None) -> DataFrame:
    """rec, req, kind, via, seq, text for a stream of requests (REQUEST) against recordings (RECORDED), in order within each micro-batch.

    Overrides and budgets give no rows; one without a key or a number does nothing. A null tool is the empty one. idle: seconds after which a recording without requests is forgotten; as timers wait
    for time to pass, such a query doesn't end by itself with the trigger availableNow.
    Sets the session's state store to the one that such state needs.
    """
    python_path(asked.sparkSession)
    asked.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    idle_ms = None if idle is None else int(idle * 1000)
    mode = "none" if idle is None else "processingTime"
    shard = F.col("rec") if idle is not None else F.pmod(F.xxhash64("rec"), F.lit(SHARDS))  # a timer is of one recording
    dealt = lambda d: d.withColumn("shard", shard).groupBy("shard")
    return dealt(asked).transformWithStateInPandas(Session(fork, idle_ms), OUT, "append", mode, dealt(known))
