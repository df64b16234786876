"""Sessions as a stream against the batch operators, over restarts; overrides; forks that are gated; recordings that are forgotten."""

import random

import pandas as pd

from tracelode.operators import lookup, replay
from tracelode.streaming import session


class Stream:
    """Requests in, rows out, one run for each send."""

    def __init__(self, spark, at, known, **options):
        self.spark, self.at, self.known, self.options = spark, at, known, options

    def send(self, rows):
        self.spark.createDataFrame(rows, session.REQUEST).coalesce(1).write.mode("append").parquet(f"{self.at}/in")
        served = session.serve_sessions(self.spark.readStream.schema(session.REQUEST).parquet(f"{self.at}/in"), self.known, **self.options)
        out = served.writeStream.format("parquet").option("path", f"{self.at}/out").option("checkpointLocation", f"{self.at}/state")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {(r.rec, r.req): (r.via, r.seq, r.text) for r in self.spark.read.parquet(f"{self.at}/out").collect()}


def _known(spark, rows):
    return spark.createDataFrame(rows, session.RECORDED)


def test_equals_the_batch_operators_over_restarts(spark, tmp_path):
    rng = random.Random(11)
    answers = [(rec, 10 * k, rng.choice("abcd")) for rec in range(5) for k in range(8)]
    results = [(rec, 10 * k + 1, rng.choice("xy"), rng.choice("pqr"), rng.choice(("c1", "c2", "c3", None)), f"{rec}/{k}") for rec in range(5) for k in range(12)]
    asked = [(rec, req, rng.choice("abcde")) for rec in range(6) for req in range(0, 40, 4)]
    called = [(rec, req + 1, rng.choice("xyz"), rng.choice("pqrs")) for rec in range(6) for req in range(0, 40, 4)]
    by_id = [(rec, req + 2, rng.choice(("c1", "c2", "c3", "c4"))) for rec in range(6) for req in range(0, 40, 4)]
    points = [(rec, n, at) for rec in range(5) for n, at in enumerate(sorted(rng.sample(range(9), 3)))]
    a = spark.createDataFrame(answers, "rec long, seq long, hash string")
    r = spark.createDataFrame(results, "rec long, seq long, tool string, hash string, call_id string, text string")
    c = spark.createDataFrame(points, "rec long, nth long, answers_before long")
    q1 = spark.createDataFrame(asked, "rec long, req long, hash string")
    q2 = spark.createDataFrame(called, "rec long, req long, tool string, hash string")
    q3 = spark.createDataFrame(by_id, "rec long, req long, call_id string")
    served = {(x.rec, x.req): (x.via, x.seq) for x in replay.replay(q1, a).collect()}
    compactions, due = [], {}
    for rec in range(6):
        for req in range(3, 40, 4):
            compactions.append((rec, req, sum(v[1] is not None for (k, n), v in served.items() if k == rec and n < req)))
    for x in replay.compactions_due(spark.createDataFrame(compactions, "rec long, req long, served long"), c).collect():
        due[x.rec, x.req] = ("miss" if x.compaction is None else "compaction", x.compaction)
    want = served | {(x.rec, x.req): (x.via, x.seq) for x in lookup.tool_results(q2, r).collect()} | due
    want |= {(x.rec, x.req): ("miss" if x.seq is None else "id", x.seq) for x in lookup.results_by_id(q3, r.where("call_id is not null")).collect()}
    rows = [(rec, req, "answer", None, h, None, None) for rec, req, h in asked] + [(rec, req, "result", t, h, None, None) for rec, req, t, h in called]
    rows += [(rec, req, "result_id", None, k, None, None) for rec, req, k in by_id] + [(rec, req, "compaction", None, None, None, None) for rec, req, _ in compactions]
    stream = Stream(spark, str(tmp_path), session.recorded(a, r, c))
    for part in (range(0, 13), range(13, 14), range(14, 40)):
        got = stream.send([x for x in rows if x[1] in part])
    assert {k: v[:2] for k, v in got.items()} == want
    text_of = {(rec, seq): t for rec, seq, *_, t in results}
    assert all(v[2] == text_of[k[0], v[1]] for k, v in got.items() if v[1] is not None and (k[1] % 4) in (1, 2))


def test_an_override_holds_from_where_it_is_set(spark, tmp_path):
    known = _known(spark, [(1, k, "result", "read", "p", f"c{k % 2}", f"was {k}", None) for k in range(6)])
    stream = Stream(spark, str(tmp_path), known)
    stream.send([(1, 0, "result_id", None, "c0", None, None), (1, 1, "override", None, "c0", "new", None)])
    got = stream.send([(1, 2, "result_id", None, "c0", None, None), (1, 3, "result_id", None, "c1", None, None), (1, 4, "result", "read", "p", None, None), (1, 5, "result", "read", "p", None, None)])
    assert got == {(1, 0): ("id", 0, "was 0"), (1, 2): ("id", 2, "new"), (1, 3): ("id", 1, "was 1"), (1, 4): ("hash", 0, "new"), (1, 5): ("hash", 1, "was 1")}


def _fork(spark, at, *sent):
    known = _known(spark, [(1, 0, "answer", None, "h", None, None, None), (1, 1, "result", "read", "p", "call", "recorded", None)])
    stream = Stream(spark, str(at), known, fork=True)
    for rows in sent:
        got = stream.send(rows)
    return got


def test_a_fork_without_a_budget_goes_live(spark, tmp_path):
    assert _fork(spark, tmp_path, [(1, 0, "answer", None, "h", None, 9), (1, 1, "answer", None, "other", None, 10**9), (1, 2, "answer", None, "other", None, 1)]) == {
        (1, 0): ("hash", 0, None), (1, 1): ("live", None, None), (1, 2): ("live", None, None)}


def test_a_spent_budget_stops_the_next_request(spark, tmp_path):
    zero = _fork(spark, tmp_path / "zero", [(1, 0, "budget", None, None, None, 0), (1, 1, "answer", None, "other", None, 5)])
    assert zero == {(1, 1): ("spent", None, None)}
    got = _fork(spark, tmp_path / "ten", [(1, 0, "budget", None, None, None, 10), (1, 1, "answer", None, "x", None, 7)], [(1, 2, "answer", None, "x", None, 7), (1, 3, "answer", None, "x", None, 1), (1, 4, "answer", None, "h", None, 1)])
    assert [got[1, k][0] for k in (1, 2, 3, 4)] == ["live", "live", "spent", "hash"]


def test_a_miss_before_the_intervention_is_refused(spark, tmp_path):
    got = _fork(spark, tmp_path, [(1, 0, "override", None, "call", "REPLACED", None), (1, 1, "answer", None, "other", None, 5)],
                [(1, 2, "result_id", None, "call", None, None), (1, 3, "answer", None, "other", None, 5)])
    assert got == {(1, 1): ("refused", None, None), (1, 2): ("id", 1, "REPLACED"), (1, 3): ("live", None, None)}


class _State:
    """What a handle gives, in memory."""

    def __init__(self):
        self.map, self.value = {}, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def containsKey(self, k):  # noqa: N802
        return k in self.map

    def getValue(self, k):  # noqa: N802
        return self.map[k]

    def updateValue(self, k, v):  # noqa: N802
        self.map[k] = v

    def removeKey(self, k):  # noqa: N802
        self.map.pop(k, None)

    def clear(self):
        self.map, self.value = {}, None


class _Handle:
    def __init__(self):
        self.timers, self.states = set(), []

    def getMapState(self, *_):  # noqa: N802
        self.states.append(_State())
        return self.states[-1]

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def test_an_idle_recording_is_forgotten():
    handle, own = _Handle(), session.Session(fork=False, idle_ms=60_000)
    own.init(handle)
    names = [f.split()[0] for f in session.RECORDED.split(", ")]
    own.handleInitialState((1,), pd.DataFrame([(1, k, "answer", None, "h", None, f"said {k}", None) for k in range(3)], columns=names), _Clock(0))
    asked = [f.split()[0] for f in session.REQUEST.split(", ")]
    ask = lambda now: [(r.via, r.text) for d in own.handleInputRows((1,), iter([pd.DataFrame([(1, now, "answer", None, "h", None, None)], columns=asked)]), _Clock(now)) for r in d.itertuples()]
    assert ask(1000) == [("hash", "said 0")] and handle.timers == {61_000}
    assert ask(2000) == [("hash", "said 1")] and handle.timers == {62_000}  # put off by each request
    handle.timers.clear()
    assert list(own.handleExpiredTimer((1,), _Clock(62_000), None)) == [] and all(not s.map and s.value is None for s in handle.states)
    assert ask(70_000) == [("miss", None)] and handle.timers == {130_000}


def test_requests_of_unknown_kinds_and_recordings(spark, tmp_path):
    stream = Stream(spark, str(tmp_path), _known(spark, [(1, 0, "answer", None, None, None, "said", None), (1, 1, "result", None, "p", None, None, None)]))
    got = stream.send([(1, 0, "odd", None, None, None, None), (1, 1, "result", None, "p", None, None), (1, 2, "answer", None, None, None, None), (9, 0, "compaction", None, None, None, None), (9, 1, "result_id", None, "c", None, None), (9, 2, "result_id", None, None, None, None), (9, 3, "override", None, None, None, None), (9, 4, "budget", None, None, None, None)])
    assert got == {(1, 0): ("unknown kind", None, None), (1, 1): ("hash", 1, None), (1, 2): ("cursor", 0, "said"), (9, 0): ("miss", None, None), (9, 1): ("miss", None, None), (9, 2): ("miss", None, None)}


def test_one_call_serves_many_recordings_whose_rows_come_in_several_frames(monkeypatch):
    """As in a shard: a frame ends within a recording, and one with more rows than a page reads and writes pages; both give what small ones give."""
    rng = random.Random(5)
    names, asked = ([f.split()[0] for f in s.split(", ")] for s in (session.RECORDED, session.REQUEST))
    rows = [(rec, k, "result", rng.choice("ab"), rng.choice("pqr"), rng.choice(("c1", "c2", "c3")), f"{rec}/{k}", None) for rec in range(4) for k in range(15)]
    rng.shuffle(rows)
    requests = [(rec, k, rng.choice(("result", "result_id")), rng.choice("ab"), rng.choice(("p", "q", "x", "c1", "c2")), None, None) for rec in range(5) for k in range(40)]
    got = []
    for page, frames in ((256, 1), (2, 3)):
        monkeypatch.setattr(session, "PAGE", page)
        own = session.Session(fork=False, idle_ms=None)
        own.init(_Handle())
        for k in range(frames):
            own.handleInitialState((7,), pd.DataFrame(rows[k::frames], columns=names), _Clock(0))
        lots = [[r for r in requests if r[1] % 2 == lot] for lot in (0, 1)]
        got.append([tuple(r) for lot in lots for d in own.handleInputRows((7,), iter([pd.DataFrame(lot, columns=asked)]), _Clock(0)) for r in d.astype({"seq": "float"}).fillna(-1).itertuples(index=False)])
    assert got[0] == got[1] and len(got[0]) == 200 and {r[3] for r in got[0]} == {"hash", "cursor", "id", "miss"}
