"""Stateful replay of a stream of requests.

Each recording's state holds its answers, once, and the places of those it has used, so it stays as
large as the recording and outlives restarts in the query's checkpoint. Requests carry their hash alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import SERVED, serve
from ..plans.lineage import python_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Server(StatefulProcessor):
    """Serves the requests of one recording from the answers in its state."""

    def __init__(self, fall_back: bool):
        self.fall_back = fall_back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answers = handle.getListState("answers", "seq long, hash string")
        self.used = handle.getValueState("used", "places array<long>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        rows = initialState.sort_values("seq")
        self.answers.put([(int(r.seq), r.hash) for r in rows.itertuples()])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = pd.concat(list(rows)).sort_values("req")
        used = set(self.used.get()[0]) if self.used.exists() else set()
        recorded = sorted(self.answers.get()) if self.answers.exists() else []
        got = serve(key[0], list(zip(asked.req.tolist(), asked.hash.tolist(), strict=True)), [tuple(a) for a in recorded], self.fall_back, used)
        self.used.update((sorted(used),))
        yield pd.DataFrame(got, columns=["rec", "req", "via", "seq"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def serve_stream(requests: DataFrame, answers: DataFrame, fall_back: bool = True) -> DataFrame:
    """rec, req, via, seq for a stream of requests (rec, req, hash) against recorded answers (rec, seq, hash).

    The answers are the state that the stream begins with: they are read once, not joined to requests.
    Requests of a recording are served in order within each micro-batch, as replay() serves them in
    one; a recording without answers gives misses. Sets the session's state store to the one that such
    state needs.
    """
    python_path(requests.sparkSession)
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = requests.schema["rec"].dataType.simpleString()
    return requests.groupBy("rec").transformWithStateInPandas(
        _Server(fall_back), SERVED.replace("long", kind, 1), "append", "none", answers.select("rec", "seq", "hash").groupBy("rec")
    )
