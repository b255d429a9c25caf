"""File events that wait until their file has come to rest, as state of each path with timers.

A path's state is its last event and when it began to change. An event with another kind, size or time starts the wait anew; a
path that has been quiet for ``REST`` is told with its last event, one that doesn't come to rest within ``MOST`` as ``unsettled``,
and then its state goes. So nothing polls, paths are spread over the state's partitions, and a query that is started again goes on with what waited.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capturelake.functions.text import is_image

#: Milliseconds that a path must be quiet, and may take to come to rest.
REST, MOST = 400, 6_000
#: Events: what happened to a path, in what order and when, and what its file was then.
EVENT = "path string, kind string, seq long, at timestamp, size long, modified_ts long"
_OUT = "path string, kind string, seq long, size long, modified_ts long"
_STATE = "kind string, seq long, size long, modified_ts long, since long, last long, due long"


class _Rest(StatefulProcessor):
    def __init__(self, rest: int, most: int, by_event: bool):
        self.rest, self.most, self.by_event = rest, most, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        old = self.state.get() if self.state.exists() else None
        now = None if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        since, last, due = (old[4], old[5], old[6]) if old else (None, None, None)
        seen = tuple(old[:4]) if old else None
        for e in events.itertuples(index=False):
            size, time = (None if pd.isna(v) else int(v) for v in (e.size, e.modified_ts))
            if seen and e.seq < seen[1]:
                continue  # it came late
            at = now if now is not None else int(e.at.timestamp() * 1000)
            changed = not seen or (e.kind, size, time) != (seen[0], seen[2], seen[3])
            seen = (e.kind, int(e.seq), size, time)
            since, last = at if since is None else since, at if changed else last
        if seen is None:
            return
        new = min(last + self.rest, since + self.most)
        if new != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(new)
        self.state.update((*seen, since, last, new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        kind, seq, size, time, _, last, due = self.state.get()
        self.state.clear()
        kind = kind if due - last >= self.rest else "unsettled"
        yield pd.DataFrame({"path": [key[0]], "kind": [kind], "seq": [seq], "size": pd.array([size], "Int64"), "modified_ts": pd.array([time], "Int64")})

    def close(self) -> None:
        pass


def settled(events: DataFrame, rest: int = REST, most: int = MOST, by_event: bool = False) -> DataFrame:
    """A stream of ``events`` (see ``EVENT``) as (path, kind, seq, size, modified_ts), image files only, once each path has come to rest.

    ``by_event``: the clock is that of the events, behind a watermark of one second, and not the machine's. The session's state
    store must be the RocksDB one (:func:`with_rocksdb`)."""
    events = events.where(F.col("path").isNotNull() & is_image(F.col("path"))) if not by_event else events.where(F.col("path").isNotNull()).withWatermark("at", "1 second")
    mode = "EventTime" if by_event else "ProcessingTime"
    out = events.groupBy("path").transformWithStateInPandas(_Rest(rest, most, by_event), outputStructType=_OUT, outputMode="Append", timeMode=mode)
    return out.where(is_image(F.col("path")))


def with_rocksdb(spark) -> None:
    """Timers need a state store that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
