"""Sessions of an endless stream without keys, by ranges of time: no task holds all rows of what is open.

A range is ``RANGE`` gaps long. A row also stands, without counting, in the range before if it lies within a gap of its range's start, and in the
range after if within a gap of its end. So each range's sessions, which Spark's own session windows find, tell whether they go on beyond the range:
they hold a row from there. Most don't, and are done. A second stateful step strings together those that do; it sees at most two of a range, and a
session's last part closes when the session does, its other parts no later. So sessions and the time at which they are told are those of one
session window over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capturelake.streaming.settle import with_rocksdb

#: The length of a range in gaps: a row stands in 1 + 2 / RANGE ranges on average.
RANGE = 4
_OUT, _STATE = "start_ts long, end_ts long, count long", "start_ts long, end_ts long, count long"


def _ranges(second: Column, gap: int, length: int) -> Column:
    """The ranges a row stands in: (range, side), side 0 for its own, -1 if it lies before the range, 1 if after."""
    own, at = F.floor(second / length), F.pmod(second, F.lit(length))
    there = lambda n, side: F.struct((own + n).alias("range"), F.lit(side).alias("side"))
    copies = F.array(there(0, 0), F.when(at <= gap, there(-1, 1)), F.when(at >= length - gap, there(1, -1)))
    return F.array_compact(copies)


class _Strung(StatefulProcessor):
    """Parts in order of time; one that comes from the range before continues what is open, one that goes on stays open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = pd.concat(list(rows)).sort_values("first")
        done, now = [], tuple(self.open.get()) if self.open.exists() else None
        for p in parts.itertuples(index=False):
            if now is not None and not p.goes_back:
                done.append(now)
                now = None
            now = (int(p.first), int(p.last), int(p.n)) if now is None else (now[0], int(p.last), now[2] + int(p.n))
            if not p.goes_on:
                done.append(now)
                now = None
        if now is not None:
            self.open.update(now)
        else:
            self.open.clear()
        yield pd.DataFrame(done, columns=["start_ts", "end_ts", "count"], dtype="int64")

    def close(self) -> None:
        pass


def sessions(events: DataFrame, ts: str, gap_seconds: int, watermark: str = "1 hour") -> DataFrame:
    """(start_ts, end_ts, count) of runs of two or more rows whose steps are ``gap_seconds`` at most, as they close behind the watermark; whole seconds.

    Rows without a time belong to none. Rows of one time count each. A row that comes late, behind the watermark by more than the gap, is
    Spark's to drop, and so is one before 1970, where its watermark starts. The Spark session's state store becomes the RocksDB one."""
    if gap_seconds < 1:
        raise ValueError(f"not a gap: {gap_seconds}")
    with_rocksdb(events.sparkSession)
    length = RANGE * gap_seconds
    rows = events.select(F.date_trunc("second", ts).cast("timestamp").alias("at")).where("at is not null").withWatermark("at", watermark)
    placed = rows.select("at", F.explode(_ranges(F.col("at").cast("long"), gap_seconds, length)).alias("p")).select("at", "p.range", "p.side")
    own = F.when(F.col("side") == 0, F.col("at").cast("long"))
    parts = placed.groupBy("range", F.session_window("at", f"{gap_seconds} seconds").alias("w")).agg(
        F.min(own).alias("first"), F.max(own).alias("last"), F.count(own).alias("n"), (F.min("side") < 0).alias("goes_back"), (F.max("side") > 0).alias("goes_on")
    )
    alone = ~(F.col("goes_back") | F.col("goes_on"))
    own_range = F.when(alone, F.col("range")).otherwise(F.lit(0).cast("long"))
    keyed = parts.where("n > 0").select(alone.alias("alone"), own_range.alias("range"), "first", "last", "n", "goes_back", "goes_on")
    return keyed.groupBy("alone", "range").transformWithStateInPandas(_Strung(), outputStructType=_OUT, outputMode="Append", timeMode="None").where("count > 1")
