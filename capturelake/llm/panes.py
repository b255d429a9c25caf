"""Window panes that are revised: totals by kind and window, emitted when due, retracted and replaced when late rows change them.

A Structured Streaming query aggregates rows by (kind, window) natively, with its state and checkpoint
in the shared folder. It is started anew for each batch, takes what was fed since, and stops. Its state after each
batch stays readable: snapshots of consecutive batch ids are read with the ``statestore`` source and compared, and what differs
is a pane with new rows. A lifecycle table, written for each batch, has the panes that were emitted and aren't closed yet.
From the two come the records:

* ``emit``: a pane that is due and was never emitted, with its totals;
* ``retract`` and ``replace``: a pane emitted in an earlier batch that has new rows, with old and new totals;
* ``late``: a row whose pane was closed before its batch; it is in no pane;
* ``final``: after the last batch, a pane that was never emitted.

The watermark W of a batch is the greatest event time of all earlier batches, before the first one minus infinity. A pane is due when W has
passed its end by ``due_after``, and closed when by ``close_after``; the state forgets closed panes by Spark's
own watermark. Spark's watermarks start at 1970; event times are moved by ``SHIFT``, so that all real ones lie after that.

Rows are summed before the shuffle, so a kind with a third of all rows is one partial sum for each task and pane; what is shuffled, stored and compared
is panes. The driver has one time for each batch. Everything lies in a new folder for each run; the aggregate's tasks
may be lost and run again, as state and tables are committed by batch.

Nulls and odd input: rows without an event time are dropped, a null kind is ``none``, a null amount, or one that isn't finite, is 0. An id counts
once, with the least of its rows; null ids are one id. An empty batch still moves panes on; an empty table gives no records. Event times
before 1970 have negative windows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import shared_path

SECOND = 1_000_000
HOUR, DAY = 3600 * SECOND, 86_400 * SECOND
#: Microseconds added to event times: the years -769 to 4707 are after 1970 then.
SHIFT = 1_000_000 * DAY
FEED = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("cents", T.LongType())])
SETTINGS = {
    # each RocksDB instance keeps half a MB of native memory after it is closed, which adds up over batches and partitions; here a task holds its own partition's open panes, on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    # a batch of rows is one batch of the query, so that state versions are numbered like batches
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # every start opens stores of its own: those of earlier starts are closed at once
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.session.timeZone": "UTC",
}


class RevisedPanes:
    """A run over batches: :meth:`feed` for each, then :meth:`finish`. Times are microseconds since 1970."""

    def __init__(self, spark: SparkSession, width: int = HOUR, due_after: int = 12 * HOUR, close_after: int = 2 * DAY):
        self.spark, self.width, self.due_after, self.close_after = spark.newSession(), width, due_after, close_after
        self.own, self.root = spark, shared_path(spark, "panes")
        for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
            self.spark.conf.set(k, v)
        self.marks: list[int | None] = []  # W of each batch that was fed
        self.seen: int | None = None

    def _passed(self, index: Column, mark: Column | int | None, after: int) -> Column:
        """Whether ``mark`` has passed the end of a window by ``after``."""
        mark = F.lit(mark).cast("long") if not isinstance(mark, Column) else mark
        return F.coalesce(mark >= (index + 1) * self.width + after, F.lit(False))

    def _index(self, at: Column) -> Column:
        """The number of a time's window; exact, as shifted times are positive."""
        moved = F.unix_micros(at)
        return F.floor((moved - F.pmod(moved, F.lit(self.width)) - SHIFT) / self.width)

    def feed(self, rows: DataFrame) -> None:
        """One batch: rows (id, event, kind, cents), ids not seen before. It may be empty."""
        batch, mark, told = len(self.marks), self.seen, Observation()
        feed = rows.select(F.col("id").cast("long").alias("id"), F.timestamp_micros(F.col("event") + SHIFT).alias("at"), F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("cents", F.lit(0)).cast("long").alias("cents"))
        feed.observe(told, F.max(F.unix_micros(F.col("at"))).alias("most")).write.parquet(f"{self.root}/feed/batch={batch}")
        self._aggregate(mark)
        self.marks.append(mark)
        most = told.get["most"]
        if most is not None:
            self.seen = max(most - SHIFT, self.seen if self.seen is not None else most - SHIFT)
        self._snapshot(batch)
        self._move(batch, mark)

    def _aggregate(self, mark: int | None) -> None:
        """Start the query on what was fed since, and wait for its end. Rows of closed panes stay out."""
        rows = self.spark.readStream.schema(FEED).option("recursiveFileLookup", "true").parquet(f"{self.root}/feed")
        rows = rows.withWatermark("at", f"{self.close_after} microseconds")
        panes = rows.where(~self._passed(self._index(F.col("at")), mark, self.close_after)).groupBy(F.window("at", f"{self.width} microseconds"), "kind").agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents"))
        out = panes.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True)
        query = out.start()
        query.awaitTermination()
        batch = query.lastProgress["batchId"] if query.lastProgress else None
        if batch != len(self.marks):
            raise RuntimeError(f"batch {len(self.marks)} was run as {batch}")

    def _snapshot(self, batch: int) -> None:
        """The state after a batch, as panes (kind, hour, n_rows, cents)."""
        state = self.spark.read.format("statestore").option("batchId", batch).load(f"{self.root}/checkpoint")
        n, cents = (F.col("value")[c] for c in state.schema["value"].dataType.names)
        start = F.unix_micros(F.col("key")["window"]["start"]) - SHIFT
        panes = state.select(F.col("key")["kind"].alias("kind"), F.floor(start / self.width).alias("hour"), n.alias("n_rows"), cents.alias("cents"))
        panes.coalesce(self._files()).write.parquet(f"{self.root}/snapshots/batch={batch}")

    def _files(self) -> int:
        """Panes are few rows: a snapshot needs fewer files than the state has partitions."""
        return max(1, self.spark.sparkContext.defaultParallelism)

    def _table(self, name: str, batch: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{name}/batch={batch}") if batch >= 0 else None

    def _move(self, batch: int, mark: int | None) -> None:
        """Compare two snapshots and move panes on in the lifecycle table: old and new totals, what is done with a pane, and whether it is closed."""
        now = self._table("snapshots", batch).select("kind", "hour", *(F.lit(None).cast("long").alias(c) for c in ("old_rows", "old_cents", "emitted")), "n_rows", "cents")
        before, life = self._table("snapshots", batch - 1), self._table("lifecycle", batch - 1)
        if before is not None:
            nothing = [F.lit(None).cast("long").alias(c) for c in ("emitted", "n_rows", "cents")]
            now = now.unionByName(before.select("kind", "hour", F.col("n_rows").alias("old_rows"), F.col("cents").alias("old_cents"), *nothing))
            nothing = [F.lit(None).cast("long").alias(c) for c in ("old_rows", "old_cents", "n_rows", "cents")]
            now = now.unionByName(life.where("emitted is not null and not closed").select("kind", "hour", "emitted", *nothing))
        sides = ("old_rows", "old_cents", "n_rows", "cents", "emitted")
        panes = now.groupBy("kind", "hour").agg(*(F.max(c).alias(c) for c in sides))  # each side has a pane once
        panes = panes.withColumns({"n_rows": F.coalesce("n_rows", "old_rows"), "cents": F.coalesce("cents", "old_cents")})  # forgotten in this batch
        due, closed = self._passed(F.col("hour"), mark, self.due_after), self._passed(F.col("hour"), mark, self.close_after)
        action = F.when(F.col("emitted").isNull() & due, "emit").when(F.col("emitted").isNotNull() & ~F.col("n_rows").eqNullSafe(F.col("old_rows")), "replace")
        panes = panes.withColumns({"action": action, "closed": closed})
        panes = panes.withColumn("emitted", F.when(F.col("action") == "emit", F.lit(batch).cast("long")).otherwise(F.col("emitted")))
        panes.write.parquet(f"{self.root}/lifecycle/batch={batch}")

    def finish(self) -> DataFrame:
        """All records (batch, hour, click_id, n_rows, cents, record, kind); the last batch's open panes that were never emitted are final."""
        if not self.marks:
            return self.own.createDataFrame([], "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string")
        last = len(self.marks) - 1
        life = self.own.read.parquet(f"{self.root}/lifecycle").withColumn("batch", F.col("batch").cast("long"))
        one = lambda record, n="n_rows", c="cents": F.struct(F.lit(record).alias("record"), F.col(n).alias("n_rows"), F.col(c).alias("cents"))
        emit, replace = F.col("action") == "emit", F.col("action") == "replace"
        final = (F.col("batch") == last) & F.col("emitted").isNull()
        record = F.when(emit, F.array(one("emit"))).when(replace, F.array(one("retract", "old_rows", "old_cents"), one("replace"))).when(final, F.array(one("final")))
        moved = life.select("batch", "hour", "kind", F.explode(record).alias("r")).select("batch", "hour", F.lit(-1).cast("long").alias("click_id"), "r.n_rows", "r.cents", "r.record", "kind")
        feed = self.own.read.schema(T.StructType([*FEED.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.root}/feed")
        marks = F.array(*(F.lit(m).cast("long") for m in self.marks))
        late = feed.withColumn("hour", self._index(F.col("at"))).where(self._passed(F.col("hour"), F.get(marks, F.col("batch").cast("int")), self.close_after))
        return moved.unionByName(late.select("batch", "hour", F.col("id").alias("click_id"), F.lit(1).cast("long").alias("n_rows"), "cents", F.lit("late").alias("record"), "kind"))


def revised_panes(rows: DataFrame, batches: int, **times: int) -> DataFrame:
    """Records of rows (batch, id, event, kind, cents) fed in ``batches`` batches from 0; see :class:`RevisedPanes` for the times."""
    staged = shared_path(rows.sparkSession, "batches")
    rows.select("batch", "id", "event", "kind", "cents").write.partitionBy("batch").parquet(staged)
    kept = T.StructType([*(f for f in rows.select("id", "event", "kind", "cents").schema.fields), T.StructField("batch", T.LongType())])
    run = RevisedPanes(rows.sparkSession, **times)
    for b in range(batches):
        run.feed(run.spark.read.schema(kept).parquet(staged).where(F.col("batch") == b))
    return run.finish()


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    t = ts.cast("timestamp_ntz")
    second = (F.extract(F.lit("SECOND"), t) * SECOND).cast("long")
    return F.unix_date(t.cast("date")).cast("long") * DAY + (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * SECOND + second


def click_panes(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """Records of ``clicks`` in ten batches: by the day of arrival, and up to six later by the id's hash.

    Event times are brought to the first days of 1970: less whole decades of days of the arrival. Rows that never arrived count as arrived at their own time."""
    day = F.unix_date(F.coalesce("arrived_at", "ts").cast("date"))
    q = F.pmod(day, F.lit(10))
    later = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23)
    value = F.col("value").cast("double")
    fine = ~F.isnan(value) & (F.abs(value) < 9e16)
    cents = F.when(fine, F.floor(value * 100 + 0.5)).otherwise(0)
    rows = clicks.where("ts is not null").select(
        F.col("click_id").alias("id"),
        F.struct(
            F.least(F.lit(batches - 1), q + later).cast("long").alias("batch"),
            (micros(F.col("ts")) - (day - q).cast("long") * DAY).alias("event"),
            F.coalesce("kind", F.lit("none")).alias("kind"),
            F.coalesce(cents, F.lit(0)).alias("cents"),
        ).alias("row"),
    )
    once = rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")
    return revised_panes(once, batches)
