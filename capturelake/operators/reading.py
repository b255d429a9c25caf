"""Reading runs that can be watched, stopped and resumed.

A run claims its captures in a shared folder before it reads, so that a run that starts later leaves them alone. Its work is cut into
parts by a hash of the id, each part one job under the run's tag whose results are written when the part is done. Cancelling the tag stops the job
at work: parts that were written stay, the rest of the captures is as it was and may be claimed again. Progress is counted from what is written.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.operators import ocr
from capturelake.plans.lineage import cut
from capturelake.schemas import Library

CLAIM, CLOSED = "id long, seq long, run string", "run string, state string"
#: Parts of a run: a cancelled run loses one at most.
PARTS = 16


@dataclass(frozen=True)
class Run:
    """A run below ``root`` and the captures (id, path) that are its own."""

    spark: SparkSession
    root: str
    name: str
    work: DataFrame

    @property
    def tag(self) -> str:
        return f"reading-{self.name}"

    def cancel(self) -> None:
        """Stop the job at work and take up no other part; may be called from any thread."""
        self.spark.createDataFrame([(self.name, "cancelled")], CLOSED).coalesce(1).write.mode("append").parquet(f"{self.root}/closed")
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    from capturelake.sources.files import place

    where, name = place(path)
    return spark.read.schema(schema).parquet(path) if where.get_file_info(name).type.value else spark.createDataFrame([], schema)


def claims(spark: SparkSession, root: str) -> DataFrame:
    """(id, seq, run) of runs that aren't closed."""
    return _read(spark, f"{root}/claims", CLAIM).join(_read(spark, f"{root}/closed", CLOSED).select("run").distinct(), "run", "left_anti")


def claim(lib: Library, root: str, attempts: int = ocr.ATTEMPTS, name: str | None = None) -> Run:
    """A new run over the captures in the queue that no open run has claimed.

    A claim is written first and read again: of two runs that claim one capture, the one that saw fewer claims before, or else has
    the lesser name, keeps it. So runs may start at any time, one after the other."""
    spark, name = lib.captures.sparkSession, name or uuid.uuid4().hex[:12]
    taken = claims(spark, root)
    seq = (taken.agg(F.max("seq")).first()[0] or 0) + 1
    own = ocr.claimable(lib.captures, attempts).select("id").join(taken, "id", "left_anti")
    own.select("id", F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("run")).write.mode("append").parquet(f"{root}/claims")
    first = claims(spark, root).groupBy("id").agg(F.min(F.struct("seq", "run"))["run"].alias("run"))
    kept = first.where(F.col("run") == name).select("id")
    return Run(spark, root, name, cut(lib.captures.join(kept, "id", "left_semi").select("id", "path"), "claimed"))


def read(run: Run, engine: ocr.Engine, parts: int = PARTS, tell: Callable[[int, int], None] | None = None) -> tuple[DataFrame, bool]:
    """Read a run's captures; ``tell(done, total)`` after each part. Returns what was read (see :func:`ocr.recognize`) and whether that is all.

    Parts that an earlier call has written aren't read again."""
    spark, out, total = run.spark, f"{run.root}/read/{run.name}", run.work.count()
    whole = True
    for part in range(parts):
        if _read(spark, f"{run.root}/closed", CLOSED).where(F.col("run") == run.name).limit(1).count():
            whole = False
            break
        if _written(f"{out}/part={part}"):
            continue
        rows = run.work.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        spark.addTag(run.tag)
        try:
            ocr.recognize(rows, engine).write.mode("overwrite").parquet(f"{out}/part={part}")
        except Exception:
            if not _read(spark, f"{run.root}/closed", CLOSED).where(F.col("run") == run.name).limit(1).count():
                raise
            whole = False  # it was cancelled
            break
        finally:
            spark.removeTag(run.tag)
        if tell:
            tell(outcomes(run).count(), total)
    return outcomes(run), whole


def _written(path: str) -> bool:
    from capturelake.sources.files import place

    where, name = place(path)
    return where.get_file_info(f"{name}/_SUCCESS").is_file


def outcomes(run: Run) -> DataFrame:
    """What the parts that are whole have read."""
    spark, found = run.spark, [f"{run.root}/read/{run.name}/part={p}" for p in range(1024) if _written(f"{run.root}/read/{run.name}/part={p}")]
    return spark.read.schema(ocr.READ).parquet(*found) if found else spark.createDataFrame([], ocr.READ)


def close(run: Run, lib: Library, attempts: int = ocr.ATTEMPTS) -> tuple[Library, DataFrame]:
    """The library with what a run has read, and one row of counts; its claims are given up, so that what it hasn't read may be claimed again."""
    told = cut(outcomes(run), "ocr")
    counts = told.agg(F.count("*").alias("processed"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("done", "failed", "missing")))
    lib = lib.with_(captures=ocr.transition(lib.captures, told, attempts), ocr_text=ocr.save_text(lib.ocr_text, told))
    run.spark.createDataFrame([(run.name, "closed")], CLOSED).coalesce(1).write.mode("append").parquet(f"{run.root}/closed")
    return lib, counts


def waiting(run: Run, seconds: float, poll: float = 0.1) -> bool:
    """Wait until some part is written; False if none is in time."""
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        if outcomes(run).limit(1).count():
            return True
        time.sleep(poll)
    return False
