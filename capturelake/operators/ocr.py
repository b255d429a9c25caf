"""Text recognition as a batch over a queue of captures.

One call is one run: every claimable capture is read once, in parallel by partition, so
nothing needs to be locked. The engine is a function from a path to (text, confidence) that
raises where it fails, and FileNotFoundError where the file is gone.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.operators.predicates import available
from capturelake.schemas import Library

ATTEMPTS = 3
Engine = Callable[[str], tuple[str, float | None]]
READ = "id long, outcome string, text string, confidence float, message string"


def tesseract(path: str, language: str = "eng") -> tuple[str, float | None]:
    """The program of that name, where there is one."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    program = shutil.which("tesseract")
    if not program:
        raise RuntimeError("there is no tesseract on the path")
    done = subprocess.run([program, path, "stdout", "-l", language], capture_output=True, text=True, timeout=300, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.strip()[:500])
    return done.stdout.strip(), None


def by_name(path: str) -> tuple[str, float | None]:
    """A stand-in for tests: the file's name, with spaces for marks."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return os.path.splitext(os.path.basename(path))[0].replace("_", " ").replace("-", " "), 0.95


def claimable(captures: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Available, not read yet or queued again, and not tried too often."""
    return captures.where(F.col("ocr_status").isin("none", "queued") & available() & (F.coalesce("ocr_attempts", F.lit(0)) < attempts))


def claimable_count(captures: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    return claimable(captures, attempts).agg(F.count("*").alias("count"))


def candidate(captures: DataFrame, id_: int) -> DataFrame:
    return captures.where(available() & (F.col("id") == id_))


def recognize(work: DataFrame, engine: Engine) -> DataFrame:
    """(id, outcome, text, confidence, message) of each row of ``work``: done, failed or missing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, path in zip(pdf["id"], pdf["path"], strict=True):
                try:
                    text, sure = engine(path)
                    rows.append((i, "done", text, sure, None))
                except FileNotFoundError:
                    rows.append((i, "missing", None, None, None))
                except Exception as e:  # an engine may fail in any way; the queue goes on
                    rows.append((i, "failed", None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["id", "outcome", "text", "confidence", "message"])

    return work.select("id", "path").mapInPandas(run, READ)


def transition(captures: DataFrame, outcomes: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Captures after a run: done; one more attempt, then queued or failed; missing and queued."""
    told = outcomes.select(F.col("id").alias("_id"), "outcome")
    df = captures.join(told, F.col("id") == F.col("_id"), "left")
    tried = F.coalesce("ocr_attempts", F.lit(0)) + F.when(F.col("outcome") == "failed", 1).otherwise(0)
    state = (
        F.when(F.col("outcome") == "done", "done")
        .when(F.col("outcome") == "missing", "queued")
        .when(F.col("outcome") == "failed", F.when(tried >= attempts, "failed").otherwise("queued"))
        .otherwise(F.col("ocr_status"))
    )
    status = F.when(F.col("outcome") == "missing", "missing").otherwise(F.col("status"))
    return df.withColumns({"ocr_status": state, "ocr_attempts": tried.cast("long"), "status": status}).select(*captures.columns)


def save_text(ocr: DataFrame, outcomes: DataFrame, engine_version: str = "") -> DataFrame:
    """The text table with the texts of a run in place of older ones."""
    done = outcomes.where("outcome = 'done'")
    kept = ocr.join(done.select(F.col("id").alias("_id")), F.col("screenshot_id") == F.col("_id"), "left_anti")
    new = done.select(F.col("id").alias("screenshot_id"), "text", F.lit("eng").alias("language"), F.col("confidence").cast("float").alias("confidence"), F.lit(engine_version).alias("engine_version"), F.current_timestamp().alias("extracted_at"))
    return kept.unionByName(new)


def run(lib: Library, engine: Engine = tesseract, attempts: int = ATTEMPTS, paused: bool = False) -> tuple[Library, DataFrame]:
    """One run over the queue; also one row of counts. A pause (on battery, cancelled) reads nothing."""
    from capturelake.plans.lineage import cut

    work = claimable(lib.captures, attempts)
    outcomes = cut(recognize(work.limit(0) if paused else work, engine), "ocr")  # engines aren't asked twice
    counts = outcomes.agg(F.count("*").alias("processed"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("done", "failed", "missing")))
    return lib.with_(captures=transition(lib.captures, outcomes, attempts), ocr_text=save_text(lib.ocr_text, outcomes)), counts


def retry_failed(captures: DataFrame) -> DataFrame:
    """Failed captures are queued again, with all their attempts."""
    again = F.col("ocr_status") == "failed"
    return captures.withColumns({"ocr_attempts": F.when(again, 0).otherwise(F.col("ocr_attempts")).cast("long"), "ocr_status": F.when(again, "queued").otherwise(F.col("ocr_status"))})


def queue(captures: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("id").alias("_id")).distinct()
    df = captures.join(hit, F.col("id") == F.col("_id"), "left")
    return df.withColumn("ocr_status", F.when(F.col("_id").isNotNull(), "queued").otherwise(F.col("ocr_status"))).select(*captures.columns)
