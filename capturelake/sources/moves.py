"""Renaming files: every file first goes to a unique name in between, then to its new one.

So names may be swapped, go round in circles or differ in case alone, and no file is ever written over. Entries of the journal are written before
anything moves. If a file can't be moved away in the first phase, all that were go back, and nothing has happened. What fails in the second phase
stays under its name in between, with its record and its entry of the journal, for :func:`capturelake.operators.rename.reconcile`.

Each phase is one job over the files, whatever their number. A move that an earlier attempt of a task has made is found made, so tasks
may be run again or twice. Moves go through pyarrow's file systems; on stores whose moves copy, they take as long as copies do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions.text import filename, parent
from capturelake.operators.rename import clear_journal, journal
from capturelake.plans.lineage import cut
from capturelake.schemas import Library
from capturelake.sources.files import place

MISSING, OFFLINE, TWICE, TAKEN, GONE = "there is no such capture", "the file isn't there", "two of the files would have this name", "the name is taken", "the file is gone"


def move(source: str, target: str) -> str:
    """Move one file to a name that is free; says what went wrong, or nothing. A move that was made before is made."""
    from pyarrow.fs import FileType

    (where, a), (_, b) = place(source), place(target)
    for last in (False, True):
        here, there = (i.type for i in where.get_file_info([a, b]))
        if here == FileType.NotFound:
            return "" if there == FileType.File else GONE
        if there != FileType.NotFound:
            return TAKEN
        if last:
            return said
        try:
            where.move(a, b)
            return ""
        except OSError as e:  # it may be that another attempt has moved it meanwhile
            said = f"the file can't be moved: {e}"
    return ""


def _facts(path: str) -> tuple[bool, int | None, int | None]:
    """Whether a file is there, its size and time."""
    where, p = place(path)
    info = where.get_file_info(p)
    return info.is_file, info.size, None if info.mtime is None else int(info.mtime.timestamp())


def looked_up(rows: DataFrame, path: str, name: str) -> DataFrame:
    """``rows`` (id, ...) with a column that says whether a file is at ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_i": b["_i"], name: [_facts(p)[0] for p in b["_p"]]})

    found = rows.select(F.col("id").alias("_i"), F.col(path).alias("_p")).where("_p is not null").mapInPandas(run, f"_i long, {name} boolean")
    return rows.join(found, F.col("id") == F.col("_i"), "left").drop("_i").withColumn(name, F.coalesce(name, F.lit(False)))


def phase(rows: DataFrame, source: str, target: str, mover: Callable[[str, str], str] = move) -> DataFrame:
    """Move each row's file: (id, why, size, modified_ts), ``why`` empty where it is at its target now. Written, so that it runs once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            why = [mover(s, t) for s, t in zip(b["_s"], b["_t"], strict=True)]
            facts = [_facts(t) if not w else (False, None, None) for t, w in zip(b["_t"], why, strict=True)]
            yield pd.DataFrame({"id": b["id"], "why": why, "size": pd.array([f[1] for f in facts], "Int64"), "modified_ts": pd.array([f[2] for f in facts], "Int64")})

    jobs = rows.select("id", F.col(source).alias("_s"), F.col(target).alias("_t"))
    return cut(jobs.mapInPandas(run, "id long, why string, size long, modified_ts long"), "moved")


def checked(lib: Library, targets: DataFrame) -> DataFrame:
    """``targets`` (id, new_path, and seq for their order) with old_path and what speaks against each: ``why``, empty if nothing does, null if it is unchanged."""
    known = targets.join(lib.captures.select(F.col("id").alias("_id"), F.col("path").alias("old_path"), "status"), F.col("id") == F.col("_id"), "left").drop("_id")
    known = cut(looked_up(looked_up(known, "old_path", "_there"), "new_path", "_met"), "asked")
    lost = F.when(F.col("old_path").isNull(), MISSING).when((F.col("status") != "available") | ~F.col("_there"), OFFLINE)
    known = known.withColumns({"why": lost, "_same": lost.isNull() & (F.col("new_path") == F.col("old_path"))})
    fold = lambda c: F.concat(parent(F.col(c)), F.lit("/"), F.lower(filename(F.col(c))))
    work = known.where("why is null and not _same").withColumns({"_old": fold("old_path"), "_new": fold("new_path")})
    work = work.withColumn("_n", F.row_number().over(Window.partitionBy("_new").orderBy("seq", "id")))
    leaves = work.select(F.col("_old").alias("_away")).distinct()
    work = work.join(leaves, F.col("_new") == F.col("_away"), "left")
    others = lib.captures.select(F.col("path").alias("_path"), F.col("id").alias("_holder")).join(work.select(F.col("id").alias("_w")), F.col("_holder") == F.col("_w"), "left_anti").select("_path").distinct()
    work = work.join(others, F.col("new_path") == F.col("_path"), "left")
    why = F.when(F.col("_n") > 1, TWICE).when(F.col("_met") & F.col("_away").isNull(), TAKEN).when(F.col("_path").isNotNull(), TAKEN).otherwise("")
    work = work.select("id", "seq", "old_path", "new_path", why.alias("why"))
    rest = known.where("why is not null or _same").select("id", "seq", "old_path", "new_path", "why")
    return work.unionByName(rest)


def rename_files(lib: Library, targets: DataFrame, batch: str | None = None, mover: Callable[[str, str], str] = move) -> tuple[Library, DataFrame]:
    """Rename the files of ``targets`` (id, new_path, seq) and follow them in the library.

    Returns the library and a row for each target: id, old_path, new_path, outcome (renamed, unchanged, failed, reversed or between) and message.
    Files that some other's leaving sets free may be taken; a target whose holder fails its check fails with it."""
    batch = batch or uuid.uuid4().hex[:12]
    plan = cut(checked(lib, targets), "checked")
    while True:  # what stays where it is, since it failed, takes a name away from others: a round for each link of such a chain
        stays = plan.where("coalesce(why, 'same') <> ''").select(F.lower("old_path").alias("_kept")).where("_kept is not null").distinct()
        hit = plan.join(stays, (F.col("why") == "") & (F.lower("new_path") == F.col("_kept")), "left").withColumn("why", F.when(F.col("_kept").isNotNull(), TAKEN).otherwise(F.col("why"))).drop("_kept")
        before, plan = plan.where("why = ''").count(), cut(hit, "checked")
        if plan.where("why = ''").count() == before:
            break
    told = plan.where("coalesce(why, 'same') <> ''").select("id", "old_path", "new_path", F.when(F.col("why").isNull(), "unchanged").otherwise("failed").alias("outcome"), F.coalesce("why", F.lit("")).alias("message"))
    if not plan.where("why = ''").limit(1).count():
        return lib, told
    noted = journal(lib, plan.where("why = ''").select("id", "old_path", "new_path", F.lit("ok").alias("status")), batch)
    noted = noted.with_(journal=cut(noted.journal, "journal"))  # before anything moves
    work = noted.journal.where(F.col("batch_id") == batch).select(F.col("screenshot_id").alias("id"), "old_path", "new_path", "temp_path")
    away = phase(work, "old_path", "temp_path", mover)
    if away.where("why <> ''").limit(1).count():
        gone = work.join(away.where("why = ''"), "id", "left_semi")
        back = phase(gone, "temp_path", "old_path", mover).select("id", F.col("why").alias("still"))
        out = work.join(away.select("id", "why"), "id").join(back, "id", "left")
        outcome = F.when(F.col("why") != "", "failed").when(F.col("still") == "", "reversed").otherwise("between")
        told = told.unionByName(out.select("id", "old_path", "new_path", outcome.alias("outcome"), F.when(F.col("why") != "", F.col("why")).otherwise(F.coalesce("still", F.lit(""))).alias("message")))
        stuck = told.where("outcome = 'between'").select("id").limit(1).count()
        return (noted if stuck else clear_journal(noted, batch)), cut(told, "renamed")
    done = phase(work, "temp_path", "new_path", mover)
    out = cut(work.join(done, "id"), "placed")
    told = told.unionByName(out.select("id", "old_path", "new_path", F.when(F.col("why") == "", "renamed").otherwise("between").alias("outcome"), F.col("why").alias("message")))
    now = out.select(F.col("id").alias("_id"), F.when(F.col("why") == "", F.col("new_path")).otherwise(F.col("temp_path")).alias("_now"), F.col("size").alias("_size"), F.col("modified_ts").alias("_time"))
    shots = lib.captures.join(now, F.col("id") == F.col("_id"), "left")
    shots = shots.withColumns({"path": F.coalesce("_now", "path"), "filename": F.coalesce(filename(F.col("_now")), "filename"), "size": F.coalesce("_size", "size"), "modified_ts": F.coalesce("_time", "modified_ts")}).select(*lib.captures.columns)
    left = out.where("why <> ''").select(F.col("id").alias("_id"))
    rows = noted.journal.join(left, F.col("screenshot_id") == F.col("_id"), "left").where((F.col("batch_id") != batch) | F.col("_id").isNotNull()).drop("_id")
    return noted.with_(captures=shots, journal=rows), cut(told, "renamed")
