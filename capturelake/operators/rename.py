"""Rename plans, their journal, and what a run of moves did to the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions.text import extension, filename, parent, render_template, safe_basename, stem
from capturelake.operators.predicates import ev
from capturelake.plans.lineage import cut, numbered
from capturelake.schemas import Library

ORDERS, STRATEGIES = ("grid", "oldest", "newest", "name"), ("stop", "append")
MOST_BYTES, MOST_SUFFIX, STALE_SECONDS = 255, 100, 600
PLAN = "id long, old_path string, new_path string, status string, message string, sanitized boolean, place long"
#: What a plan says of a row.
LOST, OFFLINE, SAME = "this capture isn't in the library", "the file isn't there", "has this name already"
LONG, TWICE, TAKEN, NUMBERED, FULL = f"the name has more than {MOST_BYTES} bytes", "an earlier file of the plan takes this name", "a file of this name is there", "a number keeps it apart", f"all numbers up to {MOST_SUFFIX} are taken"


def first_collection(lib: Library) -> DataFrame:
    """The first collection by name of each capture."""
    return lib.collection_items.join(lib.collections, F.col("collection_id") == F.col("id")).groupBy("screenshot_id").agg(F.min("name").alias("collection"))


def ordered(df: DataFrame, order: str) -> DataFrame:
    """Add ``place`` from 0 in the chosen order; ``seq`` is the order the caller gave."""
    by = {
        "grid": [F.asc("seq")],
        "oldest": [F.asc("ts"), F.asc("id")],
        "newest": [F.desc("ts"), F.asc("id")],
        "name": [F.lower("filename").asc(), F.asc("id")],
    }
    if order not in by:
        raise ValueError(f"unknown order {order!r}; there are {', '.join(ORDERS)}")
    return numbered(df, "place", by[order])


def family(name: Column) -> Column:
    """Names of different families can't collide: a name in lower case without numbers that were, or could be, appended."""
    number = rf"(-([2-9]|[1-9][0-9]|{MOST_SUFFIX}))+"
    return F.regexp_replace(F.regexp_replace(F.lower(name), rf"{number}$", ""), rf"{number}(\.[^.]*)$", "$3")


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers for one directory and family, in order of place, among names claimed before and files that stay."""
    busy = set(pdf.loc[pdf["kind"] == "file", "key"])
    rows = []
    for r in pdf[pdf["kind"] == "plan"].sort_values("place").itertuples():
        number = next((n for n in range(1, MOST_SUFFIX + 1) if _name(r.lbase, n, r.lext) not in busy), 0)
        if number:
            busy.add(_name(r.lbase, number, r.lext))
        rows.append((r.id, number))
    return pd.DataFrame(rows, columns=["id", "number"])


def _name(base: str, n: int, ext: str) -> str:
    return f"{base}-{n}{ext}" if n > 1 else base + ext


def _files_that_stay(plan: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, key) of files in the plan's directories that the plan doesn't rename."""
    there = files.select(parent(F.col("path")).alias("dir"), F.lower(filename(F.col("path"))).alias("key")).distinct()
    return there.join(plan.select("dir", F.col("old_key").alias("key")), ["dir", "key"], "left_anti")


def _contested(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Names (dir, key) that more than one row of the plan wants or a file keeps: how many rows, the first one's place, and whether a file stays there."""
    stay = _files_that_stay(plan, files).withColumn("stays", F.lit(True))
    wanted = plan.where("verdict is null").groupBy("dir", "key").agg(F.count("*").alias("n"), F.min("place").alias("first"), (F.min("lext") != F.max("lext")).alias("mixed"))
    return wanted.join(stay, ["dir", "key"], "full").select("dir", "key", F.coalesce("n", F.lit(0)).alias("n"), "first", F.coalesce("mixed", F.lit(False)).alias("mixed"), F.coalesce("stays", F.lit(False)).alias("stays"))


def _stopped(plan: DataFrame, names: DataFrame) -> DataFrame:
    """The first row takes a name unless a file stays there; all others are conflicts."""
    own = names.where("n > 0 and (n > 1 or stays)").drop("n", "mixed")
    first = F.col("first") == F.col("place")
    told = F.when(F.col("first").isNull(), 1).when(F.col("stays"), 0).when(first, 1).otherwise(0)
    df = plan.where("verdict is null").join(own, ["dir", "key"], "left").withColumn("number", told)
    return df.withColumn("why", F.when(F.col("number") == 1, "").when(F.col("stays"), TAKEN).otherwise(TWICE)).drop("first", "stays")


def _appended(plan: DataFrame, names: DataFrame) -> DataFrame:
    """A number for each row of a name that others want too, up to MOST_SUFFIX; 0 where none is left.

    Rows are numbered by their rank among those of their name, of which no more than MOST_SUFFIX can
    get one, so that a rank is never sought beyond it. Names that
    meet others' numbered ones, as "a-2" does those of "a", are settled family by family: MOST_SUFFIX rows of each name.
    """
    names = cut(names.withColumn("family", family(F.col("key"))), "names")
    mixed = names.groupBy("dir", "family").agg(F.count("*").alias("keys"), F.max((F.col("n") > 1) | (F.col("stays") & (F.col("n") > 0))).alias("needs"), F.max("mixed").alias("mixed"))
    knit = cut(mixed.where("needs and (keys > 1 or mixed)").select("dir", "family", F.lit(True).alias("knit")), "families")
    own = names.join(knit, ["dir", "family"], "left").where("knit or n > 1 or (stays and n > 0)").select("dir", "key", "stays", F.coalesce("knit", F.lit(False)).alias("knit"), "family")
    own = cut(own, "contested")
    rows = plan.where("verdict is null")
    alone = rows.join(own, ["dir", "key"], "left_anti").withColumn("number", F.lit(1))
    among = rows.join(own, ["dir", "key"])
    rank = F.row_number().over(Window.partitionBy("dir", "key").orderBy("place"))
    top = cut(among.withColumn("rank", rank).where(F.col("rank") <= MOST_SUFFIX), "ranked")
    last = cut(top.groupBy("dir", "key").agg(F.max("place").alias("last"), F.count("*").alias("n")).where(F.col("n") == MOST_SUFFIX).select("dir", "key", "last"), "last")
    late = rows.join(last, ["dir", "key"]).where("place > last").select(*rows.columns, F.lit(0).alias("number"))
    after = F.col("rank") + F.col("stays").cast("int")
    plain = top.where("not knit").withColumn("number", F.when(after <= MOST_SUFFIX, after).otherwise(0))
    kept = names.where("stays").join(knit, ["dir", "family"]).select(F.lit("file").alias("kind"), "dir", "family", "key", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("place"), F.lit("").alias("lbase"), F.lit("").alias("lext"))
    tied = top.where("knit").select(F.lit("plan").alias("kind"), "dir", "family", "key", "id", "place", "lbase", "lext")
    settled = tied.unionByName(kept).groupBy("dir", "family").applyInPandas(_settle, "id long, number int")
    tied = top.where("knit").join(settled, "id")
    df = alone.unionByName(late).unionByName(plain.select(*alone.columns)).unionByName(tied.select(*alone.columns))
    return df.withColumn("why", F.when(F.col("number") == 0, FULL).when(F.col("number") > 1, NUMBERED).otherwise(""))


def preview(lib: Library, ids: DataFrame, pattern: str, order: str = "grid", strategy: str = "stop", start: int = 0, padding: int = 3, files: DataFrame | None = None) -> DataFrame:
    """A plan, one row for each id of ``ids`` (id, seq): id, old_path, new_path, status (ok, skipped, conflict), message, sanitized, place.

    ``files``: (path) of files that exist; those of the library if not given. Files that are themselves renamed give way.
    A pattern that gives an empty name is an error.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    known = ids.join(lib.captures, "id", "left").join(first_collection(lib), F.col("id") == F.col("screenshot_id"), "left")
    lost = known.where(F.col("path").isNull() | (F.col("status") != "available"))
    lost = lost.select("id", F.coalesce("path", F.lit("")).alias("old_path"), F.lit("").alias("new_path"), F.lit("skipped").alias("status"), F.when(F.col("path").isNull(), LOST).otherwise(OFFLINE).alias("message"), F.lit(False).alias("sanitized"), F.lit(-1).cast("long").alias("place"))
    good = ordered(known.where("status = 'available'").withColumn("ts", F.coalesce(ev(), F.lit(0))), order)
    name = F.col("filename")
    raw = render_template(pattern, F.lit(max(0, start)) + F.col("place"), padding, F.col("ts"), stem(name), F.col("collection"), F.col("app_name"))
    good = good.withColumns({"raw": raw}).withColumns({"base": safe_basename(F.col("raw")), "ext": extension(name)})
    good = good.withColumn("base", F.when(F.col("base") == "", F.raise_error(F.lit("the pattern gives an empty file name"))).otherwise(F.col("base")))
    new = F.concat("base", "ext")
    verdict = F.when(F.octet_length(new) > MOST_BYTES, LONG).when(new == name, SAME)
    plan = good.select(parent(F.col("path")).alias("dir"), "id", "place", F.col("path").alias("old_path"), "base", "ext", F.lower("base").alias("lbase"), F.lower("ext").alias("lext"), F.lower(new).alias("key"), (F.col("base") != F.col("raw")).alias("sanitized"), F.lower("filename").alias("old_key"), verdict.alias("verdict"))
    plan = cut(plan, "plan")
    files = lib.captures.where("status = 'available'").select("path") if files is None else files
    names = _contested(plan, files)
    free = (_stopped if strategy == "stop" else _appended)(plan, names)
    number = F.when(F.col("number") > 1, F.concat(F.lit("-"), F.col("number").cast("string"))).otherwise("")
    free = free.select("id", "old_path", F.concat("dir", F.lit("/"), "base", number, "ext").alias("new_path"), F.when(F.col("number") > 0, "ok").otherwise("conflict").alias("status"), F.col("why").alias("message"), "sanitized", "place")
    told = plan.where("verdict is not null")
    long = F.col("verdict") == LONG
    told = told.select("id", "old_path", F.when(long, "").otherwise(F.col("old_path")).alias("new_path"), F.when(long, "conflict").otherwise("skipped").alias("status"), F.col("verdict").alias("message"), "sanitized", "place")
    return free.union(told).union(lost).orderBy("place", "id")


def directories(plan: DataFrame) -> DataFrame:
    return plan.where("old_path <> ''").select(parent(F.col("old_path")).alias("dir")).distinct().orderBy("dir")


def validate(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The plan again before it is run: sources that are gone and targets that came up are conflicts."""
    go = plan.where("status = 'ok'")
    here = files.select(F.col("path").alias("_p")).distinct()
    df = go.join(here, go.old_path == F.col("_p"), "left").withColumnRenamed("_p", "_source")
    taken = files.join(go.select("old_path"), F.col("path") == F.col("old_path"), "left_anti").select(F.lower("path").alias("_t")).distinct()
    df = df.join(taken, F.lower("new_path") == F.col("_t"), "left")
    status = F.when(F.col("_source").isNull() | F.col("_t").isNotNull(), "conflict").otherwise("ok")
    return df.select("id", "old_path", "new_path", status.alias("status"), F.when(F.col("_source").isNull(), "the file is gone").when(F.col("_t").isNotNull(), "the name is taken").otherwise("").alias("message"))


def journal(lib: Library, plan: DataFrame, batch: str) -> Library:
    """Intents of a batch, written before anything moves; each has a unique name in between."""
    from capturelake.operators.organize import _top, next_ids

    rows = next_ids(plan.where("status = 'ok'"), "_row", F.col("id"), _top(lib.journal))
    temp = F.concat(parent(F.col("old_path")), F.lit(f"/.rename-{batch}-"), F.col("id").cast("string"), extension(filename(F.col("old_path"))))
    rows = rows.select(F.col("_row").cast("long").alias("id"), F.lit(batch).alias("batch_id"), F.col("id").alias("screenshot_id"), "old_path", "new_path", temp.alias("temp_path"), F.current_timestamp().alias("created_at"))
    return lib.with_(journal=lib.journal.unionByName(rows))


def clear_journal(lib: Library, batch: str | None = None, entry: int | None = None) -> Library:
    """Without a batch, or without one entry."""
    keep = F.col("batch_id") != batch if batch is not None else F.col("id") != entry
    return lib.with_(journal=lib.journal.where(keep))


def stale(lib: Library, now: int, seconds: int = STALE_SECONDS) -> DataFrame:
    """Entries older than ten minutes."""
    return lib.journal.where(F.unix_timestamp("created_at") < now - seconds)


def pending_paths(lib: Library) -> DataFrame:
    """All paths that a rename in progress touches; a watcher leaves these alone."""
    return lib.journal.select(F.explode(F.array("old_path", "new_path", "temp_path")).alias("path")).where("path is not null").distinct()


def execute(lib: Library, outcomes: DataFrame) -> tuple[Library, DataFrame]:
    """``outcomes``: (id, old_path, new_path, moved) of a run; captures follow the files that moved."""
    done = outcomes.where("moved").select(F.col("id").alias("_id"), F.col("new_path").alias("_new"))
    shots = lib.captures.join(done, F.col("id") == F.col("_id"), "left")
    shots = shots.withColumns({"path": F.coalesce("_new", "path"), "filename": F.coalesce(filename(F.col("_new")), "filename")}).select(*lib.captures.columns)
    counts = outcomes.agg(F.count_if("moved").alias("renamed"), F.count_if(~F.col("moved")).alias("failed"))
    return lib.with_(captures=shots), counts


def reconcile(lib: Library, files: DataFrame, now: int) -> tuple[Library, DataFrame]:
    """Stale entries against the files that exist: new path, else old path, else missing; a
    file under its name in between is reported and never removed.
    """
    here = files.select(F.col("path").alias("_p")).distinct()
    df = stale(lib, now).join(here.withColumnRenamed("_p", "_new"), F.col("new_path") == F.col("_new"), "left").join(here.withColumnRenamed("_p", "_old"), F.col("old_path") == F.col("_old"), "left").join(here.withColumnRenamed("_p", "_tmp"), F.col("temp_path") == F.col("_tmp"), "left")
    outcome = F.when(F.col("_new").isNotNull(), "new").when(F.col("_old").isNotNull(), "old").when(F.col("_tmp").isNotNull(), "temp_only").otherwise("missing")
    told = df.select(F.col("id").alias("entry"), "screenshot_id", outcome.alias("outcome"), F.coalesce("_new", "_old").alias("path"))
    last = told.groupBy(F.col("screenshot_id").alias("_id")).agg(F.max_by(F.struct("outcome", "path"), "entry").alias("t"))
    shots = lib.captures.join(last, F.col("id") == F.col("_id"), "left")
    shots = shots.withColumns({
        "status": F.when(F.col("t.outcome") == "missing", "missing").otherwise(F.col("status")),
        "filename": F.coalesce(filename(F.col("t.path")), "filename"),
        "path": F.coalesce("t.path", "path"),
    }).select(*lib.captures.columns)
    rest = lib.journal.join(told.where("outcome <> 'temp_only'"), F.col("id") == F.col("entry"), "left_anti")
    return lib.with_(captures=shots, journal=rest), told
