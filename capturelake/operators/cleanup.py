"""What could be cleaned up, and records of what was.

Moving files is not this engine's part: callers say what became of each file and the
tables follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.text import escape_like
from capturelake.operators.insights import DISTANCE, GAP, all_but_newest, burst_rows, exact_duplicates, similar_groups
from capturelake.operators.predicates import available, ev, large, no_text, old
from capturelake.plans.lineage import cut
from capturelake.schemas import CLEANUP_COLS, Library

DAYS, BYTES, PAGE = 365, 5_000_000, 200
_SORTS = {
    "oldest": lambda: [ev().asc(), F.asc("id")],
    "newest": lambda: [ev().desc(), F.desc("id")],
    "largest": lambda: [F.desc("size"), F.desc("id")],
}


def metadata_differs(lib: Library, strict: bool = False) -> DataFrame:
    """(content_hash, differs) of available captures: whether a group's members have different
    tags, collections, notes or marks.

    A member without tags or without collections has no fingerprint and isn't compared,
    unless ``strict``, where it counts as one without any.
    """
    tags = lib.screenshot_tags.join(lib.tags, F.col("tag_id") == F.col("id")).groupBy("screenshot_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("_tags"))
    cols = lib.collection_items.groupBy(F.col("screenshot_id").alias("_sid")).agg(F.array_join(F.array_sort(F.collect_list("collection_id")).cast("array<string>"), ",").alias("_cols"))
    df = lib.captures.where(available() & F.col("content_hash").isNotNull()).join(tags, F.col("id") == F.col("screenshot_id"), "left").join(cols, F.col("id") == F.col("_sid"), "left")
    part = (lambda c: F.coalesce(F.col(c), F.lit(""))) if strict else F.col
    print_ = F.concat(part("_tags"), F.lit("|"), part("_cols"), F.lit("|"), F.coalesce("note", F.lit("")), F.lit("|"), F.col("starred").cast("int").cast("string"), F.lit("|"), F.col("read_later").cast("int").cast("string"))
    return df.groupBy("content_hash").agg((F.count_distinct(print_) > 1).alias("differs"))


def exact_groups(lib: Library) -> DataFrame:
    """Exact groups with reclaim_bytes, keep_id (the newest) and metadata_warning; largest first."""
    alive = lib.captures.where(available() & F.col("content_hash").isNotNull())
    g = alive.groupBy(F.col("content_hash").alias("key")).agg(F.count("*").alias("count"), F.max_by(F.struct("id", "size"), F.struct(ev().alias("ev"), "id")).alias("keep")).where("count > 1")
    warn = metadata_differs(lib).withColumnRenamed("content_hash", "key")
    g = g.join(warn, "key").select("key", "count", ((F.col("count") - 1) * F.col("keep.size")).alias("reclaim_bytes"), F.col("keep.id").alias("keep_id"), F.col("differs").alias("metadata_warning"))
    return g.orderBy(F.desc("count"), "key")


def _stat(df: DataFrame, name: str, extra: str | None = None) -> DataFrame:
    out = [F.count("*").alias(f"{name}_count"), F.coalesce(F.sum("size"), F.lit(0)).alias(f"{name}_bytes")]
    return df.agg(*([F.count_distinct(extra).alias(f"{name}_groups")] if extra else []), *out)


def _with_text(lib: Library) -> DataFrame:
    """Available captures; of their texts, the first character that isn't a space, which tells whether a text is blank: whole texts aren't shuffled."""
    text = lib.ocr_text.select(F.col("screenshot_id").alias("_id"), F.substring(F.trim("text"), 1, 1).alias("text"))
    return lib.captures.where(available()).join(text, F.col("id") == F.col("_id"), "left").drop("_id")


def category(lib: Library, kind: str, now: int, days: int = DAYS, size: int = BYTES) -> DataFrame:
    """Available captures of one category: old, large or notext."""
    if kind == "old":
        return lib.captures.where(available() & old(now, days))
    if kind == "large":
        return lib.captures.where(available() & large(size))
    if kind == "notext":
        return _with_text(lib).where(no_text()).drop("text")
    raise ValueError(f"unknown category {kind!r}; there are old, large and notext")


def overview(lib: Library, now: int, days: int = DAYS, size: int = BYTES, gap: int = GAP, distance: int = DISTANCE) -> DataFrame:
    """One row for the whole library."""
    both = _with_text(lib)
    each = {"old": old(now, days), "large": large(size), "notext": no_text()}
    one = [F.count("*").alias("total_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")]
    for n, c in each.items():  # all categories in one pass
        one += [F.count_if(c).alias(f"{n}_count"), F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).alias(f"{n}_bytes")]
    out = both.agg(*one)
    exact = exact_groups(lib).agg(F.count("*").alias("exact_groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("exact_count"), F.coalesce(F.sum("reclaim_bytes"), F.lit(0)).alias("exact_reclaim_bytes"))
    near = cut(similar_groups(lib.captures, distance).select("key", F.explode("ids").alias("id")), "similar")
    near = _stat(near.join(lib.captures.select("id", "size"), "id"), "near", "key").withColumnRenamed("near_bytes", "near_candidate_bytes")
    rows = cut(burst_rows(lib.captures, gap), "bursts")
    many = rows.groupBy("session_start").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(available(), F.col("size"))), F.lit(0)).alias("b")).where("n > 1")
    bursts = many.agg(F.count("*").alias("burst_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("burst_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("burst_bytes"))
    for part in (exact, near, bursts):
        out = out.crossJoin(part)  # one row each
    return out.withColumns({"old_age_days": F.lit(days).cast("long"), "large_min_bytes": F.lit(size).cast("long")})


def items(lib: Library, kind: str, now: int, days: int = DAYS, size: int = BYTES, sort: str = "oldest", limit: int = PAGE, offset: int = 0) -> DataFrame:
    """One page of a category for review."""
    if sort not in _SORTS:
        raise ValueError(f"unknown order {sort!r}; there are {', '.join(_SORTS)}")
    page = category(lib, kind, now, days, size).orderBy(*_SORTS[sort]())
    return page.select(*CLEANUP_COLS).offset(max(0, offset)).limit(min(PAGE, max(1, limit)))


def items_total(lib: Library, kind: str, now: int, days: int = DAYS, size: int = BYTES) -> DataFrame:
    return category(lib, kind, now, days, size).agg(F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def category_ids(lib: Library, kind: str, now: int, days: int = DAYS, size: int = BYTES) -> DataFrame:
    return category(lib, kind, now, days, size).select("id").orderBy("id")


def selection_bytes(captures: DataFrame, ids: DataFrame) -> DataFrame:
    return captures.join(ids, "id", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


# --- deletion, restoring, and the records of it ------------------------------------------------------------------------


def delete(lib: Library, outcomes: DataFrame) -> tuple[Library, DataFrame]:
    """``outcomes``: (id, moved): true, false for a failure, null where the file was gone.

    Moved and gone captures become missing. Also returns (id, outcome): trashed, already_missing or failed.
    """
    known = lib.captures.select("id", "status").join(outcomes, "id")
    told = known.select("id", F.when((F.col("status") == "missing") | F.col("moved").isNull(), "already_missing").when(F.col("moved"), "trashed").otherwise("failed").alias("outcome"))
    gone = told.where("outcome <> 'failed'").select(F.col("id").alias("_id"))
    shots = lib.captures.join(gone, F.col("id") == F.col("_id"), "left")
    shots = shots.withColumn("status", F.when(F.col("_id").isNotNull(), "missing").otherwise(F.col("status"))).select(*lib.captures.columns)
    return lib.with_(captures=shots), told


def snapshots(lib: Library, ids: DataFrame) -> DataFrame:
    """Deleted-item records of captures: their data, with names of tags and collections as JSON."""
    tags = lib.screenshot_tags.join(lib.tags, F.col("tag_id") == F.col("id")).groupBy("screenshot_id").agg(F.to_json(F.array_sort(F.collect_list("name"))).alias("tags_json"))
    cols = lib.collection_items.join(lib.collections, F.col("collection_id") == F.col("id")).groupBy(F.col("screenshot_id").alias("_c")).agg(F.to_json(F.array_sort(F.collect_list("name"))).alias("collections_json"))
    text = lib.ocr_text.select(F.col("screenshot_id").alias("_t"), F.col("text").alias("ocr_text"))
    df = lib.captures.join(ids, "id", "left_semi").join(tags, F.col("id") == F.col("screenshot_id"), "left").drop("screenshot_id")
    df = df.join(cols, F.col("id") == F.col("_c"), "left").join(text, F.col("id") == F.col("_t"), "left")
    same = ("filename", "path", "created_ts", "modified_ts", "width", "height", "format", "size", "content_hash", "phash", "app_name", "website_domain", "url", "category", "starred", "note")
    none = F.lit("[]")
    return df.select(F.col("id").alias("screenshot_id"), *same, F.coalesce("tags_json", none).alias("tags_json"), F.coalesce("collections_json", none).alias("collections_json"), F.coalesce("ocr_text", F.lit("")).alias("ocr_text"))


def record_deleted(lib: Library, ids: DataFrame, keep_thumbnail: bool = True) -> Library:
    from capturelake.operators.organize import _top, next_ids

    new = next_ids(snapshots(lib, ids), "id", F.col("screenshot_id"), _top(lib.deleted))
    new = new.withColumns({"deleted_at": F.current_timestamp(), "keep_thumbnail": F.lit(keep_thumbnail), "id": F.col("id").cast("long")})
    return lib.with_(deleted=lib.deleted.unionByName(new.select(*lib.deleted.columns)))


def trash(lib: Library, outcomes: DataFrame, keep_records: bool = True) -> tuple[Library, DataFrame]:
    """Delete, with records for the files that this call moved."""
    after, told = delete(lib, outcomes)
    if keep_records:
        moved = told.where("outcome = 'trashed'").select("id")
        after = after.with_(deleted=record_deleted(lib, moved).deleted)
    return after, told


def deleted_items(lib: Library, query: str = "", limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Records whose name or text has the query, newest first; its percent signs and underscores match as spaces do."""
    df = lib.deleted
    words = query.strip().replace("%", " ").replace("_", " ")
    if words:
        like = f"%{escape_like(words)}%"
        df = df.where(F.col("filename").ilike(like) | F.col("ocr_text").ilike(like))
    return df.orderBy(F.desc("deleted_at"), F.desc("id")).offset(max(0, offset)).limit(min(PAGE, max(1, limit)))


def forget(lib: Library, id_: int | None = None) -> Library:
    """Without one record, or without all."""
    return lib.with_(deleted=lib.deleted.where(F.col("id") != id_) if id_ is not None else lib.deleted.limit(0))


def restore(lib: Library, ids: DataFrame, trashed: DataFrame) -> tuple[Library, DataFrame]:
    """``trashed``: (path, time_deleted, restored) as the caller found or moved them.

    The newest entry of a path counts. Also returns (id, outcome): restored, already_there or failed.
    """
    last = trashed.groupBy("path").agg(F.max_by("restored", "time_deleted").alias("restored"))
    df = lib.captures.join(ids, "id", "left_semi").join(last, "path", "left")
    told = df.select("id", F.when(F.col("status") != "missing", "already_there").when(F.coalesce("restored", F.lit(False)), "restored").otherwise("failed").alias("outcome"))
    back = told.where("outcome = 'restored'").select(F.col("id").alias("_id"))
    shots = lib.captures.join(back, F.col("id") == F.col("_id"), "left").withColumn("status", F.when(F.col("_id").isNotNull(), "available").otherwise(F.col("status")))
    return lib.with_(captures=shots.select(*lib.captures.columns)), told


def redundant_ids(captures: DataFrame) -> DataFrame:
    """Members of all exact groups but the newest, for keeping one copy everywhere."""
    return all_but_newest(captures)
