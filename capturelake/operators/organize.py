"""Lists, details, statistics, tags, collections, flags, problems, directories and settings.

Functions that change something return a new :class:`Library`.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.text import MAX_COLLECTION, MAX_NOTE, MAX_TAG, MAX_TARGET, capped_name, normalize_path
from capturelake.operators.predicates import available, ev, live
from capturelake.plans.lineage import numbered
from capturelake.schemas import BASE_COLS, DETAIL_COLS, Library

# --- lists and details -----------------------------------------------------------------------------------------------


def grid_page(captures: DataFrame, limit: int = 60, offset: int = 0) -> DataFrame:
    """Newest first."""
    return captures.where(live()).orderBy(ev().desc(), F.desc("id")).select(*BASE_COLS).offset(max(0, offset)).limit(max(0, limit))


def all_ids(captures: DataFrame) -> DataFrame:
    return captures.where(live()).orderBy(ev().desc(), F.desc("id")).select("id")


def collection_page(lib: Library, collection: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    items = lib.collection_items.where(F.col("collection_id") == collection).select(F.col("screenshot_id").alias("id"))
    df = lib.captures.where(live()).join(items, "id", "left_semi").orderBy(ev().desc(), F.desc("id")).select(*BASE_COLS)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def collection_item_ids(lib: Library, collection: int) -> DataFrame:
    return collection_page(lib, collection).select("id")


def detail(lib: Library, id_: int | None = None) -> DataFrame:
    """Captures with text and tags, in order without regard to case; one of them, or all."""
    shots = lib.captures if id_ is None else lib.captures.where(F.col("id") == id_)
    ocr = lib.ocr_text.select(F.col("screenshot_id").alias("id"), F.col("text").alias("ocr_text"), F.col("confidence").alias("ocr_confidence"))
    names = lib.screenshot_tags.join(lib.tags, F.col("tag_id") == F.col("id")).select(F.col("screenshot_id").alias("id"), "name")
    tags = names.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))), lambda s: s["name"]).alias("tags"))
    df = shots.select(*DETAIL_COLS).join(ocr, "id", "left").join(tags, "id", "left")
    return df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def path_by_content_hash(captures: DataFrame, hash_: str | None = None) -> DataFrame:
    """The available path with the least id for each content, or for one."""
    df = captures.where(available() & F.col("content_hash").isNotNull())
    df = df if hash_ is None else df.where(F.col("content_hash") == hash_)
    return df.groupBy("content_hash").agg(F.min_by("path", "id").alias("path"))


def library_stats(lib: Library) -> DataFrame:
    """One row of counts, over all rows or by status, and the least and greatest created_ts."""
    ocr = {f"ocr_{s}": F.count_if(F.col("ocr_status") == s) for s in ("none", "queued", "processing", "done", "failed")}
    stats = lib.captures.agg(
        F.count("*").alias("total"),
        F.count_if(available()).alias("available"),
        F.count_if(~live()).alias("missing"),
        F.count_if("starred").alias("starred"),
        *(c.alias(n) for n, c in ocr.items()),
        F.min("created_ts").alias("oldest"),
        F.max("created_ts").alias("newest"),
    )
    return stats.crossJoin(lib.problems.agg(F.count("*").alias("problems")))  # one row each


# --- tags ------------------------------------------------------------------------------------------------------------


def list_tags(lib: Library) -> DataFrame:
    """Tags with how many captures have them, missing ones too."""
    counts = lib.screenshot_tags.groupBy("tag_id").agg(F.count("*").alias("count"))
    return counts.join(lib.tags, F.col("tag_id") == F.col("id")).select("name", "count").orderBy(F.desc("count"), F.lower("name"))


def next_ids(df: DataFrame, key: str, order: Column, top: int) -> DataFrame:
    """``df`` with new ids above ``top``."""
    return numbered(df, key, [order], top + 1)


def _top(df: DataFrame, column: str = "id") -> int:
    return df.agg(F.max(column)).first()[0] or 0


def add_tag(lib: Library, id_: int, name: str, origin: str = "manual") -> Library:
    """Unknown captures change nothing; the first spelling and the first origin of a tag stay."""
    name = capped_name(name, MAX_TAG, "tag")
    spark = lib.tags.sparkSession
    if not lib.captures.where(F.col("id") == id_).limit(1).count():
        return lib
    known = lib.tags.where(F.lower("name") == name.lower()).first()
    tags, tag = lib.tags, known.id if known else _top(lib.tags) + 1
    if not known:
        tags = tags.unionByName(spark.createDataFrame([(tag, name)], lib.tags.schema))
    has = lib.screenshot_tags.where((F.col("screenshot_id") == id_) & (F.col("tag_id") == tag)).limit(1).count()
    links = lib.screenshot_tags if has else lib.screenshot_tags.unionByName(spark.createDataFrame([(id_, tag, origin)], lib.screenshot_tags.schema))
    return lib.with_(tags=tags, screenshot_tags=links)


def tag_all(lib: Library, ids: DataFrame, name: str, origin: str = "manual") -> Library:
    """A tag for all captures of ``ids`` (id), as :func:`add_tag` gives it to one."""
    name = capped_name(name, MAX_TAG, "tag")
    spark = lib.tags.sparkSession
    known = lib.tags.where(F.lower("name") == name.lower()).first()
    tags, tag = lib.tags, known.id if known else _top(lib.tags) + 1
    if not known:
        tags = tags.unionByName(spark.createDataFrame([(tag, name)], lib.tags.schema))
    have = lib.screenshot_tags.where(F.col("tag_id") == tag).select(F.col("screenshot_id").alias("id"))
    new = lib.captures.select("id").join(ids.select("id"), "id", "left_semi").join(have, "id", "left_anti")
    links = new.select(F.col("id").alias("screenshot_id"), F.lit(tag).cast("long").alias("tag_id"), F.lit(origin).alias("origin"))
    return lib.with_(tags=tags, screenshot_tags=lib.screenshot_tags.unionByName(links))


def prune_tags(lib: Library) -> Library:
    """Without tags that no capture has."""
    return lib.with_(tags=lib.tags.join(lib.screenshot_tags, F.col("id") == F.col("tag_id"), "left_semi"))


def remove_tag(lib: Library, id_: int, name: str) -> Library:
    tag = lib.tags.where(F.lower("name") == name.strip().lower()).select(F.col("id").alias("tag_id"))
    gone = lib.screenshot_tags.where(F.col("screenshot_id") == id_).join(tag, "tag_id", "left_semi")
    links = lib.screenshot_tags.join(gone, ["screenshot_id", "tag_id"], "left_anti")
    return prune_tags(lib.with_(screenshot_tags=links))


def tag_texts(lib: Library) -> DataFrame:
    """Names of each capture's tags in order, joined by spaces, as the text index has them."""
    names = lib.screenshot_tags.join(lib.tags, F.col("tag_id") == F.col("id")).select("screenshot_id", "name")
    return names.groupBy("screenshot_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("tags"))


# --- flags and notes -------------------------------------------------------------------------------------------------


def _set(lib: Library, id_: int, **values) -> Library:
    columns = {k: F.when(F.col("id") == id_, F.lit(v).cast(lib.captures.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()}
    return lib.with_(captures=lib.captures.withColumns(columns))


def set_starred(lib: Library, id_: int, on: bool) -> Library:
    return _set(lib, id_, starred=on)


def set_read_later(lib: Library, id_: int, on: bool) -> Library:
    return _set(lib, id_, read_later=on)


def set_note(lib: Library, id_: int, note: str) -> Library:
    return _set(lib, id_, note=note.strip()[:MAX_NOTE])


# --- collections -----------------------------------------------------------------------------------------------------


def list_collections(lib: Library) -> DataFrame:
    """All collections with how many live captures they hold, newest first."""
    shots = lib.captures.where(live()).select("id")
    counts = lib.collection_items.join(shots, F.col("screenshot_id") == F.col("id"), "left_semi").groupBy("collection_id").agg(F.count("*").alias("n"))
    df = lib.collections.join(counts, F.col("id") == F.col("collection_id"), "left")
    return df.select("id", "name", F.col("type").alias("kind"), F.coalesce("n", F.lit(0)).alias("item_count"), "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def collection_by_name(lib: Library, name: str) -> DataFrame:
    return list_collections(lib).where(F.col("name") == name)


def collections_of(lib: Library, id_: int | None = None) -> DataFrame:
    """Collections of one capture, or (screenshot_id, ...) of all, with live counts."""
    items = lib.collection_items if id_ is None else lib.collection_items.where(F.col("screenshot_id") == id_)
    return items.select("screenshot_id", F.col("collection_id").alias("id")).join(list_collections(lib), "id").select("screenshot_id", "id", "name", "kind", "item_count").orderBy("screenshot_id", "name")


def create_collection(lib: Library, name: str, kind: str = "manual", rule_json: str | None = None) -> tuple[Library, int]:
    """The library and the collection's id; an existing name (case counts) is returned as it is."""
    name = capped_name(name, MAX_COLLECTION, "collection")
    known = lib.collections.where(F.col("name") == name).first()
    if known:
        return lib, known.id
    new = _top(lib.collections) + 1
    row = lib.collections.sparkSession.range(1).select(F.lit(new).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(rule_json).cast("string").alias("rule_json"), F.current_timestamp().alias("created_at"))
    return lib.with_(collections=lib.collections.unionByName(row)), new


def rename_collection(lib: Library, id_: int, name: str) -> Library:
    name = capped_name(name, MAX_COLLECTION, "collection")
    if lib.collections.where((F.col("name") == name) & (F.col("id") != id_)).limit(1).count():
        raise ValueError(f"there is a collection {name!r}")
    return lib.with_(collections=lib.collections.withColumn("name", F.when(F.col("id") == id_, name).otherwise(F.col("name"))))


def delete_collection(lib: Library, id_: int) -> Library:
    return lib.with_(collections=lib.collections.where(F.col("id") != id_), collection_items=lib.collection_items.where(F.col("collection_id") != id_))


def set_collection_rule(lib: Library, id_: int, kind: str, rule_json: str | None) -> Library:
    hit = F.col("id") == id_
    return lib.with_(collections=lib.collections.withColumns({"type": F.when(hit, kind).otherwise(F.col("type")), "rule_json": F.when(hit, rule_json).otherwise(F.col("rule_json"))}))


def add_to_collection(lib: Library, collection: int, ids: DataFrame, origin: str = "manual") -> tuple[Library, DataFrame]:
    """Adds the known captures of ``ids`` that aren't in it; also returns those in it now (one row, ``present``)."""
    if not lib.collections.where(F.col("id") == collection).limit(1).count():
        raise ValueError(f"there is no collection {collection}")
    known = ids.select("id").distinct().join(lib.captures, "id", "left_semi")
    have = lib.collection_items.where(F.col("collection_id") == collection)
    new = known.join(have, F.col("id") == F.col("screenshot_id"), "left_anti")
    rows = new.select(F.lit(collection).cast("long").alias("collection_id"), F.col("id").alias("screenshot_id"), F.current_timestamp().alias("added_at"), F.lit(origin).alias("origin"))
    return lib.with_(collection_items=lib.collection_items.unionByName(rows)), known.agg(F.count("*").alias("present"))


def remove_from_collection(lib: Library, collection: int, id_: int) -> Library:
    return lib.with_(collection_items=lib.collection_items.where(~((F.col("collection_id") == collection) & (F.col("screenshot_id") == id_))))


# --- problems, directories, settings, feedback -----------------------------------------------------------------------


def record_problems(lib: Library, rows: DataFrame) -> Library:
    """``rows``: path, kind, message."""
    new = next_ids(rows, "id", F.col("path"), _top(lib.problems)).select(F.col("id").cast("long"), "path", "kind", "message", F.current_timestamp().alias("created_at"))
    return lib.with_(problems=lib.problems.unionByName(new))


def list_problems(lib: Library, limit: int = 200) -> DataFrame:
    return lib.problems.orderBy(F.desc("id")).limit(limit)


def clear_problems(lib: Library) -> Library:
    return lib.with_(problems=lib.problems.limit(0))


def add_directory(lib: Library, path: str) -> Library:
    path = normalize_path(path)
    if lib.directories.where(F.col("path") == path).limit(1).count():
        return lib
    row = lib.directories.sparkSession.range(1).select(F.lit(_top(lib.directories) + 1).cast("long").alias("id"), F.lit(path).alias("path"), F.lit(True).alias("enabled"), F.current_timestamp().alias("added_at"), F.lit(None).cast("string").alias("last_scan_cursor"))
    return lib.with_(directories=lib.directories.unionByName(row))


def remove_directory(lib: Library, path: str) -> Library:
    """Its captures stay."""
    return lib.with_(directories=lib.directories.where(F.col("path") != normalize_path(path)))


def list_directories(lib: Library) -> DataFrame:
    return lib.directories.orderBy("id")


def get_setting(lib: Library, key: str, default: str | None = None) -> str | None:
    return lib.settings.get(key, default)


def set_setting(lib: Library, key: str, value: str) -> Library:
    return replace(lib, settings={**lib.settings, key: value})


def record_feedback(lib: Library, target: str, action: str, id_: int | None = None) -> Library:
    """A verdict on a suggestion, for one capture or for all."""
    target = target.strip()
    if not target or len(target.encode()) > MAX_TARGET or action not in ("accept", "dismiss"):
        raise ValueError("a verdict needs a target and is accept or dismiss")
    row = lib.feedback.sparkSession.range(1).select(F.lit(_top(lib.feedback) + 1).cast("long").alias("id"), F.lit(id_).cast("long").alias("screenshot_id"), F.lit(target).alias("target"), F.lit(action).alias("action"), F.current_timestamp().alias("created_at"))
    return lib.with_(feedback=lib.feedback.unionByName(row))
