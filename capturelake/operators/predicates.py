"""Named predicates. Two kinds of liveness are kept apart on purpose: lists, search and
bursts take all that isn't missing, duplicates, cleanup and suggestions only what is available."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.text import escape_like
from capturelake.plans.query_parser import Filter
from capturelake.schemas import Library

#: Choices that a caller may make: ages in days, sizes in bytes.
AGES, SIZES = (30, 90, 180, 365, 730), (2_000_000, 5_000_000, 10_000_000)


def ev() -> Column:
    """Event time."""
    return F.coalesce(F.col("created_ts"), F.col("modified_ts"))


def live() -> Column:
    return F.col("status") != "missing"


def available() -> Column:
    return F.col("status") == "available"


def contains(column: str, value: str) -> Column:
    """LIKE %value%; percent signs and underscores of the value stay wild."""
    return F.col(column).ilike(f"%{escape_like(value)}%")


def has_text(ocr: DataFrame) -> DataFrame:
    """Ids with text that isn't blank."""
    return ocr.where(F.length(F.trim("text")) > 0).select(F.col("screenshot_id").alias("id"))


def old(now: int, days: int) -> Column:
    if days not in AGES:
        raise ValueError(f"unknown age {days}; there are {AGES}")
    return ev() < now - days * 86_400


def large(size: int) -> Column:
    if size not in SIZES:
        raise ValueError(f"unknown size {size}; there are {SIZES}")
    return F.col("size") >= size


def no_text(text: str = "text") -> Column:
    """Not read, or read and blank; ``text``: a column joined on the left."""
    return (F.col("ocr_status") != "done") | (F.trim(F.coalesce(F.col(text), F.lit(""))) == "")


def apply_filter(df: DataFrame, f: Filter, lib: Library) -> DataFrame:
    """Rows of captures that pass one filter of a query. Memberships are semi joins."""
    v = f.value
    if f.kind == "after":
        return df.where(ev() >= v)
    if f.kind == "before":
        return df.where(ev() < v)
    if f.kind == "app":
        return df.where(contains("app_name", v))
    if f.kind == "site":
        return df.where(contains("website_domain", v) | contains("url", v))
    if f.kind == "format":
        return df.where(F.lower("format") == v.lower())
    if f.kind == "starred":
        return df.where(F.col("starred") == v)
    if f.kind == "dir":
        return df.where(F.lower("path").startswith(F.lit(v.rstrip(os.sep).lower() + os.sep)))
    if f.kind == "tag":
        ids = lib.screenshot_tags.join(lib.tags.where(contains("name", v)), F.col("tag_id") == F.col("id"), "left_semi").select(F.col("screenshot_id").alias("id"))
        return df.join(ids, "id", "left_semi")
    if f.kind == "collection":
        ids = lib.collection_items.join(lib.collections.where(contains("name", v)), F.col("collection_id") == F.col("id"), "left_semi").select(F.col("screenshot_id").alias("id"))
        return df.join(ids, "id", "left_semi")
    if f.kind == "has_text":
        return df.join(has_text(lib.ocr_text), "id", "left_semi" if v else "left_anti")
    if f.kind == "duplicate":  # counted over all rows, missing ones too
        twice = lib.captures.where("content_hash is not null").groupBy("content_hash").count().where("count > 1").select("content_hash")
        return df.join(twice, "content_hash", "left_semi").select(*df.columns)
    raise ValueError(f"unknown filter {f.kind}")
