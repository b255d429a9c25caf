"""The driver's tables seen as an image archive; ``oracles.PREFIX`` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.operators import text_index
from capturelake.plans.lineage import shared_path
from capturelake.schemas import Library, empty

#: The clock of all queries.
NOW = 1788350400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> Library:
    """Documents as captures with their texts; labels as marks, tags and what is filed; sources as collections."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    light = docs.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("content_hash"))  # a text's hash moves, not the text
    d = light.join(labels, "doc_id", "left")
    ext = F.when(F.col("lang") == "en", "png").when(F.col("lang") == "de", "jpg").when(F.col("lang") == "fr", "webp").otherwise("gif")
    name = F.concat(F.lit("shot_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    at = F.lit(NOW) - ((F.col("doc_id") % 700) * 90001 + F.floor(F.col("doc_id") / 700) * 600)
    captures = d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/archive/"), F.col("source"), F.lit("/"), name).alias("path"),
        name.alias("filename"),
        F.col("n_chars").alias("size"),
        F.when(F.col("n_chars") % 13 != 0, at).alias("created_ts"),
        (at + 5).alias("modified_ts"),
        (F.lit(640) + F.col("n_chars") % 1280).alias("width"),
        F.lit(480).alias("height"),
        ext.alias("format"),
        "content_hash",
        F.substring("content_hash", 1, 16).alias("phash"),
        F.when(F.col("toxic") == 1, "missing").otherwise("available").alias("status"),
        F.when(F.col("n_chars") < 400, "queued").otherwise("done").alias("ocr_status"),
        (F.col("n_chars") % 4).alias("ocr_attempts"),
        F.col("source").alias("app_name"),
        F.concat("lang", F.lit(".example.com")).alias("website_domain"),
        F.col("lang").alias("category"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("starred"),
        F.lit(False).alias("read_later"),
        F.lit("").alias("note"),
    )
    text = docs.where("n_chars >= 400").select(F.col("doc_id").alias("screenshot_id"), "text")
    names = [(1, "en"), (2, "de"), (3, "es"), (4, "fr"), (6, "quality 0"), (7, "quality 1")]
    lang = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "es", 3).otherwise(4)
    links = d.select(F.col("doc_id").alias("screenshot_id"), lang.alias("tag_id")).union(d.where("quality is not null").select("doc_id", F.col("quality") + 6))
    sources = docs.where("source is not null").select("source").distinct()
    number = F.substring("source", 4, 9).try_cast("long") + 1
    collections = sources.select(number.alias("id"), F.col("source").alias("name"), F.lit("manual").alias("type"), F.timestamp_seconds(number * 86400).alias("created_at"))
    items = d.where("quality is not null and source is not null").select(number.alias("collection_id"), F.col("doc_id").alias("screenshot_id"))
    return empty(
        spark,
        captures=captures,
        ocr_text=text,
        tags=spark.createDataFrame(names, "id long, name string"),
        screenshot_tags=links.withColumn("origin", F.lit("manual")),
        collections=collections,
        collection_items=items,
    )


_INDEXES: dict[tuple[str, str], text_index.TextIndex] = {}


def indexed(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    """The text index of :func:`archive`, written once for an application, as ingest would."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = text_index.build(archive(spark, sf_dir), shared_path(spark, "text-index"))
    return _INDEXES[key]


def timeline(spark: SparkSession, sf_dir: str) -> Library:
    """Events as captures: their type is the category, their user the app."""
    e = table(spark, sf_dir, "events")
    captures = e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("/events/"), F.col("event_id").cast("string"), F.lit(".png")).alias("path"),
        F.concat(F.col("event_id").cast("string"), F.lit(".png")).alias("filename"),
        F.lit(1).alias("size"),
        F.col("ts").cast("timestamp").cast("long").alias("created_ts"),
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("content_hash"),
        F.lit("available").alias("status"),
        F.lit("none").alias("ocr_status"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("app_name"),
        F.col("event_type").alias("category"),
        F.lit(False).alias("starred"),
    )
    kinds = e.select("event_type").distinct().select(F.ascii("event_type").cast("long").alias("k"), "event_type")
    tags = kinds.select(F.crc32(F.col("event_type").cast("binary")).alias("id"), F.concat(F.lit("is "), "event_type").alias("name"))
    links = e.select(F.col("event_id").alias("screenshot_id"), F.crc32(F.col("event_type").cast("binary")).alias("tag_id"))
    return empty(spark, captures=captures, tags=tags, screenshot_tags=links.withColumn("origin", F.lit("manual")))


def sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, bits): the signs of the first 63 numbers of each vector."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.aggregate(F.slice("embedding", 1, 63), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0).cast("long"))
    return e.select(F.col("vec_id").alias("id"), bits.alias("bits"))
