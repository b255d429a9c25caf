"""Tables of an image archive, declared once; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = 6

_KINDS = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _ddl(columns: str) -> T.StructType:
    """A schema from "name type, ...", without a session, as executors import this too."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


CAPTURES = _ddl(
    "id long, path string, filename string, size long, created_ts long, modified_ts long, width long, height long, format string, "
    "content_hash string, phash string, status string, ocr_status string, ocr_attempts long, source_dir_id long, app_name string, "
    "website_domain string, url string, window_title string, category string, category_confidence double, starred boolean, "
    "read_later boolean, note string, indexed_at timestamp, last_verified_at timestamp"
)
OCR_TEXT = _ddl("screenshot_id long, text string, language string, confidence float, engine_version string, extracted_at timestamp")
TAGS = _ddl("id long, name string")
SCREENSHOT_TAGS = _ddl("screenshot_id long, tag_id long, origin string")
COLLECTIONS = _ddl("id long, name string, type string, rule_json string, created_at timestamp")
COLLECTION_ITEMS = _ddl("collection_id long, screenshot_id long, added_at timestamp, origin string")
DIRECTORIES = _ddl("id long, path string, enabled boolean, added_at timestamp, last_scan_cursor string")
PROBLEMS = _ddl("id long, path string, kind string, message string, created_at timestamp")
FEEDBACK = _ddl("id long, screenshot_id long, target string, action string, created_at timestamp")
JOURNAL = _ddl("id long, batch_id string, screenshot_id long, old_path string, new_path string, temp_path string, created_at timestamp")
DELETED = _ddl(
    "id long, screenshot_id long, filename string, path string, created_ts long, modified_ts long, deleted_at timestamp, width long, height long, "
    "format string, size long, content_hash string, phash string, app_name string, website_domain string, url string, category string, "
    "starred boolean, note string, tags_json string, collections_json string, ocr_text string, keep_thumbnail boolean"
)

#: Columns of a grid row, of a cleanup row, and of a detail beyond the grid's.
BASE_COLS = ("id", "path", "filename", "created_ts", "width", "height", "format", "status", "ocr_status", "content_hash", "phash", "starred")
CLEANUP_COLS = ("id", "path", "filename", "size", "created_ts", "width", "height", "format", "content_hash", "starred")
DETAIL_COLS = (*BASE_COLS, "modified_ts", "read_later", "note", "app_name", "website_domain", "url", "window_title", "category", "category_confidence")

TABLES = {
    "captures": CAPTURES, "ocr_text": OCR_TEXT, "tags": TAGS, "screenshot_tags": SCREENSHOT_TAGS, "collections": COLLECTIONS,
    "collection_items": COLLECTION_ITEMS, "directories": DIRECTORIES, "problems": PROBLEMS, "feedback": FEEDBACK, "journal": JOURNAL, "deleted": DELETED,
}


@dataclass(frozen=True)
class Library:
    """All tables of an archive. Operators take one and return data frames or another one; nothing is changed in place."""

    captures: DataFrame
    ocr_text: DataFrame
    tags: DataFrame
    screenshot_tags: DataFrame
    collections: DataFrame
    collection_items: DataFrame
    directories: DataFrame
    problems: DataFrame
    feedback: DataFrame
    journal: DataFrame
    deleted: DataFrame
    settings: dict[str, str] = field(default_factory=dict)

    def with_(self, **tables) -> Library:
        return replace(self, **tables)

    def save(self, path: str) -> None:
        """One Parquet folder for each table; a new folder is a new version, and what a broken run left there goes."""
        for f in fields(self):
            if f.name in TABLES:
                getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")


def empty(spark: SparkSession, **tables: DataFrame) -> Library:
    """A library with the given tables, others without rows. Missing columns of a given table are null."""
    from pyspark.sql import functions as F

    def shaped(name: str) -> DataFrame:
        if name not in tables:
            return spark.createDataFrame([], TABLES[name])
        df = tables[name]
        return df.select(*(F.col(c.name).cast(c.dataType).alias(c.name) if c.name in df.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in TABLES[name]))

    return Library(**{name: shaped(name) for name in TABLES})


def load(spark: SparkSession, path: str) -> Library:
    return Library(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()})


def version_path(root: str, version: int, batch: int = -1) -> str:
    """Where a version of a library lies; ``batch``: the batch of a stream that made it."""
    return f"{root.rstrip('/')}/v{version:08d}" + (f"-{batch:08d}" if batch >= 0 else "")


def latest(root: str) -> str:
    """The last whole version below ``root``, a local or shared folder."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    names = sorted(i.base_name for i in where.get_file_info(fs.FileSelector(path)) if i.base_name[:1] == "v")
    whole = [n for n in names if all(where.get_file_info(f"{path.rstrip('/')}/{n}/{t}/_SUCCESS").is_file for t in TABLES)]
    if not whole:
        raise FileNotFoundError(f"no whole version of a library below {root}")
    return f"{root.rstrip('/')}/{whole[-1]}"


def version_of(path: str) -> int:
    return int(path.rpartition("/v")[2].partition("-")[0])


def batch_of(path: str) -> int:
    """The batch that made a version, -1 if none did."""
    return int(path.rpartition("/v")[2].partition("-")[2] or -1)
