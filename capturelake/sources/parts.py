"""A saved library of which a change rewrites only the parts it touches.

Tables lie in parts by ranges of their ids, ``rows`` ids each; those about a capture by the capture's id. A version is a small file that
names the folder of each table's parts; folders are never changed. A commit writes new folders for the parts it was given, then the next
version's file, so readers of older versions go on, and a commit that breaks off leaves nothing but folders that no version names
(:func:`expire` removes these). There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.schemas import TABLES, Library
from capturelake.sources.files import place, put

#: Ids in a part: a thousand million captures have ten thousand parts, which a version's file names.
ROWS = 100_000
#: Tables about captures, in parts by the capture's id, and those in parts by their own; others are one part.
BY_CAPTURE = {"captures": "id", "ocr_text": "screenshot_id", "screenshot_tags": "screenshot_id", "collection_items": "screenshot_id"}
BY_ID = {"problems": "id", "feedback": "id", "journal": "id", "deleted": "id"}


def _part(table: str, rows: int) -> Column:
    key = (BY_CAPTURE | BY_ID).get(table)
    return (F.coalesce(F.floor(F.col(key) / rows), F.lit(0)) if key else F.lit(0)).cast("long")


@dataclass(frozen=True)
class Parts:
    """A version: ``tables`` has the folder of each part. ``batch``: the batch of a stream that made it, -1 if none did; ``touched``: the parts of captures it rewrote."""

    spark: SparkSession
    root: str
    version: int
    rows: int
    tables: dict[str, dict[int, str]]
    batch: int = -1
    touched: tuple[int, ...] = ()

    def table(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """A table, or some parts of it."""
        chosen = self.tables[name] if only is None else {p: f for p, f in self.tables[name].items() if p in set(only)}
        folders = [f"{self.root}/data/{name}/{run}/part={p}" for p, run in sorted(chosen.items())]
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def library(self, captures: Iterable[int] | None = None, **only: Iterable[int]) -> Library:
        """All tables; with ``captures`` only these parts of the tables about captures, and of any table those that ``only`` names."""
        return Library(**{t: self.table(t, only.get(t, captures if t in BY_CAPTURE else None)) for t in TABLES})

    def last(self, table: str) -> set[int]:
        """The part that the next id falls into, if it isn't a new one."""
        return {max(self.tables[table])} if self.tables[table] else set()

    def holding(self, captures: DataFrame) -> set[int]:
        """The parts of some captures (id): no more than there are parts."""
        return {r.part for r in captures.select(_part("captures", self.rows).alias("part")).distinct().collect()}

    def within(self, captures: Iterable[int]) -> Callable[[Column], Column]:
        """Whether an id falls into some parts, as ranges that a scan can skip by."""
        ranges: list[list[int]] = []
        for p in sorted(set(captures)):
            if ranges and ranges[-1][1] == p:
                ranges[-1][1] = p + 1
            else:
                ranges.append([p, p + 1])

        def there(id_: Column) -> Column:
            found = F.lit(False)
            for a, b in ranges:
                found = found | ((id_ >= a * self.rows) & (id_ < b * self.rows))
            return found

        return there

    def commit(self, lib: Library, given: dict[str, Iterable[int]], batch: int = -1) -> Parts:
        """The next version. ``given``: for each table to be written the parts that ``lib`` has whole; rows of ids in new parts are added,
        those in other parts are an error, as are ids below zero. Tables that aren't named stay as they are."""
        tables = dict(self.tables)
        for name, whole in given.items():
            run, whole = f"{self.version + 1:08d}-{uuid.uuid4().hex[:8]}", set(whole)
            where = f"{self.root}/data/{name}/{run}"
            rows = getattr(lib, name).withColumn("part", _part(name, self.rows))
            rows.repartition("part").write.partitionBy("part").parquet(where)  # a part is bounded, so one task may write it
            made = {int(n.partition("=")[2]) for n in _names(where) if n.startswith("part=")}
            lost = {p for p in made if p < 0} | (made & set(self.tables[name]) - whole)
            if lost:
                raise ValueError(f"{name} has rows of parts that weren't given: {sorted(lost)[:10]}")
            tables[name] = {p: f for p, f in self.tables[name].items() if p not in whole} | dict.fromkeys(made, run)
        new = set(tables["captures"]) - set(self.tables["captures"])
        touched = {p for t in BY_CAPTURE for p in given.get(t, ())} | new
        return _publish(replace(self, version=self.version + 1, tables=tables, batch=max(batch, self.batch), touched=tuple(sorted(touched))))


def _names(folder: str) -> list[str]:
    fs, name = place(folder)
    return sorted(i.base_name for i in fs.get_file_info(FileSelector(name, allow_not_found=True)))


def _publish(parts: Parts) -> Parts:
    told = {"version": parts.version, "rows": parts.rows, "batch": parts.batch, "touched": parts.touched, "tables": parts.tables}
    put(f"{parts.root}/versions/v{parts.version:08d}.json", json.dumps(told).encode())
    return parts


def create(lib: Library, root: str, rows: int = ROWS) -> Parts:
    """A library saved in parts, as version 1 in a new folder or URI that all machines see."""
    if there(root):
        raise FileExistsError(f"there is a library below {root}")
    none = Parts(lib.captures.sparkSession, root.rstrip("/"), 0, rows, {t: {} for t in TABLES})
    return none.commit(lib, dict.fromkeys(TABLES, ()))


def there(root: str) -> bool:
    """Whether a library in parts lies below ``root``."""
    return any(n.endswith(".json") for n in _names(f"{root.rstrip('/')}/versions"))


def load(spark: SparkSession, root: str, version: int | None = None) -> Parts:
    """A version, the last one by default."""
    root = root.rstrip("/")
    names = [n for n in _names(f"{root}/versions") if n.endswith(".json")]
    name = names[-1] if version is None and names else f"v{version or 0:08d}.json"
    if name not in names:
        raise FileNotFoundError(f"no such version of a library below {root}: {version}")
    fs, path = place(f"{root}/versions/{name}")
    with fs.open_input_stream(path, compression=None) as f:
        told = json.loads(f.read())
    tables = {t: {int(p): run for p, run in told["tables"].get(t, {}).items()} for t in TABLES}
    return Parts(spark, root, told["version"], told["rows"], tables, told["batch"], tuple(told["touched"]))


def expire(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Remove all versions but the last ``keep`` and the folders that none of these names; how many folders went. Not while a commit runs."""
    if keep < 1:
        raise ValueError("the last version stays")
    root, gone = root.rstrip("/"), 0
    names = [n for n in _names(f"{root}/versions") if n.endswith(".json")]
    kept = [load(spark, root, int(n[1:-5])) for n in names[-keep:]]
    for n in names[:-keep]:
        fs, path = place(f"{root}/versions/{n}")
        fs.delete_file(path)
    for table in TABLES:
        named = {(run, p) for v in kept for p, run in v.tables[table].items()}
        for run in _names(f"{root}/data/{table}"):
            parts = [n for n in _names(f"{root}/data/{table}/{run}") if n.startswith("part=")]
            unused = [n for n in parts if (run, int(n.partition("=")[2])) not in named]
            whole = len(unused) == len(parts)
            for folder in [""] if whole else [f"/{n}" for n in unused]:
                fs, path = place(f"{root}/data/{table}/{run}{folder}")
                fs.delete_dir(path)
            gone += len(unused)
    return gone


def touched_by(parts: Parts, paths: DataFrame, contents: DataFrame) -> set[int]:
    """The parts of captures that files at ``paths`` (path), or missing ones that new files with ``contents`` (content_hash), may change, and the last one."""
    shots = parts.table("captures").select("id", "path", "status", "content_hash")
    named = shots.join(paths.select("path").distinct(), "path", "left_semi").select("id")
    moved = shots.where("status = 'missing'").join(contents.select("content_hash").distinct(), "content_hash", "left_semi").select("id")
    return parts.holding(named.union(moved)) | parts.last("captures")
