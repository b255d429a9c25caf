import os

import pytest

from archive import ids, library
from capturelake import schemas
from capturelake.operators import text_index
from capturelake.sources import files, parts
from capturelake.streaming import watch
from test_ingest import png


def rows_of(lib):
    """All rows of a library but their times of writing."""
    drop = {"indexed_at", "last_verified_at", "created_at"}
    return {t: sorted((repr(sorted((k, v) for k, v in r.asDict().items() if k not in drop)) for r in getattr(lib, t).collect())) for t in schemas.TABLES}


def shots(n):
    return [{"id": i, "content_hash": f"h{i}"} for i in range(n)]


def test_versions_share_what_is_not_touched(spark, tmp_path):
    root = str(tmp_path / "lib")
    lib = library(spark, shots(35), text=[(i, f"text {i}") for i in (0, 9, 10, 31)], tags=[(3, "x"), (33, "y")], collections=[("c", [1, 20])])
    one = parts.create(lib, root, rows=10)
    assert rows_of(one.library()) == rows_of(lib) and set(one.tables["captures"]) == {0, 1, 2, 3} and set(one.tables["ocr_text"]) == {0, 1, 3}
    sub = one.library(captures={1, 3})
    assert sorted(ids(sub.captures)) == [*range(10, 20), *range(30, 35)] and sorted(ids(sub.ocr_text, "screenshot_id")) == [10, 31] and sub.tags.count() == 2
    more = library(spark, [{"id": i, "note": "new"} for i in (35, 40, 41)]).captures
    two = one.commit(sub.with_(captures=sub.captures.where("id <> 15").unionByName(more)), {"captures": {1, 3}}, batch=7)
    assert sorted(ids(two.library().captures)) == [*range(15), *range(16, 36), 40, 41]
    assert {p for p in range(4) if two.tables["captures"][p] == one.tables["captures"][p]} == {0, 2} and two.tables["ocr_text"] == one.tables["ocr_text"]
    assert (two.version, two.batch, two.touched) == (2, 7, (1, 3, 4)) == (lambda v: (v.version, v.batch, v.touched))(parts.load(spark, root))
    assert rows_of(parts.load(spark, root, 1).library()) == rows_of(lib)
    ranged = spark.range(60)
    assert ids(ranged.where(two.within({1, 2, 5})(ranged.id))) == [*range(10, 30), *range(50, 60)] and ids(ranged.where(two.within(())(ranged.id))) == []
    three = two.commit(lib.with_(captures=lib.captures.limit(0)), {"captures": set(two.tables["captures"])})  # nothing is left
    assert three.library().captures.count() == 0 and three.last("captures") == set() and three.batch == 7
    assert parts.expire(spark, root, keep=2) == 2 and rows_of(parts.load(spark, root, 2).library()) == rows_of(two.library())  # two rewritten parts of version 1
    with pytest.raises(FileNotFoundError):
        parts.load(spark, root, 1)


def test_odd_commits(spark, tmp_path):
    root = str(tmp_path / "lib")
    with pytest.raises(FileNotFoundError):
        parts.load(spark, root)
    one = parts.create(library(spark, []), root, rows=10)
    assert rows_of(parts.load(spark, root).library()) == rows_of(library(spark, []))
    with pytest.raises(FileExistsError):
        parts.create(library(spark, []), root)
    two = one.commit(library(spark, shots(12)), {"captures": ()})
    for bad in (library(spark, shots(1)), library(spark, [{"id": -1}])):
        with pytest.raises(ValueError):
            two.commit(bad, {"captures": {1}})
    assert parts.load(spark, root).version == 2  # what failed isn't a version
    with pytest.raises(ValueError):
        parts.expire(spark, root, 0)


def test_a_batch_rewrites_its_parts_and_equals_a_whole_write(spark, tmp_path):
    """New, changed, moved and removed files: the same library as when all of it is written, and the index goes with it."""
    shown = tmp_path / "in"
    for i in range(6):
        png(shown / f"{i}.png", 30 + i, 20, i)
    start, _ = files.scan(library(spark, []), [str(shown)])
    kept = library(spark, [{"id": i, "path": f"/else/{i}.png", "note": "far"} for i in range(7, 40)], text=[(i, f"far words {i}") for i in range(7, 40)], tags=[(30, "t")])
    texts = spark.createDataFrame([(1, "first"), (2, "second")], "screenshot_id long, text string")
    start = kept.with_(captures=kept.captures.unionByName(start.captures), ocr_text=kept.ocr_text.unionByName(texts, allowMissingColumns=True))
    whole, root, index_root = str(tmp_path / "whole"), str(tmp_path / "parts"), str(tmp_path / "index")
    start.save(schemas.version_path(whole, 1))
    first = parts.create(schemas.load(spark, schemas.latest(whole)), root, rows=2)
    text_index.build(first.library(), index_root)

    png(shown / "1.png", 50, 50, 11)  # changed
    png(shown / "deep" / "new.png", 60, 20, 12)
    (shown / "broken.png").write_bytes(b"x")
    os.remove(shown / "4.png")
    listed = files.list_files(spark, [str(shown)])
    removed = spark.createDataFrame([(f"{shown}/4.png",)], "path string")
    watch._keep(whole, 0, listed, removed)
    watch._keep(root, 0, listed, removed, index_root)
    second = parts.load(spark, root)
    png(shown / "moved.png", 34, 20, 4)  # what 4.png was
    for where in (whole, root):
        watch._keep(where, 1, files.list_files(spark, [str(shown)]), None, index_root if where == root else None)
    third = parts.load(spark, root)
    watch._keep(root, 1, files.list_files(spark, [str(shown)]), None, index_root)  # a batch that is saved already changes nothing
    assert parts.load(spark, root).version == third.version == 3

    assert rows_of(third.library()) == rows_of(schemas.load(spark, schemas.latest(whole)))
    by_path = {r.path: r for r in third.library().captures.collect()}
    gone = next(r for r in first.library().captures.collect() if r.path.endswith("/4.png"))
    assert by_path[f"{shown}/moved.png"].id == gone.id and by_path[f"{shown}/moved.png"].status == "available"
    changed = {p for p, run in second.tables["captures"].items() if first.tables["captures"].get(p) != run}
    assert changed == {by_path[f"{shown}/1.png"].id // 2, gone.id // 2, 39 // 2, 40 // 2}  # of 20 parts; 40 is the new one
    assert {p for p in third.tables["captures"] if third.tables["captures"][p] != second.tables["captures"].get(p)} == {gone.id // 2, 40 // 2}
    assert sum(second.tables["ocr_text"].get(p) != run for p, run in first.tables["ocr_text"].items()) == 1 and third.tables["tags"] == first.tables["tags"]
    index = text_index.load(spark, index_root)
    assert text_index.changes(index, third.library()).count() == 0 and index.segments[0].rows > 30  # far captures weren't indexed anew


def test_following_a_directory_in_parts(spark, tmp_path):
    root = str(tmp_path / "lib")
    parts.create(library(spark, shots(30)), root, rows=10)
    for n in (1, 2):
        png(tmp_path / "in" / f"{n}.png", 40, 30, n)
        watch.follow(spark, root, str(tmp_path / "in"), str(tmp_path / "state"), once=True, wait=3).awaitTermination()
    saved = parts.load(spark, root)
    assert [r.filename for r in saved.library(captures={3}).captures.orderBy("id").collect()] == ["1.png", "2.png"] and saved.library().captures.count() == 32
    assert {saved.tables["captures"][p] for p in (0, 1)} == {parts.load(spark, root, 1).tables["captures"][0]}
