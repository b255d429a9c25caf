import pytest
from pyspark.sql import functions as F

from archive import NOW, ids, library
from capturelake.operators import cleanup as c

DAY = 86400


def lib_of(spark):
    rows = [("dup_a", 1000, 10, "h1"), ("dup_b", 1000, 9, "h1"), *[(f"g{i}", 500, 400, "h2") for i in range(1, 6)], ("old_big", 6_000_000, 500, "h3"), ("new_tiny", 100, 1, "h4"), ("gone", 1000, 400, "h1")]
    shots = [{"id": i, "filename": n, "size": s, "created_ts": NOW - d * DAY, "content_hash": h, "status": "missing" if n == "gone" else "available", "ocr_status": "none" if n == "new_tiny" else "done"} for i, (n, s, d, h) in enumerate(rows, 1)]
    return library(spark, shots, [(i, "text") for i in range(1, 9)], [(1, "trip"), (2, "trip")], [("C", [1]), ("D", [2])])


def test_overview(spark):
    o = c.overview(lib_of(spark), NOW).first()
    assert (o.total_count, o.total_bytes, o.exact_groups, o.exact_count, o.exact_reclaim_bytes) == (9, 6_004_600, 2, 7, 3000)
    assert (o.old_count, o.old_bytes, o.large_count, o.large_bytes, o.notext_count) == (6, 6_002_500, 1, 6_000_000, 1)
    none = c.overview(library(spark, []), NOW).first()
    assert all(v == 0 for k, v in none.asDict().items() if k not in ("old_age_days", "large_min_bytes"))


def test_groups_and_fingerprints(spark):
    lib = lib_of(spark)
    g = {r.key: r for r in c.exact_groups(lib).collect()}
    assert (g["h1"].keep_id, g["h1"].metadata_warning, g["h2"].reclaim_bytes, g["h2"].metadata_warning) == (2, True, 2000, False)
    partly = library(spark, [{"id": 1, "content_hash": "x"}, {"id": 2, "content_hash": "x", "note": "n"}], tags=[(1, "t"), (2, "t")])
    assert not c.metadata_differs(partly).first().differs and c.metadata_differs(partly, strict=True).first().differs


def test_texts_stay_where_they_are_read(spark):
    """Of texts, one character goes to the join of the overview and of the captures without text; blank ones are null, empty or spaces only."""
    shots = [{"id": i, "ocr_status": "queued" if i == 7 else "done"} for i in range(1, 8)]
    lib = library(spark, shots, [(1, "text " * 1000), (2, "  x"), (3, "   "), (4, ""), (5, None), (7, "x")])
    assert sorted(ids(c.items(lib, "notext", NOW))) == [3, 4, 5, 6, 7] and c.overview(lib, NOW).first().notext_count == 5
    plan = c.category(lib, "notext", NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(trim(text" in plan.split("Join", 1)[1]


def test_pages(spark):
    lib = lib_of(spark)
    a, b = (ids(c.items(lib, "old", NOW, limit=2, offset=o)) for o in (0, 2))
    assert a == [8, 3] and not set(a) & set(b)
    assert c.items_total(lib, "old", NOW).first().total == len(ids(c.category_ids(lib, "old", NOW))) == 6
    assert ids(c.items(lib, "large", NOW, sort="largest")) == [8] and ids(c.items(lib, "notext", NOW)) == [9]
    for bad in (lambda: c.items(lib, "none", NOW), lambda: c.items(lib, "old", NOW, days=7), lambda: c.items(lib, "large", NOW, size=123), lambda: c.items(lib, "old", NOW, sort="random")):
        with pytest.raises(ValueError):
            bad()
    assert c.selection_bytes(lib.captures, spark.createDataFrame([(1,), (8,)], "id long")).first().bytes == 6_001_000


def test_trash_records_and_restore(spark):
    lib = lib_of(spark)
    outcomes = spark.createDataFrame([(1, True), (2, False), (3, None), (10, True)], "id long, moved boolean")
    lib, told = c.trash(lib, outcomes)
    assert {r.id: r.outcome for r in told.collect()} == {1: "trashed", 2: "failed", 3: "already_missing", 10: "already_missing"}
    rec = lib.deleted.collect()
    assert [(r.screenshot_id, r.tags_json, r.collections_json, r.ocr_text) for r in rec] == [(1, '["trip"]', '["C"]', "text")]
    assert c.deleted_items(lib, "DUP_a").count() == 0 and c.deleted_items(lib, "dup").count() == 1 and c.deleted_items(lib, "no\\").count() == 0
    assert c.forget(lib, 1).deleted.count() == 0 and c.forget(lib).deleted.count() == 0
    trashed = spark.createDataFrame([("/a/1.png", 1, False), ("/a/1.png", 2, True), ("/a/3.png", 1, False)], "path string, time_deleted long, restored boolean")
    back, told = c.restore(lib, spark.createDataFrame([(1,), (2,), (3,)], "id long"), trashed)
    assert {r.id: r.outcome for r in told.collect()} == {1: "restored", 2: "already_there", 3: "failed"}
    assert back.captures.where(F.col("status") == "missing").count() == 2
