import pytest
from pyspark.sql import functions as F

from archive import NOW, ids, library
from capturelake.operators import ocr as k
from capturelake.operators import organize as o
from capturelake.operators import rename as r
from capturelake.schemas import load


def test_tags(spark):
    lib = library(spark, [{"id": 1}, {"id": 2}])
    for t in ("  Travel ", "travel", "beach"):
        lib = o.add_tag(lib, 1, t)
    assert o.detail(lib, 1).first().tags == ["beach", "Travel"] and [tuple(x) for x in o.list_tags(lib).collect()] == [("beach", 1), ("Travel", 1)]
    assert o.tag_texts(lib).first().tags == "Travel beach"
    lib = o.remove_tag(lib, 1, "BEACH")
    assert lib.tags.count() == 1 and o.add_tag(lib, 99, "x").tags.count() == 1
    with pytest.raises(ValueError):
        o.add_tag(lib, 1, "  ")


def test_collections(spark):
    lib = library(spark, [{"id": 1}, {"id": 2}, {"id": 3, "status": "missing"}])
    lib, c = o.create_collection(lib, "  Trips ")
    assert o.create_collection(lib, "Trips")[1] == c
    lib, n = o.add_to_collection(lib, c, spark.createDataFrame([(1,), (3,), (9999,)], "id long"))
    assert n.first().present == 2 and o.list_collections(lib).first().item_count == 1 and o.add_to_collection(lib, c, spark.createDataFrame([(1,)], "id long"))[0].collection_items.count() == 2
    assert ids(o.collection_item_ids(lib, c)) == [1] and o.collections_of(lib, 1).first().name == "Trips"
    assert o.collection_by_name(o.rename_collection(lib, c, "T"), "T").count() == 1
    assert o.remove_from_collection(lib, c, 1).collection_items.count() == 1
    gone = o.delete_collection(lib, c)
    assert gone.collections.count() == gone.collection_items.count() == 0
    for bad in (lambda: o.create_collection(lib, " "), lambda: o.add_to_collection(lib, 77, spark.range(1))):
        with pytest.raises(ValueError):
            bad()


def test_flags_lists_and_the_rest(spark, tmp_path):
    lib = library(spark, [{"id": i, "created_ts": i if i % 2 else None, "modified_ts": i} for i in range(1, 6)])
    assert ids(o.grid_page(lib.captures, 2, 1)) == [4, 3] and ids(o.all_ids(lib.captures)) == [5, 4, 3, 2, 1]
    lib = o.set_note(o.set_read_later(o.set_starred(lib, 1, True), 1, True), 1, "  n ")
    row = o.detail(lib, 1).first()
    assert (row.starred, row.read_later, row.note) == (True, True, "n")
    lib = o.record_problems(lib, spark.createDataFrame([("/p", "unreadable", "m")], "path string, kind string, message string"))
    stats = o.library_stats(lib).first()
    assert (stats.total, stats.starred, stats.problems, stats.oldest, stats.newest) == (5, 1, 1, 1, 5)
    assert o.list_problems(lib).first().kind == "unreadable" and o.clear_problems(lib).problems.count() == 0
    lib = o.add_directory(o.add_directory(lib, "/x/../y"), "/y")
    assert [d.path for d in o.list_directories(lib).collect()] == ["/y"] and o.remove_directory(lib, "/y").directories.count() == 0
    assert o.get_setting(o.set_setting(lib, "a", "b"), "a") == "b"
    with pytest.raises(ValueError):
        o.record_feedback(lib, " ", "dismiss")
    lib.save(str(tmp_path / "v1"))
    assert load(spark, str(tmp_path / "v1")).captures.count() == 5


def plan(spark, lib, pattern, **kw):
    chosen = lib.captures.select("id", "id").toDF("id", "seq")
    return {x.id: x for x in r.preview(lib, chosen, pattern, **kw).collect()}


def test_rename_templates(spark):
    lib = library(spark, [{"id": 1, "path": "/d/Shot.png", "created_ts": 1786924800, "app_name": "code"}], collections=[("docker", [1])])
    assert plan(spark, lib, "{collection}_{date}_{counter}", start=1)[1].new_path == "/d/docker_2026-08-17_001.png"
    assert plan(spark, lib, "{time}_{original}_{source}")[1].new_path == "/d/00-00_Shot_code.png"
    assert plan(spark, lib, "{year}{month}{day}{counter}", start=12345, padding=2)[1].new_path == "/d/2026081712345.png"
    for bad in ("{tag}", "{open", " "):
        with pytest.raises(ValueError):
            plan(spark, lib, bad)


def test_rename_conflicts(spark):
    lib = library(spark, [{"id": 1, "path": "/d/a.png"}, {"id": 2, "path": "/d/b.png"}, {"id": 3, "path": "/d/same.png"}, {"id": 4, "status": "missing"}])
    files = spark.createDataFrame([("/d/a.png",), ("/d/b.png",), ("/d/same.png",), ("/d/SHOT_002.png",)], "path string")
    p = plan(spark, lib, "shot_{counter}", start=1, files=files)
    assert [p[i].status for i in (1, 2, 3, 4)] == ["ok", "conflict", "ok", "skipped"]
    p = plan(spark, lib, "shot_{counter}", start=1, files=files, strategy="append")
    assert p[2].new_path == "/d/shot_002-2.png"
    p = plan(spark, lib, "same", files=files, strategy="append")
    assert [p[i].new_path for i in (1, 2, 3)] == ["/d/same.png", "/d/same-2.png", "/d/same.png"] and p[3].status == "skipped"
    assert plan(spark, lib, "x" * 300)[1].status == "conflict" and plan(spark, lib, "a:b")[1].sanitized
    assert plan(spark, lib, "{counter}", order="newest")[1].status == "ok"


def one_by_one(rows, files, strategy):
    """Names settled in order of place, one row after another."""
    old = {f"{d}/{n}".lower() for _, d, n, _, _ in rows}
    stay = {f.lower() for f in files} - old
    claimed, out = set(), {}
    for i, d, name, base, ext in rows:
        full = lambda n: f"{d}/{base}{f'-{n}' if n > 1 else ''}{ext}"  # noqa: E731,B023
        if base + ext == name:
            out[i] = (f"{d}/{name}", "skipped")
            continue
        tries = range(1, 101) if strategy == "append" else (1,)
        n = next((n for n in tries if full(n).lower() not in claimed | stay), 0)
        if n:
            claimed.add(full(n).lower())
        out[i] = (full(max(n, 1)), "ok" if n else "conflict")
    return out


@pytest.mark.parametrize("strategy", ["stop", "append"])
def test_rename_equals_one_by_one(spark, strategy):
    import random

    rng = random.Random(3)
    bases, exts = ["a", "A", "a-2", "a-2-2", "a-100", "a-101", "b", "b.x", "c-02", "d"], [".png", ".PNG", "", ".x-3", ".jpg"]
    shots, rows, seen = [], [], set()
    for i in range(1, 420):
        d, ext = f"/f{rng.randint(0, 1)}", rng.choice(exts)
        base = rng.choice(bases[:3] if i < 150 else bases)
        name = rng.choice([f"old{i}", rng.choice(bases)]) + ext
        if f"{d}/{name}".lower() in seen:
            name = f"old{i}{ext}"
        seen.add(f"{d}/{name}".lower())
        shots.append({"id": i, "path": f"{d}/{name}", "app_name": base})
        rows.append((i, d, name, base, ext if "." in name[1:] else ""))
    shots += [{"id": 500 + i, "path": f"/g/n{i}.png", "app_name": "z"} for i in range(130)]  # more than there are numbers
    rows += [(500 + i, "/g", f"n{i}.png", "z", ".png") for i in range(130)]
    files = [s["path"] for s in shots] + ["/f0/b-2.png", "/f1/A-3.PNG", "/f1/d.jpg", "/g/Z.png", "/g/z-7.png"]
    real = [(i, d, n, b, e if (at := n.rfind(".")) > 0 and n[at:] == e else n[at:] if at > 0 else "") for i, d, n, b, e in rows]
    got = plan(spark, library(spark, shots), "{source}", files=spark.createDataFrame([(f,) for f in files], "path string"), strategy=strategy)
    want = one_by_one(real, files, strategy)
    assert {i: (x.new_path, x.status) for i, x in got.items()} == want
    assert {x.status for x in got.values()} == {"ok", "skipped", "conflict"}
    assert all(x.message == r.FULL for x in got.values() if x.status == "conflict") or strategy == "stop"


def test_journal(spark):
    lib = library(spark, [{"id": i, "path": f"/d/{i}.png"} for i in (1, 2, 3)])
    p = r.preview(lib, lib.captures.select("id", "id").toDF("id", "seq"), "n{counter}")
    lib = r.journal(lib, p, "b1")
    assert lib.journal.count() == 3 and r.pending_paths(lib).count() == 9
    later = spark.sql("select unix_timestamp() + 700 as t").first().t
    assert r.stale(lib, later).count() == 3 and r.stale(lib, later - 700).count() == 0
    files = spark.createDataFrame([("/d/n000.png",), ("/d/2.png",)], "path string")
    after, told = r.reconcile(lib, files, later)
    assert [x.outcome for x in told.orderBy("screenshot_id").collect()] == ["new", "old", "missing"]
    rows = {x.id: x for x in after.captures.collect()}
    assert (rows[1].path, rows[2].path, rows[3].status) == ("/d/n000.png", "/d/2.png", "missing") and after.journal.count() == 0
    assert r.clear_journal(lib, "b1").journal.count() == 0 and r.clear_journal(lib, entry=1).journal.count() == 2
    moved, counts = r.execute(lib, spark.createDataFrame([(1, "/d/1.png", "/d/z.png", True), (2, "/d/2.png", "/d/y.png", False)], "id long, old_path string, new_path string, moved boolean"))
    assert tuple(counts.first()) == (1, 1) and {x.filename for x in moved.captures.collect()} == {"z.png", "2.png", "3.png"}
    assert {x.id: x.status for x in r.validate(p, spark.createDataFrame([("/d/1.png",), ("/d/2.png",), ("/d/N001.png",)], "path string")).collect()} == {1: "ok", 2: "conflict", 3: "conflict"}


def test_reading_queue(spark, tmp_path):
    for n in ("docker_error.png", "invoice-total.png"):
        (tmp_path / n).write_bytes(b"x")
    shots = [{"id": 1, "path": f"{tmp_path}/docker_error.png"}, {"id": 2, "path": f"{tmp_path}/invoice-total.png"}, {"id": 3, "path": f"{tmp_path}/gone.png"}, {"id": 4, "ocr_status": "done"}, {"id": 5, "ocr_attempts": 3, "ocr_status": "queued"}]
    lib = library(spark, shots, [(1, "old text")])
    assert k.claimable_count(lib.captures).first()["count"] == 3
    after, counts = k.run(lib, k.by_name)
    assert tuple(counts.first()) == (3, 2, 0, 1)
    assert {x.screenshot_id: x.text for x in after.ocr_text.collect()} == {1: "docker error", 2: "invoice total"}
    assert {x.id: (x.ocr_status, x.status) for x in after.captures.collect()}[3] == ("queued", "missing")

    def broken(path):
        raise RuntimeError("no engine")

    once, _ = k.run(lib, broken, attempts=2)
    twice, _ = k.run(once, broken, attempts=2)
    state = lambda x: {c.id: (c.ocr_status, c.ocr_attempts) for c in x.captures.collect()}[1]
    assert (state(once), state(twice)) == (("queued", 1), ("failed", 2))
    again = k.retry_failed(twice.captures).where("id = 1").first()
    assert (again.ocr_status, again.ocr_attempts) == ("queued", 0)
    assert k.run(lib, k.by_name, paused=True)[1].first().processed == 0
    assert k.queue(lib.captures, spark.createDataFrame([(4,)], "id long")).where("id = 4").first().ocr_status == "queued"
    assert NOW > 0


def test_names_as_people_read_them(spark):
    from capturelake.functions import text

    names = ["Screenshot from 2026-01-02 a_b.png", "SCREENSHOT FROM x", "Screenshot_a.png", "my screenshot from y.png", "", None]
    titles = ["code · 12", "code ·\t3", " · 4", "a · b · 5", "work ·6", "  x  · 1", "x · 1\n"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(text.display_name(F.col("n")))
    assert [r[0] for r in df.collect()] == ["2026-01-02 a_b.png", "x", "Screenshot_a.png", "my screenshot from y.png", "", None]
    df = spark.createDataFrame([(n,) for n in titles], "n string").select(text.plain_title(F.col("n")))
    assert [r[0] for r in df.collect()] == ["code", "code", " · 4", "a · b", "work ·6", "x", "x · 1"]
