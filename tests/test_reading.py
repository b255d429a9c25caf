import threading
import time

from archive import library
from capturelake.operators import ocr, reading


def test_cancelled_half_way(spark, tmp_path):
    """What was read stays, the rest is queued as before and a later run reads it; no capture is read twice."""
    def slow(path):
        time.sleep(0.15)
        return path.rpartition("/")[2], 0.9

    lib = library(spark, [{"id": i, "ocr_status": "queued"} for i in range(1, 81)] + [{"id": 99, "status": "missing"}])
    root = str(tmp_path)
    run, told, got = reading.claim(lib, root), [], []

    def go():
        got.append(reading.read(run, slow, parts=8, tell=lambda done, total: told.append((done, total))))

    t = threading.Thread(target=go)
    t.start()
    assert reading.waiting(run, 60)
    run.cancel()
    t.join(60)
    (rows, whole), = got
    first = {r.id for r in rows.collect()}
    assert not whole and 0 < len(first) < 80 and told and told[-1][1] == 80
    after, counts = reading.close(run, lib)
    assert counts.first().done == len(first) and after.captures.where("ocr_status = 'done'").count() == len(first)
    assert after.captures.where("ocr_status = 'queued'").count() == 80 - len(first) and after.ocr_text.count() == len(first)
    again = reading.claim(after, root)
    assert {r.id for r in again.work.collect()} == set(range(1, 81)) - first
    rows, whole = reading.read(again, lambda p: ("x", 1.0), parts=3, tell=lambda done, total: told.append((done, total)))
    assert whole and told[-1] == (80 - len(first), 80 - len(first))
    done, _ = reading.close(again, after)
    assert done.captures.where("ocr_status = 'done'").count() == 80


def test_two_runs_share_no_capture(spark, tmp_path):
    lib = library(spark, [{"id": i} for i in range(1, 11)])
    one = reading.claim(lib, str(tmp_path))
    two = reading.claim(lib, str(tmp_path))
    assert one.work.count() == 10 and two.work.count() == 0
    more = lib.with_(captures=lib.captures.unionByName(library(spark, [{"id": 11}]).captures))
    assert [r.id for r in reading.claim(more, str(tmp_path)).work.collect()] == [11]
    reading.close(one, lib)
    assert reading.claim(lib, str(tmp_path)).work.count() == 10  # nothing of it was read


def test_parts_are_read_once(spark, tmp_path):
    lib = library(spark, [{"id": i} for i in range(1, 11)])
    run = reading.claim(lib, str(tmp_path))
    first, _ = reading.read(run, lambda p: ("first", 1.0), parts=4)
    again, whole = reading.read(run, lambda p: ("second", 1.0), parts=4)
    assert whole and {r.text for r in again.collect()} == {"first"} and first.count() == 10
    assert ocr.claimable(reading.close(run, lib)[0].captures).count() == 0
