import os

from archive import library

from capturelake.operators import rename
from capturelake.sources import moves


def made(spark, folder, names):
    for n in names:
        (folder / n).write_text(f"was {n}")
    return library(spark, [{"id": i, "path": str(folder / n)} for i, n in enumerate(names, 1)])


def asked(spark, folder, pairs):
    return spark.createDataFrame([(i, str(folder / n), k) for k, (i, n) in enumerate(pairs)], "id long, new_path string, seq long")


def outcomes(rows):
    return {r.id: r.outcome for r in rows.collect()}


def paths(lib):
    return {r.id: (os.path.basename(r.path), r.filename) for r in lib.captures.collect()}


def test_swaps_circles_and_case(spark, tmp_path):
    names = ["one.png", "two.png", "a.png", "b.png", "c.png", "x.png"]
    lib = made(spark, tmp_path, names)
    pairs = [(1, "two.png"), (2, "one.png"), (3, "b.png"), (4, "c.png"), (5, "a.png"), (6, "X.png")]
    lib, told = moves.rename_files(lib, asked(spark, tmp_path, pairs))
    assert set(outcomes(told).values()) == {"renamed"} and lib.journal.count() == 0
    for i, name in pairs:
        assert (tmp_path / name).read_text() == f"was {names[i - 1]}" and paths(lib)[i] == (name, name)
    assert sorted(os.listdir(tmp_path)) == sorted(n for _, n in pairs)
    assert lib.captures.where("size = 0 or modified_ts is null").count() == 0


def test_conflicts_stay_out(spark, tmp_path):
    """A blocker outside of the batch, two files for one name, an unknown capture, a vanished file, one that stays, and one that waits for a failing one's name."""
    lib = made(spark, tmp_path, ["x.png", "y.png", "p.png", "q.png", "gone.png", "same.png", "chain.png"])
    (tmp_path / "blocker.png").write_text("blocker")
    (tmp_path / "gone.png").unlink()
    pairs = [(1, "ok.png"), (2, "blocker.png"), (3, "new.png"), (4, "NEW.png"), (5, "g.png"), (6, "same.png"), (7, "y.png"), (99, "z.png")]
    lib, told = moves.rename_files(lib, asked(spark, tmp_path, pairs))
    assert outcomes(told) == {1: "renamed", 2: "failed", 3: "renamed", 4: "failed", 5: "failed", 6: "unchanged", 7: "failed", 99: "failed"}
    assert {r.id: r.message for r in told.collect() if r.outcome == "failed"} == {2: moves.TAKEN, 4: moves.TWICE, 5: moves.OFFLINE, 7: moves.TAKEN, 99: moves.MISSING}
    assert (tmp_path / "blocker.png").read_text() == "blocker" and (tmp_path / "y.png").read_text() == "was y.png" and (tmp_path / "ok.png").exists()
    assert paths(lib)[1] == ("ok.png", "ok.png") and paths(lib)[2] == ("y.png", "y.png") and lib.journal.count() == 0


def test_first_phase_goes_back(spark, tmp_path):
    def fails(source, target):
        return "no" if source.endswith("/b.png") else moves.move(source, target)

    lib = made(spark, tmp_path, ["a.png", "b.png", "c.png"])
    after, told = moves.rename_files(lib, asked(spark, tmp_path, [(1, "1.png"), (2, "2.png"), (3, "3.png")]), mover=fails)
    assert outcomes(told) == {1: "reversed", 2: "failed", 3: "reversed"}
    assert sorted(os.listdir(tmp_path)) == ["a.png", "b.png", "c.png"] and paths(after) == paths(lib) and after.journal.count() == 0


def test_second_phase_leaves_what_can_be_settled(spark, tmp_path):
    def fails(source, target):
        return "no" if target.endswith("/2.png") else moves.move(source, target)

    lib = made(spark, tmp_path, ["a.png", "b.png"])
    after, told = moves.rename_files(lib, asked(spark, tmp_path, [(1, "1.png"), (2, "2.png")]), batch="b7", mover=fails)
    assert outcomes(told) == {1: "renamed", 2: "between"}
    entry = after.journal.first()
    assert after.journal.count() == 1 and entry.screenshot_id == 2 and paths(after)[2][0] == os.path.basename(entry.temp_path)
    assert os.path.exists(entry.temp_path) and (tmp_path / "1.png").exists()
    assert {r.path for r in rename.pending_paths(after).collect()} >= {entry.temp_path, entry.new_path}
    # once its file has its name, reconciling settles the record
    os.rename(entry.temp_path, entry.new_path)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in os.listdir(tmp_path)], "path string")
    settled, seen = rename.reconcile(after, files, int(entry.created_at.timestamp()) + 10_000)
    assert seen.first().outcome == "new" and paths(settled)[2] == ("2.png", "2.png") and settled.journal.count() == 0


def test_attempts_may_be_repeated(spark, tmp_path):
    made(spark, tmp_path, ["a.png", "b.png"])
    rows = spark.createDataFrame([(1, str(tmp_path / "a.png"), str(tmp_path / "t1")), (2, str(tmp_path / "b.png"), f"file://{tmp_path}/t2".removeprefix("file://"))], "id long, s string, t string")
    for _ in range(2):
        assert {r.why for r in moves.phase(rows, "s", "t").collect()} == {""}
    assert sorted(os.listdir(tmp_path)) == ["t1", "t2"]
    (tmp_path / "a.png").write_text("another")
    assert {r.id: r.why for r in moves.phase(rows, "s", "t").collect()} == {1: moves.TAKEN, 2: ""}
    assert moves.move(str(tmp_path / "none"), str(tmp_path / "new")) == moves.GONE
    assert moves.move(f"file://{tmp_path}/t1", f"file://{tmp_path}/t3") == "" and (tmp_path / "t3").exists()


def test_nothing_to_do(spark, tmp_path):
    lib = made(spark, tmp_path, ["a.png"])
    after, told = moves.rename_files(lib, asked(spark, tmp_path, []))
    assert told.count() == 0 and after is lib
