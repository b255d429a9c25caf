import math
import random
import sqlite3

import pytest

from archive import NOW, ids, library
from capturelake import catalogue
from capturelake.operators import search as s
from capturelake.plans.query_parser import parse

DAY = 86400


def test_ranking_and_recency(spark):
    lib = library(
        spark,
        [{"id": 1, "created_ts": NOW - 20 * DAY}, {"id": 2, "created_ts": NOW}, {"id": 3, "created_ts": NOW}, {"id": 4, "created_ts": NOW - 90 * DAY}, {"id": 5, "created_ts": NOW - DAY}],
        [(1, "running python traceback complete"), (2, "a python file with an unrelated traceback note"), (3, "python is great"), (4, "docker error occurred"), (5, "docker error again")],
    )
    assert ids(s.search(lib, "python traceback", NOW)) == [1, 2]
    assert ids(s.search(lib, "docker error", NOW)) == [5, 4]
    assert s.search_total(lib, "python traceback", NOW).first().total == 2


def test_folders(spark):
    lib = library(spark, [{"id": 1, "path": "/x/shots_100%!/inside.png"}, {"id": 2, "path": "/x/shotsX100other/other.png"}, {"id": 3, "path": "/x/shots_100%!suffix/sibling.png"}])
    for q in ('dir:"/x/shots_100%!"', 'dir:"/x/shots_100%!/"', 'dir:"/X/SHOTS_100%!"'):
        assert ids(s.search_ids(lib, q, NOW)) == [1]


def test_filters(spark):
    lib = library(
        spark,
        [
            {"id": 1, "path": "/h/Screenshots/a.png", "created_ts": NOW - DAY, "starred": True, "content_hash": "h"},
            {"id": 2, "path": "/h/Downloads/b.png", "created_ts": NOW - 40 * DAY, "content_hash": "h"},
            {"id": 3, "path": "/h/Other/c.jpg", "created_ts": NOW, "format": "jpg"},
            {"id": 4, "status": "missing", "content_hash": "z"},
        ],
        [(1, "pricing page screenshot"), (2, "pricing table image")],
        [(1, "research"), (2, "research")],
        [("Work", [2])],
    )
    q = lambda t: sorted(ids(s.search_ids(lib, t, NOW)))
    assert q("dir:/h/Downloads") == [2] and q("type:jpg") == [3] and q("has:text") == [1, 2] and q("has:notext") == [3]
    assert q("after:2026-08-27") == [1, 3] and q("tag:resea") == [1, 2] and q("pricing dir:/h/Downloads") == [2]
    assert q("is:duplicate") == [1, 2] and q("is:starred") == [1] and q("collection:work") == [2] and q("research is:unstarred") == [2]
    assert q("") == [1, 2, 3]
    page = s.search(lib, "", NOW, limit=2, offset=1)
    assert ids(page) == [1, 2] and {(r.score, r.snippet) for r in page.collect()} == {(0.0, None)}


def test_scores_equal_fts5(spark):
    words = "alpha beta gamma delta café Alpha_beta x1".split()
    texts = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 3 + i % 9))) for i in range(1, 60)]
    lib = library(spark, [{"id": i, "filename": f"{words[i % 7]}_{i}.png", "app_name": words[(i + 1) % 7]} for i, _ in texts], texts, [(i, words[i % 5]) for i, _ in texts if i % 3 == 0])
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(filename, ocr, tags, note, app, site)")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    for i, t in texts:
        db.execute("insert into f(rowid, filename, ocr, tags, note, app, site) values (?, ?, ?, ?, '', ?, '')", (i, f"{words[i % 7]}_{i}.png", t, words[i % 5] if i % 3 == 0 else "", words[(i + 1) % 7]))
    for q in ("gamma", "alpha beta", '"beta gamma"', "cafe", 'delta "alpha beta"'):
        parsed = parse(q, NOW)
        want = {i: -v for i, v in db.execute("select rowid, bm25(f, 8, 1, 12, 4, 6, 6) from f where f match ?", (parsed.match_expr,))}
        got = {r.id: r.score for r in s.ranked(lib, parsed, NOW).collect()}
        assert set(got) == set(want)
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_snippets():
    text = " ".join(f"w{i}" for i in range(40))
    out = s.snippet(text, [["w20"], ["w22"]])
    assert "[w20]" in out and "[w22]" in out and out.startswith("…") and len(out.split()) == 16
    assert s.snippet(None, [["a"]]) == "" and s.snippet("one two", [["zz"]]) == "one two" and s.snippet("--", [["a"]]) == "--"
    assert s.snippet("an e-mail about foo-bar and x_y", [["mail"], ["foo"], ["x"]]) == "an e-[mail] about [foo]-bar and [x]_y"
    assert s.snippet("the cat of the dog", [["of", "the"]]) == "the cat [of the] dog"


def test_snippets_equal_fts5():
    """Random texts with marks, sentences, accents and hits that overlap or are cut."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(a, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    rng, seen = random.Random(1), 0
    words = ["docker", "error", "e-mail", "foo-bar", "x_y", "café", "the", "Of", "a.b", "über"]
    units = [["docker"], ["error"], ["the"], ["of"], ["e", "mail"], ["foo", "bar"], ["the", "of"], ["docker", "docker"], ["x", "y"], ["cafe"], ["uber"]]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ": ", "\n", ", ", "  ", ".", "! "]) for _ in range(rng.randint(1, 60)))
        asked = [rng.choice(units) for _ in range(rng.randint(1, 3))]
        db.execute("delete from f")
        db.execute("insert into f values (?)", (text,))
        want = db.execute("select snippet(f, 0, '[', ']', '…', 16) from f where f match ?", (" ".join(f'"{" ".join(u)}"' for u in asked),)).fetchone()
        if want:
            seen += 1
            assert s.snippet(text, asked) == want[0], (text, asked)
    assert seen > 1000


@pytest.mark.parametrize("name", ["search_filters", "search_member", "search_dir", "is_duplicate"])
def test_registered_queries_return_all_ids(spark, monkeypatch, name):
    rows = [{"id": i, "path": f"/archive/src1/{i}.png", "app_name": "src1", "website_domain": "example.org", "starred": True, "content_hash": "h", "created_ts": NOW - i} for i in range(1, 6)]
    lib = library(spark, rows, [(i, "words") for i in range(1, 6)] if name != "search_dir" else (), [(i, "quality") for i in range(1, 6)], [("src1", list(range(1, 6)))])
    monkeypatch.setattr(s, "MOST_IDS", 2)
    monkeypatch.setattr(catalogue, "archive", lambda spark, sf_dir: lib)
    assert ids(catalogue.queries()[name](spark, "")) == [1, 2, 3, 4, 5]
    assert len(ids(s.search_ids(lib, "", NOW, limit=9))) == 2


WORDS = ["docker", "error", "invoice", "the", "of", "café", "build"]


def random_library(spark, rng, n=60):
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    shots = [{"id": i, "path": f"/a/{rng.choice(WORDS)}_{i}.png", "app_name": rng.choice(WORDS), "note": text(rng.randint(0, 3)), "status": rng.choice(["available", "available", "missing"]), "starred": i % 3 == 0, "created_ts": NOW - i * 90_000 if i % 7 else None} for i in range(1, n)]
    return library(spark, shots, [(i, text(rng.randint(1, 30))) for i in range(1, n - 10)], tags=[(i, rng.choice(WORDS)) for i in range(1, n, 4)])


def scores(df):
    return sorted((r.id, round(r.score, 9), round(r._sort, 9)) for r in df.collect())


def test_index_gives_the_same(spark, tmp_path):
    from capturelake.operators import text_index

    lib = random_library(spark, random.Random(3))
    index = text_index.build(lib, str(tmp_path))
    for q in ("docker error", 'cafe "the of" is:starred', '"invoice build docker" the', "nothing here"):
        assert scores(s.ranked(lib, parse(q, NOW), NOW, index)) == scores(s.ranked(lib, parse(q, NOW), NOW)), q
    for q, limit, offset in (("docker error", 5, 3), ("cafe is:starred", 60, 0), ("the the", 3, 0), ("nothing", 5, 0), ('"of the"', 3, 0)):
        rows = lambda i: [tuple(r) for r in s.search(lib, q, NOW, limit, offset, index=i).collect()]  # noqa: E731, B023
        assert [r[:-1] for r in rows(index)] == [r[:-1] for r in rows(None)], q
        assert [r[-1] for r in rows(index)] == pytest.approx([r[-1] for r in rows(None)])


def test_index_follows_updates(spark, tmp_path, monkeypatch):
    """Captures change, come and go over twelve versions; segments are merged; counts and scores stay those of an index made anew."""
    from pyspark.sql import functions as F

    from capturelake.operators import organize, text_index

    monkeypatch.setattr(text_index, "SMALL", 4)
    rng = random.Random(8)
    lib = random_library(spark, rng, 50)
    index = text_index.build(lib, str(tmp_path / "i"))
    written, most = [], 0
    for v in range(1, 13):
        picked = rng.sample(range(1, 60), 2)
        if v % 4 == 0:
            lib = lib.with_(captures=lib.captures.where(F.col("id") != picked[0]))
        elif v % 4 == 1:
            lib = organize.tag_all(lib, spark.createDataFrame([(picked[0],), (picked[1],)], "id long"), rng.choice(WORDS))
        else:
            new = spark.createDataFrame([(p, " ".join(rng.choices([*WORDS, "zebra"], k=9))) for p in picked], "screenshot_id long, text string")
            lib = lib.with_(ocr_text=lib.ocr_text.where(~F.col("screenshot_id").isin(picked)).select("screenshot_id", "text").unionByName(new))
        lib = lib.with_(**{n: spark.createDataFrame(getattr(lib, n).collect(), getattr(lib, n).schema) for n in ("captures", "ocr_text", "tags", "screenshot_tags")})
        before = {x.path for x in index.segments}
        index = text_index.update(index, lib, spark.createDataFrame([(p,) for p in picked], "id long")) if v % 2 else text_index.follow(index, lib)
        written.append(sum(x.rows for x in index.segments if x.path not in before))
        most = max(most, len(index.segments))
        if v != 12:
            continue
        whole = text_index.build(lib, str(tmp_path / f"w{v}"))
        assert (index.rows, index.length) == (whole.rows, whole.length)
        assert sorted(map(tuple, index.vocabulary().collect())) == sorted(map(tuple, whole.vocabulary().collect()))
        for q in ("docker zebra", "the", '"of the"'):
            assert scores(s.ranked(lib, parse(q, NOW), NOW, index)) == scores(s.ranked(lib, parse(q, NOW), NOW)), (v, q)
    assert most <= 12 and sorted(written)[len(written) // 2] <= 2  # most updates write what changed
    assert text_index.follow(index, lib) is index
    again = text_index.load(spark, str(tmp_path / "i"))
    assert again == index and text_index.load(spark, str(tmp_path / "i"), 0).rows == 49


def test_few_blocks_are_read(spark, tmp_path):
    """A page of frequent words is found in a tenth of their blocks, and is the page that scoring all would give."""
    from pyspark.sql import functions as F

    from capturelake.operators import text_index

    n = 20_000
    base = library(spark, [{"id": 1}], [(1, "x")])
    rows = spark.range(n)
    text = F.concat(F.lit("the "), F.when(F.col("id") % 50 == 0, "zebra ").otherwise(""), F.when(F.col("id") % 3 == 0, "docker ").otherwise(""), F.repeat(F.lit("word "), (F.hash("id") % 7 + 7).cast("int")), F.when(F.hash("id") % 97 == 0, F.repeat(F.lit("zebra "), 3)).otherwise(""))
    captures = rows.select("id", F.lit("shot").alias("filename"), F.lit("available").alias("status"), (F.lit(NOW) - F.col("id") * 3000).alias("created_ts"), F.lit(False).alias("starred"))
    from capturelake.schemas import empty

    lib = empty(spark, captures=captures, ocr_text=rows.select(F.col("id").alias("screenshot_id"), text.alias("text")), tags=base.tags, screenshot_tags=base.screenshot_tags)
    index = text_index.build(lib, str(tmp_path))
    for q, part in (("the", 10), ("docker", 10), ("zebra", 1), ("the docker", 3)):
        query = parse(q, NOW)
        got = text_index.best(index, lib, query, NOW, 20)
        page = lambda df: [(r.id, round(r._sort, 9)) for r in df.orderBy(*s.order_of(query)).limit(20).collect()]  # noqa: E731, B023
        assert page(got.rows) == page(s.ranked(lib, query, NOW)), q
        assert 0 < got.blocks_read * part <= got.blocks, (q, got.blocks_read, got.blocks)


def test_an_index_shuffles_postings_once(spark, tmp_path, monkeypatch):
    """Blocks that go on in another batch are whole, hot tokens are dealt out, and what a capture has comes from its own row."""
    from archive import library
    from capturelake.operators import search, text_index

    monkeypatch.setattr(text_index, "BLOCK", 4)
    monkeypatch.setattr(text_index, "CHUNK", 10)
    texts = [(i, f"common word{i % 7} " + "again " * (i % 5) + ("" if i % 3 else "png")) for i in range(45)]
    lib = library(spark, [{"id": i, "created_ts": None if i % 4 == 0 else i} for i in range(47)], text=texts, tags=[(3, "common"), (4, "again")])
    plan = text_index._forward(search.documents(lib))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan  # tokens aren't shuffled to be counted
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        index = text_index.build(lib, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in search.documents(lib).select("id", *(f"t_{c}" for c in search.WEIGHTS)).collect():
        for c, w in search.WEIGHTS.items():
            for t in r[f"t_{c}"]:
                want[t, r.id] = want.get((t, r.id), 0) + w
    assert {(r.token, r.id): r.f for r in index.postings(index.read("blocks", text_index.BLOCKS)).collect()} == want
    time = {i: None if i % 4 == 0 else i for i in range(47)}
    seen = {}
    for b in index.read("blocks", text_index.BLOCKS).collect():
        assert b.n == len(b.postings) <= 4 and b.max_f == max(p.f for p in b.postings) and b.min_d == min(p.d for p in b.postings)
        assert b.max_ts == max((time[p.id] for p in b.postings if time[p.id] is not None), default=None)
        seen.setdefault((b.token, b.salt), []).append((b.block, b.n))
    for found in seen.values():  # consecutive numbers, only the last block isn't full
        assert [k for k, _ in sorted(found)] == list(range(len(found))) and all(m == 4 for _, m in sorted(found)[:-1])
    assert len([k for k in seen if k[0] == "common"]) > 1
