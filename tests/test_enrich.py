from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from archive import NOW, ids, library
from capturelake import catalogue
from capturelake.functions import hashing, text
from capturelake.operators import classify as c
from capturelake.operators import suggest as s


@pytest.mark.parametrize(("name", "path", "ocr", "want"), [
    ("Screenshot-chrome-error.png", "/tmp/x", None, ("chrome", None, None)),
    ("shot.png", "/home/slack/logs/shot.png", None, ("slack", None, None)),
    ("Screenshot 2026.png", "/tmp/Screenshot 2026.png", None, (None, None, None)),
    ("x.png", "/tmp/x.png", "see https://github.com/an/open/pulls (open pull request)", ("github", "https://github.com/an/open/pulls", "github.com")),
    ("x.png", "/tmp/x.png", "visit www.example.com today", (None, None, "www.example.com")),
    ("x.png", "/tmp/x.png", "www. then www.x then www.a.b", (None, None, "www.a.b")),
    ("x.png", "/tmp/x.png", "http://nohost/ and https://WWW.Example.org", (None, "https://WWW.Example.org", "www.example.org")),
    ("chrome-invoice.png", "/tmp/x", "your invoice total https://pay.example.com/x", ("chrome", "https://pay.example.com/x", "pay.example.com")),
])
def test_classify(spark, name, path, ocr, want):
    r = c.classify(spark.createDataFrame([(name, path, ocr)], "filename string, path string, text string")).first()
    assert (r.found_app, r.found_url, r.found_domain) == want


def test_categories_and_confidence(spark):
    df = spark.createDataFrame([("a", "/a", "invoice receipt traceback"), ("a", "/a", "inbox tweet"), ("a", "/a", "nothing"), ("slack", "/a", "x")], "filename string, path string, text string")
    got = [(r.found_category, round(r.found_confidence, 2)) for r in c.classify(df).collect()]
    assert got == [("finance", 0.75), ("communication", 0.65), (None, 0.0), ("communication", 0.65)]


def test_filling(spark):
    lib = library(spark, [{"id": 1, "filename": "chrome-invoice.png", "path": "/t/chrome-invoice.png"}, {"id": 2, "app_name": "mine", "filename": "chrome.png", "path": "/t/chrome.png"}], [(1, "your invoice total https://pay.example.com/x")])
    lib, counts = c.apply_classification(lib)
    assert tuple(counts.first()) == (2, 1)
    rows = {r.id: r for r in lib.captures.collect()}
    assert (rows[1].app_name, rows[1].website_domain, rows[1].category, rows[2].app_name) == ("chrome", "pay.example.com", "finance", "mine")
    assert c.apply_classification(lib)[1].first().updated == 0


def test_hash_functions(spark):
    df = spark.createDataFrame([("0123456789abcdef", bytearray(b"abc")), ("ffffffffffffffff", bytearray(b"")), ("not-hex", None)], "h string, b binary")
    r = df.select(hashing.phash_to_hex(hashing.phash_from_hex(F.col("h"))).alias("h"), hashing.content_hash(F.col("b")).alias("s")).collect()
    assert [x.h for x in r] == ["0123456789abcdef", "ffffffffffffffff", None]
    assert r[0].s == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    d = spark.sql("select 0L a, -1L b").select(hashing.hamming(F.col("a"), F.col("b")).alias("d")).first().d
    assert d == 64


def test_dhash_has_no_size_but_a_direction():
    import numpy as np

    grey = lambda w, h: np.tile(np.linspace(0, 255, w), (h, 1))
    assert hashing.dhash(grey(300, 200)) == hashing.dhash(grey(90, 80)) == 0
    assert hashing.dhash(grey(300, 200)[:, ::-1]) == 2**64 - 1


def test_names(spark):
    names = ["CON.png", "lpt1", "a<b>c:d.png", "trailing. ", "...", "fine"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.safe_basename(F.col("n"))).collect()] == ["CON_.png", "lpt1_", "a_b_c_d.png", "trailing", "", "fine"]
    df = spark.createDataFrame([(n,) for n in ["a.b.png", ".hidden", "none", "/x/y.JPEG"]], "n string")
    assert [tuple(r) for r in df.select(text.stem(F.col("n")), text.extension(F.col("n")), text.is_image(F.col("n"))).collect()] == [("a.b", ".png", True), (".hidden", "", False), ("none", "", False), ("/x/y", ".JPEG", True)]
    assert text.normalize_path("/a/./b/../c") == "/a/c"


def suggest_library(spark):
    same = {"app_name": "code", "category": "work", "website_domain": "github.com"}
    shots = [
        {"id": 1, **same, "phash": f"{0x1000:016x}", "created_ts": NOW}, {"id": 2, **same, "phash": f"{0x1001:016x}", "created_ts": NOW + 10},
        {"id": 3, **same, "phash": f"{0x1000:016x}", "created_ts": NOW + 9_000_000}, {"id": 4, "app_name": "spotify", "category": "music", "website_domain": ""},
        *({"id": i, **same} for i in (5, 6, 7)),
    ]
    tags = [(1, "ship"), (2, "ship"), (1, "containers"), (3, "containers")]
    return library(spark, shots, tags=tags, collections=[("docker", [1, 2]), ("empty", [])])


def test_suggestions(spark):
    lib = suggest_library(spark)
    got = {(r.id, r.name): r for r in s.suggest_collections(lib).collect()}
    assert {i for i, _ in got} == {3, 5, 6, 7}
    assert got[3, "docker"].score == 10 and got[3, "docker"].reasons == ["Same app: code", "Same category: work", "Same site: github.com", "1 shared tag", "Looks similar"]
    tags = {(r.id, r.name): r.score for r in s.suggest_tags(lib).collect()}
    assert tags[3, "ship"] == 5 and (4, "ship") not in tags and (1, "ship") not in tags
    no = lib.with_(feedback=spark.createDataFrame([(1, 3, "collection:1", "dismiss", None), (2, None, "tag:ship", "dismiss", None)], lib.feedback.schema))
    assert {r.id for r in s.suggest_collections(no).collect()} == {5, 6, 7}
    assert "ship" not in {r.name for r in s.suggest_tags(no).collect()}


def test_proposals_and_coverage(spark):
    lib = suggest_library(spark)
    (p,) = s.proposals(lib).collect()
    assert (p.name, p.member_count, p.member_ids, len(p.preview_hashes)) == ("code · github.com · 4", 4, [3, 5, 6, 7], 4)
    assert p.reasons == ["Same app: code", "Same site: github.com"]
    assert tuple(s.coverage(lib).first()) == (4, 3)
    no = lib.with_(feedback=spark.createDataFrame([(1, None, f"proposal:{p.key}", "dismiss", None)], lib.feedback.schema))
    assert s.proposals(no).collect() == []
    made, cid = s.create_proposed(lib, p.key, p.name, spark.createDataFrame([(i,) for i in p.member_ids], "id long"))
    assert cid == 3 and ids(s.unfiled(made)) == [4] and made.feedback.count() == 1
    done = s.accept_tag(s.accept_collection(lib, 3, 1), 3, "ship")
    assert done.feedback.count() == 2 and done.collection_items.count() == 3


def test_proposal_keys(spark):
    rows = [("a", "d", "c", "app:a\x1fdom:d"), ("a", "", "c", "app:a\x1fcat:c"), (None, "d", "c", "cat:c"), ("", "d", "c", None), ("a", None, None, None)]
    df = spark.createDataFrame(rows, "app_name string, website_domain string, category string, want string")
    assert all(r[0] == r[1] for r in df.select(s.proposal_key(), "want").collect())


def test_registered_query_finds_apps(spark, monkeypatch):
    texts = ["we talked on slack at noon", "see https://a.example/x here", "see https://nodot/x here", "www.b.example is up", "GitHub pull request", "nothing", None]
    docs = spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(catalogue, "table", lambda spark, sf_dir, name: docs)
    got = {r.id: (r.app, r.category, r.confidence) for r in catalogue.queries()["classify_apps"](spark, "").collect()}
    assert got == {0: ("slack", "communication", 0.65), 1: (None, None, 0.5), 2: (None, None, 0.0), 3: (None, None, 0.5), 4: ("github", "code", 0.65), 5: (None, None, 0.0), 6: (None, None, 0.0)}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, 'en', 'src1')", list(enumerate(texts)))
    assert {r[0]: r[1:] for r in con.sql(catalogue.oracle_sql()["classify_apps"]).fetchall()} == got


def test_one_shared_thing_makes_no_candidates(spark):
    """A hot app, tag or category alone pairs nothing; pairs of signals, bursts and looks do, and the scores are those of all pairs."""
    from itertools import product

    from pyspark.sql import functions as F

    from archive import library
    from capturelake.operators import suggest

    shots = [{"id": i, "app_name": "hot", "category": f"c{i}", "created_ts": i * 10_000} for i in range(1, 121)]
    lib = library(spark, shots, tags=[(i, "everywhere") for i in range(1, 121, 2)], collections=[(f"k{i}", [i]) for i in range(1, 41)])
    member = suggest._members(lib).select("cid", "id")
    tags = lambda keys, key: keys.join(lib.screenshot_tags, F.col("sid") == F.col("screenshot_id")).select(key, "tag_id").distinct()
    mine, theirs = tags(lib.captures.select("id", F.col("id").alias("sid")), "id"), tags(member.select("cid", F.col("id").alias("sid")), "cid")
    counts = lib.screenshot_tags.groupBy("tag_id").agg(F.count("*").alias("uses"))
    own = lib.captures.select("id", "app_name", "category", "website_domain")
    pairs = {(r.id, r.cid) for r in suggest.candidates(own, suggest.profiles(lib), mine, theirs, counts, []).collect()}
    tagged = lambda i: i % 2 == 1
    assert pairs == {(i, c) for i, c in product(range(1, 121), range(1, 41)) if i == c or (tagged(i) and tagged(c))}
    got = suggest.suggest_collections(lib).collect()
    assert {r.id for r in got} == set(range(1, 121, 2)) and {r.score for r in got} == {4}
    assert {tuple(r.reasons) for r in got} == {("Same app: hot", "1 shared tag")}


def both_ways(spark, folder, query, docs, labels):
    """Sorted rows of a registered query and of its SQL; ``docs``: (doc_id, text, lang, source), ``labels``: (doc_id, quality, toxic)."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    rel = con.sql(catalogue.oracle_sql()[query])
    return sorted(tuple(r) for r in catalogue.queries()[query](spark, str(folder)).select(*rel.columns).collect()), sorted(rel.fetchall())


#: Texts whose SHA-256 begin with 64 bits of which 8 differ.
NEAR = ("note 13530", "note 52803")


@pytest.mark.parametrize("query", ["suggest_collections", "suggest_not_dismissed"])
def test_digests_that_lie_near_by_chance_are_not_alike(spark, tmp_path, query):
    a, b = (int(sha256(t.encode()).hexdigest()[:16], 16) for t in NEAR)
    assert (a ^ b).bit_count() == 8
    docs = [(1, "some other text", "en", "src1"), (2, NEAR[0], "en", "src2"), (3, NEAR[1], "en", "src3")]
    got, want = both_ways(spark, tmp_path, query, docs, [(1, 1, 0), (2, 1, 0)])
    assert got == want and any(r[0] == 3 for r in got)


def test_all_members_count(spark):
    """Beyond a collection's first 300 members its tags, bursts, looks and most frequent values count as well."""
    shots = [{"id": i, "app_name": "hot", "category": "first" if i <= 300 else "most"} for i in range(1, 651)]
    shots[309] |= {"phash": f"{0xABC0:016x}", "created_ts": NOW}
    shots += [{"id": 701, "app_name": "hot"}, {"id": 702, "app_name": "hot", "phash": f"{0xABC1:016x}"}, {"id": 703, "app_name": "hot", "created_ts": NOW + 60}, {"id": 704, "app_name": "hot", "category": "most"}, {"id": 705, "app_name": "hot"}]
    lib = library(spark, shots, tags=[(650, "late"), (701, "late")], collections=[("k", range(1, 651))])
    got = {r.id: (r.cid, r.score, r.reasons[1]) for r in s.suggest_collections(lib).collect()}
    assert got == {701: (1, 4, "1 shared tag"), 702: (1, 5, "Looks similar"), 703: (1, 5, "Captured together"), 704: (1, 5, "Same category: most")}


@pytest.mark.parametrize(("query", "found"), [("suggest_collections", (680, 2, "src1", 5, 1)), ("suggest_not_dismissed", (680, "collection", "src1", 1))])
def test_registered_suggestions_count_all_members(spark, tmp_path, query, found):
    docs = [(i, f"text {i}", "de" if i <= 300 else "en", "src1") for i in range(1, 651)] + [(680, "another", "en", "src2")]
    got, want = both_ways(spark, tmp_path, query, docs, [(i, 1, 0) for i in range(1, 651)])
    assert got == want and found in got
