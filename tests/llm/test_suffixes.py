import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from capturelake.llm import suffixes


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text) whose ids tell them apart or that are equal."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def in_process(rows, length, buckets=3):
    """The operator's stages on batches, with the shuffles done by hand."""
    keys = [abs(hash(t)) % 2**62 for _, t in rows]
    docs = [(i, k, t) for (i, t), k in zip(rows, keys, strict=True)]
    make = lambda part, **more: pa.RecordBatch.from_arrays([pa.array([d[0] for d in part], pa.int64()), pa.array([d[1] for d in part], pa.int64()), pa.array([d[2] for d in part], pa.string()), *more.values()], names=["doc_id", "key", "text", *more])

    def dealt(batches, reduce):
        by = defaultdict(list)
        for b in batches:
            for r in range(b.num_rows):
                by[b.column(0)[r].as_py()].append(b.slice(r, 1))
        found = defaultdict(list)
        for part in by.values():
            for b in reduce(iter(part)):
                for i, k, f in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    found[i, k] += f
        return found

    half = len(docs) // 2
    parts = [p for p in (docs[half:], docs[:half]) if p]
    told = dealt((b for p in parts for b in suffixes._census_map(length, buckets)(iter([make(p)]))), suffixes._census_reduce())
    having = [d for d in docs if told[d[0], d[1]]]
    spans = {}
    if having:
        batch = make(having, found=pa.array([told[d[0], d[1]] for d in having], pa.list_(pa.int64())))
        spans = dealt(suffixes._sort_map(length, buckets)(iter([batch])), suffixes._sort_reduce(length))
    batch = make(docs, found=pa.array([spans.get((d[0], d[1])) for d in docs], pa.list_(pa.int64())))
    out = []
    for b in suffixes._text_map(["doc_id", "key", "n_bytes", "n_removed", "spans", "sha"], False)(iter([batch])):
        out += [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["sha"]) for r in b.to_pylist()]
    return sorted(out, key=str)


@given(st.lists(st.text(alphabet="ab", max_size=90) | st.sampled_from(["ab" * 60, "a" * 100, "aab" * 30 + "b" * 40, "é" * 40]), max_size=8), st.sampled_from([21, 24, 27, 30]))
@settings(max_examples=150, deadline=None)
def test_long_ties(texts, length):
    """Texts of two letters: heads tie for long, cores overlap, runs are many."""
    rows = list(enumerate(texts))
    assert in_process(rows, length) == brute(rows, length)


@pytest.mark.parametrize("name, value", [("PIECE", 64), ("LOCAL", 1), ("HOT", 1), ("BLOCK", 1), ("BATCH", 200)])
def test_bounds_change_nothing(monkeypatch, name, value):
    monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    line = " ".join(rng.choice(words) for _ in range(20))
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
        at = rng.randrange(len(text) + 1)
        rows.append((i, text[:at] + line[rng.randrange(5) :] + text[at:] if i % 3 else rows[i // 2][1][3:] + "x" if i else line))
    assert in_process(rows, 30) == brute(rows, 30)


def test_difference_cover():
    assert all(any((i + d) % 7 in suffixes.COVER and (j + d) % 7 in suffixes.COVER for d in range(7)) for i in range(7) for j in range(7))


@pytest.mark.parametrize("units", [1, 2, 3, 5, 13])
def test_cover_ranks_order_strings(units):
    data = np.frombuffer(bytes(random.Random(units).choice(b"ab") for _ in range(600)), np.uint8)
    rank = suffixes.cover_ranks(suffixes.words(data), units)
    at = [p for p in range(500) if p % 7 in suffixes.COVER]
    strings = {p: data[p : p + 7 * units].tobytes() for p in at}
    by_rank = sorted(at, key=lambda p: rank[p])
    assert [strings[p] for p in by_rank] == sorted(strings.values())
    assert len({int(rank[p]) for p in at}) == len(set(strings.values()))


SCHEMA = "doc_id long, text string, key string, spans long, bucket long"


def test_rows(spark):
    """Copies, repeated rows, one id with two texts, nulls, empty and short texts, long texts, letters of several bytes, a string across a text's end."""
    rng = random.Random(9)
    prose = " ".join("".join(rng.choice("abcdefgh ") for _ in range(6)) for _ in range(60))
    rows = [(i, t, "x", 1, 2) for i, t in enumerate([prose, prose, "new " + prose[50:300] + " end", None, "", "short", prose[:99], prose[:100], "é" * 120, "z" * 500, prose * 40, prose[100:] + prose])]
    rows += [(None, "é" * 60, "x", 1, 2)]
    docs = spark.createDataFrame(rows + rows[:1] * 3 + rows[4:6], SCHEMA)
    got = suffixes.repeated_bytes(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r[0], r[1]) for r in docs.collect()])
    kept = suffixes.repeats(docs.where("doc_id = 2 or doc_id = 0").dropDuplicates(), with_kept=True)
    r = {r.doc_id: r for r in kept.collect()}
    text = rows[2][1].encode()
    assert bytes(r[2].kept) == b"".join(text[a:b] for a, b in zip([0] + [s.end for s in r[2].spans], [s.begin for s in r[2].spans] + [len(text)], strict=True))
    assert r[2].n_removed >= 250 and bytes(r[0].kept) == prose.encode()


def test_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "a" * 150), (1, "a" * 120 + "b")], "doc_id long, text string")
    rows = suffixes.repeated_bytes(docs).collect()
    assert len(rows) == 2 and sum(r.n_bytes - r.n_removed for r in rows) == 2  # whichever comes first: one "a", and the "b"


def test_empty_table(spark):
    assert suffixes.repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from capturelake.llm import oracles

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{sf}/documents.parquet')")
    rel = duckdb.sql(oracles.REPEATS)
    got = suffixes.repeated_bytes(spark.read.parquet(f"{sf}/documents.parquet")).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rel.fetchall()), key=str)
