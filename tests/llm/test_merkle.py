import hashlib
import zlib

import pytest

from capturelake.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run, k = level[i // 3 * 3 : i // 3 * 3 + 3], i % 3
        out.append((run[:k], run[k + 1 :]))
        i //= 3
    return out


def brute(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h([enc(r.doc_id), enc(r.source), enc(r.lang), enc(r.n_chars), enc(t)])
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r.text) for r in by[s]]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps, t = path(trees[s], i) + path(top, k), r.text
            if r.doc_id is not None and t is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                t = t.replace("\n", "")
            node = leaf(r, t)
            for a, b in steps:
                node = h([*a, node, *b])
            out.append((r.doc_id, leaf(r, r.text), trees[s][-1][0], top[-1][0], h([x for a, b in steps for x in a + b]), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 10, 26, 27])
@pytest.mark.parametrize("stack", [1, 2, 3])
def test_successive_paths(n, stack):
    leaves = [h([str(i)]) for i in range(n)]
    levels = merkle.levels_of(n)
    joined = [[("".join(a), "".join(b)) for a, b in path(tree(leaves), i)] for i in range(n)]
    assert list(merkle.successive_paths(leaves, levels, stack)) == joined
    assert merkle.block_root(leaves, levels) == tree(leaves)[-1][0]


def test_bounded_memory():
    """What is held beside the leaves are two small subtrees for each stack, not the block's tree."""
    held = []

    class Watched(merkle.Subtree):
        def __init__(self, *a):
            super().__init__(*a)
            held.append(self)

    own, merkle.Subtree = merkle.Subtree, Watched
    try:
        for _ in merkle.successive_paths([str(i) for i in range(729)], 6):
            pass
    finally:
        merkle.Subtree = own
    assert max(sum(map(len, t.kept)) for t in held) <= 3 + 9


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, n int"


@pytest.mark.parametrize("n", [0, 1, 40, 200])
def test_equals_plain_trees(spark, monkeypatch, n):
    """Blocks of nine leaves: three levels of blocks, a source with half of the rows, nulls in every column, ties and repeats."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    pick = lambda i, k, v: None if i % k == 0 else v
    rows = [(pick(i, 31, i // 2 if i % 5 == 0 else i), pick(i, 17, "hot" if i % 2 else f"ü{i % 11}"), pick(i, 7, "en"), pick(i, 13, i), pick(i, 19, f"a\n{i}é" if i % 3 else ""), 7, 7) for i in range(n)]
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA)
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs.collect())


def test_proofs_hold_for_their_rows_alone(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}", 0, 0) for i in range(5)], SCHEMA)
    rows = merkle.inclusion_proofs(docs).collect()
    fold = lambda leaf, steps: leaf if not steps else fold(h([steps[0].left, leaf, steps[0].right]), steps[1:])
    assert all(fold(r.leaf, r.path) == r.root and r.changed_leaf is None for r in rows)
    assert fold(rows[0].leaf, rows[1].path) != rows[0].root
    assert {r.subroot for r in rows} == {r.root for r in rows}  # one source: its root is the root of all


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from capturelake.llm import oracles

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{sf}/documents.parquet')")
    rel = duckdb.sql(oracles.MERKLE)
    got = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet")).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rel.fetchall()), key=str)
