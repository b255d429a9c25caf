"""The stages of corpus_pipeline.py, each against a plain version over its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import brute as hit_words
from test_near_duplicates import brute as groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, copies int"


def corpus():
    import random

    rng = random.Random(21)
    words = {"en": "the of and to in that is was for it with as his on be at by had not are".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(n))
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        t = text(lang, rng.choice([3, 12, 40, 90]))
        if i % 6 == 1:
            t = rows[-1][1]  # an exact copy
        elif i % 6 == 2:
            t = " ".join([*(rows[-2][1] or "").split(), "more"])  # a near one where it is long
        rows.append((i, t, lang, f"src{i % 4}" if i % 9 else None))
    passage = " ".join(f"bench{i}" for i in range(14))
    rows += [(300 + i, f"{text('en', 20)} {passage} {text('en', 20)}", "en", "src1") for i in range(5)]
    rows += [(400, None, "en", "src1"), (401, "", None, None), (402, "123 !?", "en", "src2"), (403, "x " * 4000, "en", "src2"), (404, text("de", 60), None, None)]
    rows += [rows[7], rows[7], (None, text("en", 50), "en", "src0")]
    return [(*r, len(r[1] or ""), "own", 9) for r in rows], [(1, passage), (2, None), (3, "not there at all")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_one_by_one(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    def step(name):
        out = stages[name](spark, docs, folder)
        assert out.columns == columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    rows = [tuple(r) for r in docs.collect()]
    docs = step("language")
    kept = [tuple(r) for r in docs.collect()]
    assert Counter(kept) == Counter(r for r in rows if re.search(r"[^\W\d_]", r[1] or ""))

    docs = step("near_duplicates")
    once = [tuple(r) for r in docs.collect()]
    assert not Counter(once) - Counter(kept)
    high = 10**9  # null ids come last
    label = [g for _, g in groups([(high if r[0] is None else r[0], r[1]) for r in kept], 5, 80)]
    assert Counter(high if r[0] is None else r[0] for r in once) == Counter({g: 1 for g in label})

    docs = step("decontamination")
    clean = [tuple(r) for r in docs.collect()]
    hit = {d for d, _, n, *_ in hit_words([(r[0], r[1]) for r in once], corpus()[1], 10) if n}
    assert Counter(clean) == Counter(r for r in once if r[0] not in hit) and len(clean) < len(once)

    docs = step("mixing")
    mixed = Counter(tuple(r) for r in docs.collect())
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own, took = Counter(), Counter()
    for r in clean:
        own[r[3]] += size(r[1])
    for r, n in mixed.items():
        took[r[3]] += n * size(r[1])
    names = sorted((s for s in own if s is not None)) + [None] * (None in own)
    weight, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names)
    total = sum(own.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * own[s]}
        for s in full or set(open_):
            target[s] = 3 * own[s] if full else weight[s] * level
            open_.discard(s)
    assert all(abs(took[s] - target[s]) <= 0.05 * target[s] + 120 for s in names)

    got = stages["tokens"](spark, docs, folder).collect()
    tokenizers = pytest.importorskip("tokenizers")
    from capturelake.llm.token_files import default_tokenizer

    plain = tokenizers.Tokenizer.from_file(default_tokenizer())
    ids = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    want = Counter((r[0], len(x := ids(r[1])), zlib.crc32(x.tobytes())) for r, n in mixed.items() for _ in range(n))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_whole_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, folder).count() > 50
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
