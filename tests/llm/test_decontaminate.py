import hashlib
import random
import re

import pytest

from capturelake.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, width):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(i) for i in ids if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def data():
    rng = random.Random(4)
    words = ["a", "b", "cé", "D", "E5", "ß", "日本", "x"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 2, 4, 5, 9]))) for i in range(25)] + [(10, "only here"), (10, "again here"), (None, "a b a b a b"), (99, None)]
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)] + [(60, None), (61, ""), (61, "ONLY here."), (None, "again--here only here")]
    return docs, items


@pytest.mark.parametrize("bound", [1 << 20, 120])
def test_equals_brute_force(spark, bound):
    docs, items = data()
    got = dc.contamination(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, found int, item_id int"), spark.createDataFrame(items, "item_id long, text string"), width=5, bound=bound)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(docs, items, 5), key=key)


@pytest.mark.parametrize("width", [1, 2, 5, 10])
def test_widths_and_shared_segments(width):
    """Items that share segments, overlap themselves, and are shorter than a window."""
    rng = random.Random(width)
    line = lambda n: " ".join(rng.choices("abc", k=n))
    items = [(i, line(rng.randint(0, 3 * width))) for i in range(30)] + [(40, "a " * 4 * width), (41, "a " * (width - 1))]
    docs = [(i, line(rng.randint(0, 60))) for i in range(200)] + [(300, "a " * 50), (301, items[3][1] + " zz " + items[4][1])]
    machine = dc.Automaton(items, width)
    for (_, text), (_, n, n_hit, n_items, sha, _) in zip(docs, brute(docs, items, width), strict=True):
        words = dc.words_of(text)
        runs, found = machine.find(words, " " + b" ".join(words).decode("latin-1") + " ") if words else ([], set())
        names = sorted({str(items[k][0]) for k in found})
        assert (len(words), len({i for a, b in runs for i in range(a, b)}), len(names)) == (n, n_hit, n_items)
        assert hashlib.sha256(",".join(names).encode()).hexdigest() == sha


def test_many_items_take_bounded_memory_and_time():
    import time

    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(100))) for i in range(3000)]
    began = time.process_time()
    machine = dc.Automaton(items, 10)
    words = dc.words_of(items[7][1] + " between " + items[8][1])
    runs, found = machine.find(words, " " + b" ".join(words).decode("latin-1") + " ")
    assert found == {7, 8} and len({i for a, b in runs for i in range(a, b)}) == 200
    size = sum(len(t) for _, t in items)
    assert machine.machine.get_stats()["total_size"] < 60 * size and time.process_time() - began < 30


def test_offsets_in_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünïcode: THE quick--Brown fox!")], "doc_id long, text string")
    found, f = dc.find_items(docs, spark.createDataFrame([(1, "the quick brown")], "item_id long, text string"), offsets=True)
    row = found.first()
    (span,) = row[f].spans
    assert row.text[span.begin : span.end] == "THE quick--Brown"


def test_filter_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "clean text"), (2, "has the passage here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the passage")], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.without_contaminated(docs, items).collect()) == [1, 3]
    assert dc.without_contaminated(docs, items.limit(0)).count() == 3
    assert dc.contamination(docs.limit(0), items).collect() == []
