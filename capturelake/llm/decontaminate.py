"""Benchmark passages in documents, by one Aho-Corasick automaton.

All test items are normalised to words. What is sought are windows of ``width``
consecutive words of an item (a shorter item is one window). An item is cut into segments of half a
window, one after the other; each window holds a whole one. So the automaton has these segments
(and short items) as its patterns, a tenth of what all windows would take. Each document is
normalised the same way and scanned once; only where a segment occurs, windows of the
document are looked up among the items' windows by hash and compared word by word. The place of a
match gives the words it covers, and with ``offsets`` the characters of the original text.

Normalisation works on UTF-8 bytes: one table maps A-Z to a-z and every ASCII
byte that is neither letter nor digit to a space, so words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text.

The items are sent to the executors only up to ``BLOCK_BYTES``, a measured size.
A larger benchmark is cut into blocks of at most that size, written to the
shared folder; ``HOLD_BYTES`` of documents at a time are then scanned once for every block, so
memory stays bounded by one block and no match is lost. A document of any length is held whole by one task.

Nulls and odd input: a null or empty text has no words and no hits; a null
or empty item has no window; a null item_id is not counted as an item, though its
windows hit. Items with the same id count once, documents with
the same id each have a row. Empty tables give no rows or no hits. A text of any length
is scanned whole. An own column named ``found`` stays.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import add_from_text, file_system, free_name, put_file, shared_path

#: Bytes of item text in one automaton, which takes about 40 times as much memory.
BLOCK_BYTES = 4 << 20
#: Bytes of documents that are scanned by each block in turn, where there are several.
HOLD_BYTES = 32 << 20

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


class Automaton:
    """The windows of some items, and what a text has of them."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        import ahocorasick

        self.width, self.half = width, (width + 1) // 2
        self.machine = ahocorasick.Automaton()
        self.ids = [i for i, _ in items]
        self.short: list[set] = []  # items of each short pattern
        number: dict[bytes, int] = {}
        marks: dict[bytes, tuple[int, bool, int]] = {}  # a pattern's words, whether it is a segment, its place in short
        texts, owners = [], []
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            if len(words) < width:
                n, segment, at = marks.get(key := b" ".join(words), (len(words), False, -1))
                if at < 0:
                    at = len(self.short)
                    self.short.append(set())
                marks[key] = n, segment, at
                self.short[at].add(k)
                continue
            for i in range(0, len(words) - self.half + 1, self.half):
                n, _, at = marks.get(key := b" ".join(words[i : i + self.half]), (self.half, True, -1))
                marks[key] = n, True, at
            texts.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32))
            owners.append(k)
        self.number = number
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.words = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        begin = np.cumsum(sizes) - sizes
        count = sizes - width + 1
        starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum())) if texts else np.zeros(0, np.int64)
        hashes = self._hashes(self.words)[starts] if texts else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts = hashes[order], starts[order]
        self.owners = np.repeat(np.array(owners, dtype=np.int64), count)[order]
        for key, mark in marks.items():
            self.machine.add_word(f" {key.decode('latin-1')} ", (len(key) + 2, *mark))
        self.empty = not marks
        if marks:
            self.machine.make_automaton()

    def _hashes(self, numbers: np.ndarray) -> np.ndarray:
        """A hash of the window that begins at each word."""
        h = np.zeros(max(0, len(numbers) - self.width + 1), dtype=np.uint64)
        for k in range(self.width):
            h = (h ^ (numbers[k : k + len(h)].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def find(self, words: list[bytes], joined: str) -> tuple[list[tuple[int, int]], set]:
        """Runs (first word, end) of hit words of ' word word ... word ', and places of the items they are of."""
        runs: list[tuple[int, int]] = []
        found: set = set()
        if self.empty or not (hits := list(self.machine.iter(joined))):
            return runs, found
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)
        firsts = np.searchsorted(spaces, np.array([end - size + 1 for end, (size, _, _, _) in hits]))
        near = []
        for first, (_, (_, n, segment, short)) in zip(firsts.tolist(), hits, strict=True):
            if short >= 0:
                runs.append((first, first + n))
                found |= self.short[short]
            if segment:
                near.append(first)
        if near and len(words) >= self.width:
            number = self.number
            own = np.array([number.get(w, -1) for w in words], dtype=np.int32)
            at = np.unique(np.add.outer(np.array(near), np.arange(self.half - self.width, 1)))
            at = at[(at >= 0) & (at <= len(words) - self.width)]
            wanted = self._hashes(own)[at]
            low, high = np.searchsorted(self.hashes, wanted), np.searchsorted(self.hashes, wanted, side="right")
            some = low < high
            for first, lo, hi in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                same = (self.words[self.starts[lo:hi, None] + np.arange(self.width)] == own[first : first + self.width]).all(axis=1)
                if same.any():
                    runs.append((first, first + self.width))
                    found.update(self.owners[lo:hi][same].tolist())
        return runs, found


def original_offsets(text: str) -> list[tuple[int, int]]:
    """Characters (begin, end) of each word of the original text."""
    out, inside, begin = [], False, 0
    for i, c in enumerate(text):
        word = ord(c) >= 128 or (c.isascii() and c.isalnum())
        if word and not inside:
            begin = i
        elif inside and not word:
            out.append((begin, i))
        inside = word
    if inside:
        out.append((begin, len(text)))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, bound: int) -> tuple[list | None, list[str]]:
    """The items themselves if they fit the bound, else the files of blocks that do."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t")).alias("n"), F.count("*").alias("rows")).first()
    size = (total.n or 0) + 64 * total.rows
    if size <= bound:
        return [tuple(r) for r in items.collect()], []
    spark, folder = benchmark.sparkSession, shared_path(benchmark.sparkSession, "items")
    n = -(-size // (bound // 2))

    def save(key, batch):
        import pyarrow as pa

        block, rows = key[0].as_py(), list(zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True))
        made, held, names = 0, [], []
        for k, row in enumerate(rows):
            held.append(row)
            if k == len(rows) - 1 or sum(len(t) for _, t in held[-1:]) + made > bound:
                name = f"{folder}/block-{block:06d}-{len(names):06d}"
                data = pickle.dumps(held)
                put_file(name, lambda out, data=data: out.write(data), uuid.uuid4().hex)
                names.append(name)
                made, held = 0, []
            else:
                made += len(row[1])
        return pa.table({"name": pa.array(names, pa.string())})

    cut = items.withColumn("b", F.pmod(F.xxhash64("t", F.col("i").cast("string")), F.lit(n)).cast("int")).groupBy("b").applyInArrow(lambda k, t: save(k, t), "name string")
    return None, sorted(r.name for r in cut.collect())


def find_items(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", bound: int = BLOCK_BYTES, offsets: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of n_words, n_hit, items (sorted ids as
    strings) and, with ``offsets``, spans (begin and end characters in the original text
    of each run of hit words); also that column's name. All rows and columns stay.
    """
    items, files = _blocks(benchmark, item_id, item_text, bound)
    held = docs.sparkSession.sparkContext.broadcast(items)  # at most `bound` bytes of text
    name = free_name(docs, "found")
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), *([T.StructField("spans", span)] if offsets else [])])

    def make():
        own = Automaton(held.value, width) if held.value is not None else None

        def machines():
            if own is not None:
                yield own
            for f in files:
                fs, path = file_system(f)
                with fs.open_input_stream(path) as s:
                    yield Automaton(pickle.loads(s.read()), width)

        def run(texts):
            words = [words_of(t) for t in texts]
            joined = [" " + b" ".join(w).decode("latin-1") + " " if w else "" for w in words]
            hits: list[set] = [set() for _ in texts]
            runs: list[list[tuple[int, int]]] = [[] for _ in texts]
            for machine in machines():
                for k, text in enumerate(joined):
                    if text:
                        own_runs, found = machine.find(words[k], text)
                        runs[k] += own_runs
                        hits[k].update(i for i in (machine.ids[j] for j in found) if i is not None)
            out = []
            for k, w in enumerate(words):
                n_hit, spans = 0, []
                if runs[k]:
                    change = np.zeros(len(w) + 1, dtype=np.int64)
                    a = np.array(runs[k])
                    np.add.at(change, a[:, 0], 1)
                    np.add.at(change, a[:, 1], -1)
                    covered = np.cumsum(change[:-1]) > 0
                    n_hit = int(covered.sum())
                    if offsets:
                        at = original_offsets(texts[k])
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                        spans = [{"begin": at[i][0], "end": at[j - 1][1]} for i, j in edges.reshape(-1, 2).tolist()]
                row = {"n_words": len(w), "n_hit": n_hit, "items": sorted({str(i) for i in hits[k]})}
                out.append(row | ({"spans": spans} if offsets else {}))
            return [out]

        return run

    return add_from_text(docs, text_col, [T.StructField(name, kind)], make, hold=HOLD_BYTES if files else 0), name


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, f = find_items(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, width, **options)
    return found.select(
        "doc_id",
        F.col(f"{f}.n_words").alias("n_words"),
        F.col(f"{f}.n_hit").alias("n_hit"),
        F.size(f"{f}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{f}.items", ","), 256).alias("items_sha256"),
        (F.col(f"{f}.n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage."""
    found, f = find_items(docs, benchmark, width, **options)
    return found.where(F.col(f"{f}.n_hit") == 0).drop(f)
