"""Near-duplicate documents by circulant MinHash, with exact verification.

A document's set are the hashes of its distinct shingles of ``width`` words; a
shorter document has its whole sequence as its only element. Documents with one set are one class.

Signatures need two permutations of the 32-bit integers: the first breaks up the
order of the elements, the second, shifted circularly by one step after another,
gives all ``BANDS * ROWS`` coordinates. Two classes with similarity s share a band with
probability 1 - (1 - s^ROWS)^BANDS: all but 4 in ten million at 0.85, all but 6 in a hundred
thousand at 0.8.

Bands give no pairs. Each class of a bucket is tied to the bucket's least class, and
connected components of these ties are clusters: any two classes that share a bucket are
in one cluster. The texts of a cluster's classes meet in one task, which finds links on
full sets through an inverted index, least sets first, skipping what is already
connected, and returns a spanning forest of the links. A cluster of more than
``CLUSTER_ELEMENTS`` elements is cut by set size into overlapping levels (sets
that differ more in size can't be linked), then into parts. Each part meets ``HEADS`` classes of its level
in a task of bounded memory, which connects near copies of one text, however many, in work that grows with
their number; only classes that are outside of the level's largest component then meet
all parts of it. So no link is lost and nothing is gathered. Components of the links are
the groups; the document with the least id stays.

Nulls and odd input: a null or empty text, or one of white space, has an empty set and is linked
with nothing, not even its like. Null ids come after all others; a group of null ids
alone keeps one row, with a null component. Rows that repeat with the same id and text
are in one group and are all marked as kept if their id is the least; `deduplicated` keeps one.
Empty tables give no rows. A text of any length is one set, held whole by one task (16 bytes a word).
Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import add_from_text, free_name, release_memory, written
from capturelake.llm.components import components
from capturelake.llm.joins import counted, hot_keys, join_hot

BANDS, ROWS = 25, 5
#: Elements of the sets that meet in one task at most, about (16 bytes each and their texts).
CLUSTER_ELEMENTS = 150_000
#: Classes of a large cluster's level that meet each of its parts.
HEADS = 8
#: Words that a worker remembers with their hashes.
CACHE_WORDS = 100_000
_M = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def _forget() -> None:
    """Words of a task are of no use to a worker that waits."""
    _words.clear()


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _M(33)
    h *= _M(0xFF51AFD7ED558CCD)
    h ^= h >> _M(33)
    h *= _M(0xC4CEB9FE1A85EC53)
    h ^= h >> _M(33)
    return h


def elements(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in lower-case A-Z."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    if n < 1:
        return np.array([int.from_bytes(hashlib.blake2b(b"short\0" + b" ".join(words), digest_size=8).digest(), "little")], dtype=np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = (out << _M(7) | out >> _M(57)) * _M(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(_mix(out))


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


_SHIFTS = (np.arange(BANDS * ROWS, dtype=np.uint64) * 0x9E3779B1 & 0xFFFFFFFF).astype(np.uint32)


def signature(own: np.ndarray) -> np.ndarray:
    """All coordinates: the least value of the second permutation over the first one's
    places, moved round the circle by each shift."""
    place = _permute((own * _M(0xD6E8FEB86659FD93) >> _M(32)).astype(np.uint32))
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(place), 512):
        np.minimum(least, _permute(place[i : i + 512, None] + _SHIFTS[None, :]).min(axis=0), out=least)
    return least


def bands(own: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for each band."""
    sig = signature(own).reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _M(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = _mix((h ^ sig[:, k]) * _M(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def linked(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def forest(sets: list[np.ndarray], percent: int, known: list | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect what all links between ``sets`` connect; sets with one value in ``known`` are connected already.

    Sets are taken by size. The elements that are rarest here form a prefix so long that a linked
    pair must share one of them; the sets before that do are counted on full sets, but
    for those that are connected already.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if linked(int(sizes[0]), int(sizes[1]), common, percent) else []
    order = np.lexsort((np.arange(m), sizes))
    flat = np.concatenate([sets[i] for i in order])
    _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
    del flat
    rank = np.empty(len(counts), dtype=np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)  # rare elements first
    ids = rank[ids]
    starts = np.concatenate([[0], np.cumsum(sizes[order])])
    postings = np.repeat(np.arange(m, dtype=np.int32), sizes[order])[np.argsort(ids, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(counts)))])
    root, out, n = np.arange(m), [], sizes[order]
    if known is not None:
        first: dict = {}
        root = np.array([first.setdefault(known[i], k) for k, i in enumerate(order.tolist())])
    for i in range(m):
        own = np.sort(ids[starts[i] : starts[i + 1]])
        need = -(-percent * n[i] // 100)  # elements that a linked set shares at least
        rare = own[: n[i] - need + 1]
        near = [p[: np.searchsorted(p, i)] for p in (postings[at[e] : at[e + 1]] for e in rare.tolist())]
        near = np.unique(np.concatenate(near))
        near = near[(100 * n[near] >= percent * n[i]) & (root[near] != root[i])]
        if not len(near):
            continue
        if len(near) > 16:  # count all of them at once
            every = np.concatenate([p[: np.searchsorted(p, i)] for p in (postings[at[e] : at[e + 1]] for e in own.tolist())])
            common = np.bincount(every, minlength=m)[near]
        else:
            common = np.array([np.isin(ids[starts[j] : starts[j + 1]], own, assume_unique=True, kind="sort").sum() for j in near.tolist()])
        for j in near[100 * common >= percent * (n[near] + n[i] - common)].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((int(order[j]), int(order[i])))
    return out


FIELDS = [T.StructField(n, k) for n, k in (("elements", T.LongType()), ("class", T.BinaryType()), ("bands", T.ArrayType(T.LongType())))]


def classes_of(docs: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """``docs`` with three more columns: size of the set, digest of the set, band hashes."""

    def make():
        def run(texts):
            sets = [elements(t, width) for t in texts]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            return [[len(s) for s in sets], digests, [bands(s) if len(s) else None for s in sets]]

        return run

    return add_from_text(docs, text_col, FIELDS, make, done=_forget)


def _clusters(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (class, cluster, elements) of the classes that have a neighbour: of clusters that one task can hold, and of larger ones."""
    buckets = classes.select("class", F.posexplode("bands").alias("band", "h")).select("class", F.xxhash64("band", "h").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("class").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = buckets.join(heads, "bucket").where(F.col("class") != F.col("head")).select(F.col("class").alias("a"), F.col("head").alias("b"))
    found = components(ties)
    member = written(found.join(classes.select(F.col("class").alias("node"), "elements"), "node").select(F.col("node").alias("class"), F.col("label").alias("cluster"), "elements"), "members")
    large = written(member.groupBy("cluster").agg(F.sum("elements").alias("total")).where(F.col("total") > CLUSTER_ELEMENTS).select("cluster"), "large")
    if not large.limit(1).count():
        return member, member.limit(0)
    narrow = counted(large)
    return member.join(narrow, "cluster", "left_anti"), member.join(narrow, "cluster", "left_semi")


def _levels(large: DataFrame, percent: int) -> DataFrame:
    """A written table (class, cluster, level, elements, parts, own): sets whose sizes differ by more than the
    threshold's factor can't be linked, so each is in its level and the one below."""
    level = F.floor(F.log(F.col("elements").cast("double")) / F.lit(-np.log(percent / 100))).cast("int")
    levels = written(large.select("class", "cluster", "elements", F.explode(F.array(level, level - 1)).alias("level")), "levels")
    parts = levels.groupBy("cluster", "level").agg(F.ceil(2 * F.sum("elements") / CLUSTER_ELEMENTS).cast("int").alias("parts"))
    return written(levels.join(counted(written(parts, "parts")), ["cluster", "level"]).withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")), "dealt")


def _with_heads(levels: DataFrame) -> DataFrame:
    """(class, cell): each part of a level, with the level's heads."""
    rank = F.row_number().over(Window.partitionBy("cluster", "level").orderBy("class"))
    heads = levels.withColumn("rank", rank).where(F.col("rank") <= HEADS).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = levels.select("class", "cluster", "level", "own").union(heads.select("class", "cluster", "level", "own"))
    return both.select("class", F.xxhash64("cluster", "level", "own").alias("cell"))


def _with_rest(levels: DataFrame, links: DataFrame) -> DataFrame | None:
    """(class, cell, known): classes outside of their level's largest component, each part of them with
    each part of the level; ``known`` is the component. None if there are no such classes."""
    found = components(links)
    labelled = written(levels.join(found.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("known", F.coalesce("label", "class")).drop("label"), "known")
    sizes = labelled.groupBy("cluster", "level", "known").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster", "level").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.count("*").alias("components")).where("components > 1")
    main = counted(written(main.select("cluster", "level", "main"), "main"))
    rest = written(labelled.join(main, ["cluster", "level"]).where("known <> main").drop("main"), "rest")
    if not rest.limit(1).count():
        return None
    rest_parts = written(rest.groupBy("cluster", "level").agg(F.ceil(2 * F.sum("elements") / CLUSTER_ELEMENTS).cast("int").alias("rest_parts")), "rest_parts")
    rest = rest.join(counted(rest_parts), ["cluster", "level"]).withColumn("i", F.pmod(F.xxhash64("class", F.lit(1)), F.col("rest_parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = labelled.join(counted(rest_parts), ["cluster", "level"]).withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)))
    columns = ["class", F.xxhash64("cluster", "level", "i", "j").alias("cell"), "known"]
    return rest.select(*columns).union(every.select(*columns))


def group(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: every row of ``docs`` as (doc_id, print, elements, class), and the groups as
    (class, label, component_id), each class once. ``print`` is a hash of the text."""
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    table = written(classes_of(light, width).drop("text"), "sets")
    of_class = [F.min(F.struct("doc_id", "print")).alias("one"), F.min("doc_id").alias("least"), F.first("elements").alias("elements"), F.first("bands").alias("bands")]
    classes = written(table.where("elements > 0").groupBy("class").agg(*of_class), "classes")
    small, large = _clusters(classes)
    levels = _levels(large, percent)
    cells = small.select("class", F.xxhash64("cluster").alias("cell")).union(_with_heads(levels))
    cells = written(cells.withColumn("known", F.lit(None).cast("binary")), "cells")
    # one text for each class that has a neighbour: that of one row, or of those that repeat it
    wanted = written(cells.select("class").distinct().join(classes.select("class", "one.doc_id", "one.print"), "class"), "wanted")
    near = light.join(counted(wanted), light.doc_id.eqNullSafe(wanted["doc_id"]) & (light["print"] == wanted["print"]))
    texts = written(near.groupBy("class").agg(F.first("text").alias("text")), "texts")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict[bytes, np.ndarray] = {}
        known: dict[bytes, bytes] = {}
        for key, text, label in zip(pdf["class"], pdf["text"], pdf["known"], strict=True):
            key = bytes(key)
            if key not in own:
                s = elements(text, width)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key:  # else another text with the same hash
                    own[key], known[key] = s, key if label is None else bytes(label)
        names = sorted(own)
        if len(names) < 2:
            return pd.DataFrame({"a": [], "b": []})
        pairs = forest([own[k] for k in names], percent, [known[k] for k in names])
        if len(pdf) > 200:
            _forget()
            release_memory()
        return pd.DataFrame({"a": [names[j] for _, j in pairs], "b": [names[i] for i, _ in pairs]})  # the earlier one, which may be a hub, is b

    def verified(cells: DataFrame) -> DataFrame:
        return written(cells.join(texts, "class").groupBy("cell").applyInPandas(verify, "a binary, b binary"), "links")

    links = verified(cells)
    more = _with_rest(levels, links) if levels.limit(1).count() else None
    if more is not None:
        links = links.union(verified(more))
    found = components(links)
    labelled = classes.join(found.select(F.col("node").alias("class"), "label"), "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    labelled = written(labelled, "labelled")
    of_label = written(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "labels")
    return table.drop("bands"), written(join_hot(labelled, of_label, "label", hot_keys(labelled, "label")).select("class", "label", "component_id"), "groups")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    table, groups = group(docs, width, percent, id_col, text_col)
    grouped = join_hot(table, groups, "class", hot_keys(table, "class")).select("doc_id", "elements", "component_id")
    alone = table.where("elements = 0").select("doc_id", "elements", F.col("doc_id").alias("component_id"))
    out = grouped.union(alone)
    return out.select("doc_id", F.col("elements").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each group; documents without words stay.

    Rows are told apart by id and a hash of the text, so that what goes is a narrow table.
    """
    table, groups = group(docs, width, percent, id_col, text_col)
    rows = written(join_hot(table, groups, "class", hot_keys(table, "class")).select("doc_id", "print", "label", "component_id"), "rows")
    # rows with their group's least id: one text of these stays, and of its rows one
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    texts = written(rows.where(first).groupBy("label", "doc_id", "print").agg(F.count("*").alias("rows")), "firsts")
    best = texts.groupBy("label").agg(F.min(F.struct("print", "rows")).alias("best"))
    other = texts.join(best, "label").where(F.col("print") != F.col("best.print")).select("doc_id", "print")
    gone = written(rows.where(~first).select("doc_id", "print").union(other).distinct(), "gone")
    twice = written(best.where("best.rows > 1").select("label", F.col("best.print").alias("print")).join(texts, ["label", "print"]).select("doc_id", "print"), "twice")
    mark, rank = free_name(docs, "print"), free_name(docs, "rank")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    same = lambda t: marked[id_col].eqNullSafe(t["doc_id"]) & (marked[mark] == t["print"])
    out = marked.join(counted(gone), same(gone), "left_anti")
    if twice.limit(1).count():  # rows that repeat the kept document's id and text: one of them stays
        once = out.join(counted(twice), out[id_col].eqNullSafe(twice["doc_id"]) & (out[mark] == twice["print"]), "left_semi")
        place = F.row_number().over(Window.partitionBy(id_col, mark).orderBy(F.xxhash64(*docs.columns)))
        once = once.withColumn(rank, place).where(F.col(rank) == 1).drop(rank)
        out = out.join(counted(twice), out[id_col].eqNullSafe(twice["doc_id"]) & (out[mark] == twice["print"]), "left_anti").unionByName(once)
    return out.select(*docs.columns)
