"""Repeated substrings of a corpus, by sorting its suffixes one bucket at a time with the ranks of a difference cover.

A byte is removed if it lies in a string of ``length`` bytes that also starts earlier. So suffixes are to be told apart by their
first ``length`` bytes, their *heads*, and the first of each class of equal heads stays.

*Buckets.* A head's *core* is its least substring of half its length, by hash, the leftmost of equal ones. Equal heads have equal cores at
equal places, so the suffixes of one core are a bucket, and suffixes that follow one another in a text with one core are
a *run*, some 25 of them; the bytes of their heads, little more than one head's, are all that sorting them takes.

*Census.* Each run goes to its bucket as two hashes. A run whose bytes are those of an earlier one is a repeat as a whole.
A bucket whose runs all have the same bytes needs nothing more. Tasks settle what they can before anything moves.

*Sorting.* First runs of other buckets are sent to them with their bytes. A task takes up one block of whole buckets after the other. It first ranks the
suffixes at the positions of a difference cover (period 7, cover {0, 1, 3}): by seven bytes, then by doubling with multiples of the period, until ranks
tell apart all but a head's first and last few bytes. For any two suffixes there is a step of 1 to 7 that leads both
to cover positions. So each suffix stands in three lists, one for each class of the cover, ordered by its first and last bytes, the step and the rank there; equal heads meet
in at least one list, and the least position of a list's entry tells all others of it that they are repeats. Neither a head nor a comparison ever takes more
than ranks, whatever the ties.

*Hot buckets.* A core that has more than ``LOCAL`` different runs in one task's batch, or ``HOT`` in all, is split: its suffixes are sent one by one, to buckets by the
hash of the whole head. So no task gets a third of all rows for one common line.

Equal runs of a bucket are told by 80 bits of hashes; heads of different runs by their bytes.

Nulls and odd input: a null text is empty and has nothing to remove, nor has one shorter than ``length``. Documents stand in order of id, null ids first, those
with one id in order of a hash of their text; of rows that repeat with id and text the first stays. Long texts are hashed in
pieces of ``PIECE`` bytes. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import bounded_batches, in_parts, release_memory

LENGTH = 100
#: Bytes hashed at once; heads of longer texts are cut into runs at its multiples.
PIECE = 1 << 20
#: Bytes of text whose runs a task settles before it sends them; different runs of a core in them, and in all, beyond which its bucket is split.
BATCH, LOCAL, HOT = 16 << 20, 256, 100_000
#: Bytes of runs that are sorted at once, or one larger bucket.
BLOCK = 4 << 20
#: A difference cover: every step modulo the period lies between two of its members.
PERIOD, COVER = 7, (0, 1, 3)
#: What the census says of a run.
REPEAT, SORT, SPLIT = 1, 2, 3

_STEP, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # odd constants of a well-known mixer


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of a base and of its inverse."""
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    base = _MIX1 * 4 + 5 & (1 << 64) - 1
    powers = np.full(n, base, np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return letters, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


class Hashes:
    """Hashes of substrings of a buffer, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        letters, powers, self.inverse = _tables(PIECE + (1 << 13) if len(data) <= PIECE + (1 << 13) else 1 << len(data).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * powers[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        return mixed((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(_STEP))


class Runs:
    """The runs of some texts: their text, first and last suffix, core and hash, and number in the text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        found = [self._piece(data, offsets, a, b, length) for a, b in self._pieces(offsets)]
        self.text, self.first, self.last, self.core, self.own = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate((np.int64, np.int64, np.int64, np.uint64, np.uint64)))
        starts = np.flatnonzero(np.r_[True, self.text[1:] != self.text[:-1]]) if len(self.text) else np.zeros(0, np.int64)
        self.number = np.arange(len(self.text)) - np.repeat(starts, np.diff(np.r_[starts, len(self.text)]))

    @staticmethod
    def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of heads' first bytes: of whole texts together, or within one text at multiples of PIECE."""
        begin = int(offsets[0])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - begin <= PIECE:
                continue
            if a > begin:
                yield begin, a
            begin = a
            while b - begin > PIECE:
                yield begin, begin + PIECE
                begin += PIECE
            if begin > a:  # what is left of a long text stays alone, so that cuts are the same wherever a text stands
                yield begin, b
                begin = b
        if offsets[-1] > begin:
            yield begin, int(offsets[-1])

    @staticmethod
    def _piece(data, offsets, begin, end, length):
        k = length // 2
        window = length - k + 1
        stop = min(len(data), end + length - 1)
        if stop - begin < length:
            return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        hashes = Hashes(data[begin:stop])
        cores = hashes.every(k)
        least = cores & np.uint64(0xFFFFFFFF00000000) | np.arange(len(cores), dtype=np.uint64)
        span = 1
        while span * 2 <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        least = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        inside = offsets[(offsets > begin) & (offsets < begin + len(least))] - begin
        first = np.unique(np.r_[edges, inside]) + begin
        text = np.searchsorted(offsets, first, "right") - 1
        last = np.minimum(np.minimum(np.r_[first[1:], begin + len(least)] - 1, end - 1), offsets[text + 1] - length)
        good = last >= first
        text, first, last = text[good], first[good], last[good]
        return text, first - offsets[text], last - offsets[text], cores[least[first - begin]], hashes.of(first - begin, last - begin + length)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, without a copy, and where each begins."""
    if pa.types.is_large_string(texts.type):
        texts, kind = texts, np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Documents:
    """Ids and hashes of documents, and their places in order among themselves; equal ones have one place."""

    def __init__(self, ids: pa.Array, keys: pa.Array):
        self.ids, self.keys = ids, keys
        there = np.asarray(ids.is_valid())
        number, key = np.asarray(ids.fill_null(0)), np.asarray(keys)
        by = np.lexsort((key, number, there))
        new = np.r_[False, (key[by][1:] != key[by][:-1]) | (number[by][1:] != number[by][:-1]) | (there[by][1:] != there[by][:-1])] if len(by) else np.zeros(0, bool)
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.cumsum(new)

    def rows(self, text: np.ndarray, values: np.ndarray, extra: dict) -> pa.RecordBatch:
        """One row (doc_id, key, values) for each document that ``text`` names; ``values`` has a row of numbers for each entry."""
        by = np.argsort(text, kind="stable")
        text, values = text[by], values[by]
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
        wide = values.shape[1] if values.ndim > 1 else 1
        lists = pa.ListArray.from_arrays(pa.array((np.r_[starts, len(text)] * wide).astype(np.int32)), pa.array(values.reshape(-1).astype(np.int64)))
        at = pa.array(text[starts])
        return _row(self.ids.take(at), self.keys.take(at), lists, extra)


PACKET = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("found", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType())])
_ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("found", pa.list_(pa.int64())), ("body", pa.binary())])


def _row(ids, keys, lists, extra) -> pa.RecordBatch:
    n = len(ids)
    bucket = extra.get("bucket")
    if bucket:  # by id and text, as one text may have any number of copies
        spread = mixed(np.asarray(keys).astype(np.uint64) ^ np.asarray(ids.fill_null(0)).astype(np.uint64) * np.uint64(_STEP))
        bucket = pa.array((spread % np.uint64(bucket)).astype(np.int32))
    else:
        bucket = pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays([bucket, ids, keys, lists.cast(pa.list_(pa.int64())), pa.nulls(n, pa.binary())], schema=_ARROW)


def _narrow(values: np.ndarray) -> np.ndarray:
    """As few bytes a number as will do; hashes are as wide as they are."""
    return values if values.dtype != np.int64 else values.astype(np.min_scalar_type(int(values.max()))) if values.min() >= 0 else values.astype(np.int32)


def _packets(docs: Documents, text: np.ndarray, route: np.ndarray, buckets: int, columns: dict[str, np.ndarray], blobs: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Entries, dealt to buckets by ``route``, with their documents; a packet is an Arrow stream."""
    bucket = (route >> np.uint64(33)).astype(np.int64) % buckets
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]]) if len(by) else []
    for a, b in zip(edges, np.r_[edges[1:], len(by)] if len(by) else [], strict=True):
        own = by[a:b]
        used, local = np.unique(text[own], return_inverse=True)
        arrays = {n: pa.array(_narrow(c)) for n, c in ({"text": local} | {n: c[own] for n, c in columns.items()}).items()}
        if blobs is not None:
            arrays["bytes"] = pa.array([blobs[i] for i in own], pa.binary())
        out = pa.BufferOutputStream()
        for table in (pa.table({"doc_id": docs.ids.take(pa.array(used)), "key": docs.keys.take(pa.array(used))}), pa.table(arrays)):
            with pa.ipc.new_stream(out, table.schema) as w:
                w.write_table(table)
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([out.getvalue().to_pybytes()], pa.binary())], schema=_ARROW)


class Gathered:
    """The packets of a task's buckets: entries of all and their documents; other rows pass."""

    def __init__(self):
        self.docs, self.entries, self.n = [], [], 0

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        body = batch.column(4)
        for packet in body.drop_null():
            source = pa.BufferReader(packet.as_buffer())
            docs = pa.ipc.open_stream(source).read_all()
            entries = pa.ipc.open_stream(source).read_all()
            self.docs.append(docs)
            self.entries.append((self.n, entries))
            self.n += len(docs)
        passing = batch.filter(body.is_null())
        return passing if passing.num_rows else None

    def documents(self) -> Documents:
        t = pa.concat_tables(self.docs).combine_chunks()
        return Documents(*(c.combine_chunks() if isinstance(c := t[n], pa.ChunkedArray) else c for n in ("doc_id", "key")))

    def column(self, name: str) -> np.ndarray:
        shift, wide = name == "text", name in ("text", "first")
        return np.concatenate([np.asarray(t[name]).astype(np.int64) + n * shift if wide else np.asarray(t[name]) for n, t in self.entries])


def census(core: np.ndarray, own: np.ndarray, place: np.ndarray, number: np.ndarray, most: int, split: np.ndarray) -> np.ndarray:
    """What is to be done with each run: 0 nothing, REPEAT, SORT or SPLIT. ``split``: cores that are split anyway."""
    by = np.lexsort((number, place, own, core))
    c, o, p, n = core[by], own[by], place[by], number[by]
    new_core = np.r_[True, c[1:] != c[:-1]]
    new = new_core | np.r_[True, o[1:] != o[:-1]]
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    later = (p != p[starts][group]) | (n != n[starts][group])
    cores = np.flatnonzero(new_core)
    variants = np.add.reduceat(new.astype(np.int64), cores) if len(cores) else np.zeros(0, np.int64)
    state = np.where(np.isin(c[cores], split) | (variants > most), SPLIT, np.where(variants > 1, SORT, 0))
    out = np.empty(len(by), np.int64)
    out[by] = np.where(later, REPEAT, state[np.cumsum(new_core) - 1])
    return out


def _census_map(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def settled() -> Iterator[pa.RecordBatch]:
            docs = Documents(*(pa.concat_arrays([h[i] for h in held]) for i in (0, 1)))
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            text, number, core, own = (np.concatenate([getattr(h[2], n) + (b if n == "text" else 0) for h, b in zip(held, base, strict=False)]) for n in ("text", "number", "core", "own"))
            if not len(text):
                return
            done = census(core, own, docs.place[text], number, LOCAL, np.zeros(0, np.uint64))
            told = (done == REPEAT) | (done == SPLIT)
            yield docs.rows(text[told], number[told] * 4 + done[told], {"bucket": buckets})
            rest = ~told
            marks = np.unique(core[done == SPLIT])  # every task is told that these are split: an entry without a number
            text, core, own, number = (np.r_[x[rest], m] for x, m in ((text, np.zeros(len(marks), np.int64)), (core, marks), (own, np.zeros(len(marks), np.uint64)), (number, np.full(len(marks), -1))))
            yield from _packets(docs, text, core, buckets, {"core": core.astype(np.uint32), "own": (own >> np.uint64(16)).astype(np.uint32), "more": own.astype(np.uint16), "number": number + 1})

        for batch in batches:
            for part in in_parts(batch, 2):
                held.append((part.column(0), part.column(1), Runs(*buffer_of(part.column(2)), length)))
                size += part.column(2).nbytes
                if size >= BATCH:
                    yield from settled()
                    held, size = [], 0
        if held:
            yield from settled()
        release_memory()

    return run


def _census_reduce():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gathered()
        for batch in batches:
            if (passing := got.take(batch)) is not None:
                yield passing
        if got.n:
            docs, text, core, own, more, number = got.documents(), *map(got.column, ("text", "core", "own", "more", "number"))
            own, number, got = own.astype(np.uint64) << np.uint64(16) | more, number.astype(np.int64) - 1, None
            real = number >= 0
            split = np.unique(core[~real])
            text, core, own, number = text[real], core[real], own[real], number[real]
            done = census(core, own, docs.place[text], number, HOT, split) if len(text) else np.zeros(0, np.int64)
            told = done > 0
            # documents that came in several packets have one row for each
            yield docs.rows(text[told], number[told] * 4 + done[told], {})
        release_memory()

    return run


def _sort_map(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 2):
                data, offsets = buffer_of(part.column(2))
                runs, docs = Runs(data, offsets, length), Documents(part.column(0), part.column(1))
                state = np.zeros(len(runs.text), np.int64)
                begin = np.searchsorted(runs.text, np.arange(part.num_rows))
                found = part.column(3)
                codes = np.asarray(found.flatten())
                at = np.repeat(begin, np.diff(np.asarray(found.offsets))) + codes // 4
                state[at] = codes % 4
                same = state == REPEAT
                yield docs.rows(runs.text[same], np.stack([runs.first[same], runs.last[same] + length], 1), {"bucket": buckets})
                for kind in (SORT, SPLIT):
                    own = np.flatnonzero(state == kind)
                    text, first, last, core = runs.text[own], runs.first[own], runs.last[own], runs.core[own]
                    if kind == SPLIT and len(own):
                        n = last - first + 1
                        text = np.repeat(text, n)
                        first = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        last, core = first, _head_hashes(data, offsets[text] + first, length)
                    for a, b in _slices(last - first + length, BATCH):
                        begins, ends = (offsets[text[a:b]] + first[a:b]).tolist(), (offsets[text[a:b]] + last[a:b] + length).tolist()
                        yield from _packets(docs, text[a:b], core[a:b], buckets, {"core": core[a:b].astype(np.uint32), "first": first[a:b]}, [data[i:j].tobytes() for i, j in zip(begins, ends, strict=True)])
        release_memory()

    return run


def _head_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the heads at some places, in any order and number, by pieces."""
    out = np.empty(len(at), np.uint64)
    piece = at // PIECE
    for p in np.unique(piece):
        own = piece == p
        hashes = Hashes(data[p * PIECE : (p + 1) * PIECE + length])
        out[own] = hashes.of(at[own] - p * PIECE, at[own] - p * PIECE + length)
    return out


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of ``most`` in sum, about."""
    part = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    return zip(edges, np.r_[edges[1:], len(part)] if len(part) else [], strict=True)


def words(data: np.ndarray) -> np.ndarray:
    """The PERIOD bytes at each place as one number; zeros beyond the end."""
    x = np.r_[data, np.zeros(PERIOD, np.uint8)].astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(PERIOD):
        out = out << np.uint64(8) | x[i : i + len(data)]
    return out


def dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def cover_ranks(word: np.ndarray, units: int) -> np.ndarray:
    """For each place of the cover, the rank of the PERIOD * ``units`` bytes there among those of all cover places; 0 elsewhere."""
    n = len(word)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + PERIOD * units + 1, np.uint64)
    rank[at] = dense(word[at]) + np.uint64(1)

    def joined(step: int) -> None:
        pair = rank[at] * np.uint64(n + 2) + rank[at + PERIOD * step]
        rank[at] = dense(pair) + np.uint64(1)

    span = 1
    while span * 2 <= units:
        joined(span)
        span *= 2
    if span < units:
        joined(units - span)
    return rank


def repeated_heads(data: np.ndarray, suffixes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which of ``suffixes``, ascending in ``order``, have a head of ``length`` bytes that one of lesser order has too."""
    units = (length - PERIOD) // PERIOD
    tail = 1 + PERIOD * units  # where the bytes begin that no cover step of 1 and more is sure to reach
    word = words(data)
    rank = cover_ranks(word, units)
    ends = dense(word[suffixes])
    for at in {min(tail, length - PERIOD), length - PERIOD}:
        ends = dense(ends * np.uint64(len(suffixes) + 1) + dense(word[suffixes + at]))
    # any two suffixes have a step in common, if not for the same member of the cover
    places = []
    for c in COVER:
        step = (c - suffixes - 1) % PERIOD + 1
        places.append((ends * np.uint64(8) + step.astype(np.uint64)) * np.uint64(len(data) + 2) + rank[suffixes + step])
    places, m = np.concatenate(places), len(suffixes)
    by = np.argsort(places)
    starts = np.flatnonzero(np.r_[True, places[by][1:] != places[by][:-1]])
    own = by % m
    least = np.minimum.reduceat(order[own], starts) if m else order
    later = order[own] > np.repeat(least, np.diff(np.r_[starts, len(by)]))
    repeated = np.zeros(m, bool)
    repeated[own[later]] = True
    return repeated


def _sort_reduce(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gathered()
        for batch in batches:
            if (passing := got.take(batch)) is not None:
                yield passing
        if got.n:
            docs, text, core, first = got.documents(), *map(got.column, ("text", "core", "first"))
            heads = pa.concat_arrays([c.cast(pa.large_binary()) for _, t in got.entries for c in t["bytes"].chunks])
            got = None
            data, ends = np.frombuffer(heads.buffers()[2], np.uint8), np.frombuffer(heads.buffers()[1], np.int64)[: len(heads) + 1]
            by = np.argsort(core, kind="stable")
            size = np.diff(ends)[by]
            part = (np.cumsum(size) - size) // BLOCK
            new = np.r_[True, core[by][1:] != core[by][:-1]]
            edges = np.flatnonzero(new)
            edges = edges[np.r_[True, part[edges][1:] != part[edges][:-1]]]  # blocks of whole buckets
            for a, b in zip(edges, np.r_[edges[1:], len(by)], strict=True):
                own = by[a:b]
                own = own[np.lexsort((first[own], docs.place[text[own]]))]
                sizes = (ends[own + 1] - ends[own]).astype(np.int64)
                at = np.cumsum(sizes) - sizes
                block = data[np.repeat(ends[own] - at, sizes) + np.arange(sizes.sum())]
                n = sizes - length + 1
                run_of = np.repeat(np.arange(len(own)), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                order = (docs.place[text[own]][run_of].astype(np.uint64) << np.uint64(40)) | (first[own][run_of] + inner).astype(np.uint64)
                hit = np.flatnonzero(repeated_heads(block, at[run_of] + inner, order, length))
                if not len(hit):
                    continue
                edge = np.r_[True, (np.diff(hit) != 1) | (run_of[hit][1:] != run_of[hit][:-1])]
                begin, end = hit[edge], hit[np.r_[edge[1:], True]]
                begins = first[own][run_of[begin]]
                yield docs.rows(text[own][run_of[begin]], np.stack([begins + inner[begin], begins + inner[end] + length], 1), {})
        release_memory()

    return run


def merged_spans(found: np.ndarray) -> np.ndarray:
    """Spans (begin, end), ordered, with overlapping and touching ones as one."""
    pairs = found.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.r_[True, pairs[1:, 0] > reach[:-1]]
    return np.stack([pairs[new, 0], reach[np.r_[new[1:], True]]], 1)


SPANS = "array<struct<begin:bigint,end:bigint>>"


def _text_map(names: list[str], with_kept: bool):
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 2):
                data, offsets = buffer_of(part.column(2))
                offsets, removed, spans, shas, kept = offsets.tolist(), [], [], [], []
                for i, found in enumerate(part.column(3)):
                    own = data[offsets[i] : offsets[i + 1]]
                    cut = merged_spans(np.asarray(found.values)) if found.is_valid and len(found.values) else np.zeros((0, 2), np.int64)
                    rest = [own[a:b] for a, b in zip([0, *cut[:, 1].tolist()], [*cut[:, 0].tolist(), len(own)], strict=True)]
                    left = own if not len(cut) else np.concatenate(rest)
                    removed.append(len(own) - len(left))
                    spans.append([{"begin": a, "end": b} for a, b in cut.tolist()])
                    shas.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.tobytes() if with_kept else b"")
                columns = [part.column(0), part.column(1), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(shas, pa.string()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)
        release_memory()

    return run


def repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, spans (the removed runs of bytes), kept_sha256 of what is left, and that itself as ``kept`` if asked for.

    A byte is removed if it lies in a string of ``length`` bytes, 3 * PERIOD at least, that also starts earlier."""
    if length < 3 * PERIOD:
        raise ValueError(f"strings of {3 * PERIOD} bytes at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    long, short = texts.where(size >= length), texts.where(size < length)
    told = long.mapInArrow(_census_map(length, buckets), PACKET).repartitionById(buckets, F.col("bucket")).mapInArrow(_census_reduce(), PACKET)
    spans = _with_found(long, told, "inner").mapInArrow(_sort_map(length, buckets), PACKET).repartitionById(buckets, F.col("bucket")).mapInArrow(_sort_reduce(length), PACKET)
    schema = f"doc_id long, key long, n_bytes long, n_removed long, spans {SPANS}, kept_sha256 string" + ", kept binary" * with_kept
    names = [c.split()[0] for c in schema.split(", ")]
    out = _with_found(long, spans, "left").mapInArrow(_text_map(names, with_kept), schema)  # the texts' shuffle is that of the first join
    whole = F.coalesce("text", F.lit(""))
    same = short.select("doc_id", "key", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(SPANS).alias("spans"), F.sha2(whole, 256).alias("kept_sha256"), *[whole.cast("binary").alias("kept")] * with_kept)
    out = out.unionByName(same)
    # rows that repeat with id and text: all but one lose everything, if there is a whole string
    copies = out.groupBy(*names).count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    copies = copies.withColumns({"n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")), "spans": F.when(gone, whole).otherwise(F.col("spans")), "kept_sha256": F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256"))})
    if with_kept:
        copies = copies.withColumn("kept", F.when(gone, F.lit(b"")).otherwise(F.col("kept")))
    return copies.select(F.col("doc_id").alias(doc_id), *names[2:])


def _with_found(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Texts (doc_id, key, text) with all that was found of each, as one list."""
    found = rows.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.flatten(F.collect_list("found")).alias("found"))
    both = texts.join(found, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), how)
    return both.select("doc_id", "key", "text", "found")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for strings of LENGTH bytes."""
    rows = repeats(docs)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
