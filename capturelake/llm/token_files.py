"""Token ids in Arrow files of equal-length sequences.

Every document is encoded whole, ends with one end id, and the ids of all
documents of a part, in ascending document order, are cut into rows of
``seq_len`` ids. A part is two files in Arrow's random-access format:

``part-N.arrow``       ``input_ids fixed_size_list<uint16>[seq_len]`` (uint32 for more
                       than 65,536 ids) and ``mask fixed_size_list<bool>[seq_len]``, a
                       bitmap (false: padding of the part's last row), ``ROWS`` rows
                       in each record batch
``part-N.docs.arrow``  ``doc_id``, ``start`` (within the part), ``n_tokens``

A reader maps the file and gets any sequence without a copy
(:class:`SequenceFile`). Parts are ranges of document ids, so a part's place in
the whole is the sum of the ids of the parts before it.

Nulls and odd input: a null or empty text has the end id alone. Null ids sort
first. Repeated ids and repeated rows each keep their own entry, ordered by the
hash of the text. An empty table makes no file and no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import bounded_batches, file_system, put_file, release_memory, shared_path, together

#: Rows of one record batch, and ids of one row where nothing else is said.
ROWS, SEQ_LEN = 256, 1024
#: Distinct words that a worker remembers with their ids.
CACHE_WORDS = 300_000
#: Before a text's first word, which has no space before it; no other word begins with white space.
BARE = "\t"
#: Bytes of text that are cut into words at once, and new words that go to the library as one text.
SLICE, JOINED = 2 << 20, 50
#: Texts that the library encodes in one call.
AT_ONCE = 100
#: Marks and line feeds that are words of their own where what stands around them allows it.
MARKS = ",.;:!?"
#: White space as Python's and the library's patterns have it, for a pattern that knows ASCII only.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Texts in which a mark before a space, or a line feed, can be part of a longer token.
TIED_MARK, TIED_LINE = rf"[^\pL\pN][{MARKS}] ", rf"{SPACE}\n|\n(?:{SPACE}|\z)"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole texts to ids, by the tokenizers library, with a memory for words.

    A byte-level tokenizer of this family never makes a token over the border
    before a space that a non-space follows, wherever that border lies. So a text
    cut there has the ids of its words (with the space before each) one after the other.
    Arrow cuts a slice of texts and numbers its distinct words; new ones go to the
    library, many as one text, whose tokens that begin with a space begin a word; ids
    are gathered by number. A text in which that might not hold (a space before other
    white space or at the end, the text of a special token), or a tokenizer of
    another kind, is encoded as a whole.
    """

    def __init__(self, path: str, cache_words: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.cache_words = CACHE_WORDS if cache_words is None else cache_words
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_words = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("post_processor") is None and not spec.get("truncation") and not spec.get("padding")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        space = "\u0120"  # stands for the byte 32
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids of tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        self.known: dict[str, int] = {}  # a word to its place in the arrays below
        self.starts, self.sizes, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.held = 0  # ids of known words; what lies behind them serves one slice

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), AT_ONCE):  # the library holds a hundred bytes or more for each token
            out += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        return out

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number for each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.by_words:
            return self._joined(self._encode(texts.to_pylist()))
        apart = pc.match_substring_regex(texts, f" (?:{SPACE}|\\z)")
        for content in self.special:
            apart = pc.or_(apart, pc.match_substring(texts, content))
        odd = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        if not len(odd):
            return self._by_words(texts)
        ids, sizes = self._by_words(texts.filter(pc.invert(apart)))
        plain = np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []
        out = np.empty(len(texts), dtype=object)
        for places, found in ((np.setdiff1d(np.arange(len(texts)), odd), plain), (odd, self._encode(texts.take(pa.array(odd)).to_pylist()))):
            for i, x in zip(places.tolist(), found, strict=True):
                out[i] = x
        return self._joined(list(out))

    @staticmethod
    def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.array([len(x) for x in found], dtype=np.int64)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self._slice(*x) for x in self._slices(texts)]
        if len(found) == 1:
            return found[0][:2]
        sizes = np.zeros(len(texts), dtype=np.int64)
        for _, n, at in found:
            sizes[at : at + len(n)] += n
        return np.concatenate([ids for ids, _, _ in found]) if found else np.zeros(0, np.uint32), sizes

    @staticmethod
    def _slices(texts: pa.Array) -> Iterator[tuple[pa.Array, int]]:
        """Texts of about SLICE bytes, ``BARE`` before each, and the first one's place; a longer text comes in pieces."""
        nbytes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, n in enumerate([*nbytes.tolist(), SLICE]):
            if held + n <= SLICE:
                held += n
                continue
            if i > begin:
                yield pc.binary_join_element_wise(BARE, texts.slice(begin, i - begin), ""), begin
            begin, held = i, n
            if n > SLICE:
                text, at, mark = texts[i].as_py(), 0, BARE
                while True:
                    end = text.find(" ", at + SLICE // 4)
                    yield pa.array([mark + (text[at:end] if end >= 0 else text[at:])]), i
                    if end < 0:
                        break
                    at, mark = end + 1, ""
                begin, held = i + 1, 0

    @staticmethod
    def _apart(texts: pa.Array) -> pa.Array:
        """Texts with line feeds and marks as words, ``BARE`` before them: the library's pattern always
        cuts before a mark that follows a letter or digit, and around a line feed between non-spaces."""
        lines = pc.replace_substring(texts, "\n", f" {BARE}\n {BARE}")
        texts = pc.if_else(pc.match_substring_regex(texts, TIED_LINE), texts, lines)
        out = texts
        for mark in MARKS:
            out = pc.replace_substring(out, f"{mark} ", f" {BARE}{mark} ")
        return pc.if_else(pc.match_substring_regex(texts, TIED_MARK), texts, out)

    def _slice(self, texts: pa.Array, at: int) -> tuple[np.ndarray, np.ndarray, int]:
        lists = pc.split_pattern(self._apart(texts), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), dtype=np.int32, count=len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn([distinct[i] for i in new.tolist()])
        place = place[words.indices.to_numpy()]
        sizes = self.sizes[place]
        ends = np.cumsum(sizes, dtype=np.int32)  # a slice, or the rest of a long text's, has fewer than 2^31 ids
        at_ids = np.repeat(self.starts[place] - (ends - sizes), sizes)
        at_ids += np.arange(len(at_ids), dtype=np.int32)
        ids = self.ids[at_ids]
        border = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(border), at

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of new words: after those of known ones, which they join while there is room."""
        bare = [i for i, w in enumerate(words) if w[0] == BARE]
        plain = [i for i, w in enumerate(words) if w[0] != BARE]
        joined = [" " + " ".join([words[i] for i in plain[k : k + JOINED]]) for k in range(0, len(plain), JOINED)]
        flat, _ = self._joined(self._encode(joined))
        first = np.flatnonzero(self.opens[flat]) if len(flat) else np.zeros(0, np.int64)
        if len(first) != len(plain):
            raise ValueError("a word's first token has no space: not a tokenizer of this kind")
        starts, sizes = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        starts[plain], sizes[plain] = first, np.diff(np.append(first, len(flat)))
        own, n = self._joined(self._encode([words[i][1:] for i in bare]))
        starts[bare], sizes[bare] = len(flat) + np.cumsum(n) - n, n
        flat = np.concatenate([flat, own])
        k = len(self.known)
        keep = k + len(words) <= self.cache_words
        self.starts = np.concatenate([self.starts[:k], starts + np.int32(self.held)])
        self.sizes = np.concatenate([self.sizes[:k], sizes])
        self.ids = np.concatenate([self.ids[: self.held], flat])
        if keep:
            self.known.update(zip(words, range(k, k + len(words)), strict=True))
            self.held += len(flat)
        return np.arange(k, k + len(words), dtype=np.int32)


@functools.cache
def encoder(path: str, cache_words: int) -> Encoder:
    """One for each worker process, so that its memory serves all of its tasks."""
    return Encoder(path, cache_words)


class _PartWriter:
    """Rows of ``seq_len`` ids into an open Arrow file, a record batch at a time."""

    def __init__(self, sink, seq_len: int, kind: pa.DataType):
        self.kind = kind
        self.n, self.rest, self.total = seq_len, np.zeros(0, np.uint32), 0
        self.schema = pa.schema([("input_ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        data, block = np.concatenate([self.rest, ids]), self.n * ROWS
        whole = len(data) // block * block
        for i in range(0, whole, block):
            self._rows(data[i : i + block], block)
        self.rest = data[whole:].copy()

    def _rows(self, ids: np.ndarray, real: int) -> None:
        values = pa.array(ids.astype(self.kind.to_pandas_dtype())), pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(v, self.n) for v in values]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if real := len(self.rest):
            size = -(-real // self.n) * self.n
            self._rows(np.concatenate([self.rest, np.zeros(size - real, dtype=np.uint32)]), real)
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one part; local files are mapped, not read."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))
        self.seq_len = self.reader.schema.field("input_ids").type.list_size
        self._at, self._batch = -1, None
        self._ids_at, self._ids = -1, None

    def _flat(self, batch: int, column: int) -> pa.Array:
        if batch != self._at:
            self._at, self._batch = batch, self.reader.get_batch(batch)
        return self._batch.column(column).flatten()

    def __getitem__(self, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, as views of the file."""
        b, r = divmod(row, ROWS)
        ids, mask = (self._flat(b, c).slice(r * self.seq_len, self.seq_len) for c in (0, 1))
        return ids.to_numpy(), mask

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * ROWS + self.reader.get_batch(n - 1).num_rows if n else 0

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``start + n`` of the part's stream, as views."""
        block = self.seq_len * ROWS
        while n > 0:
            b, at = divmod(start, block)
            if b != self._ids_at:
                self._ids_at, self._ids = b, self._flat(b, 0).to_numpy()
            got = self._ids[at : at + n]
            if not len(got):
                raise EOFError(f"the part ends before id {start}")
            yield got
            start, n = start + len(got), n - len(got)


PARTS = "part int, docs long, ids long"


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str | None = None, end_id: int = 2, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> list[tuple[int, int, int]]:
    """Encode ``docs`` into files under ``out_dir`` (a folder that all machines see).

    Returns (part, documents, ids) of each part in order: as many entries as
    partitions, whatever the number of documents. ``cache_words``: how many words a worker
    remembers, some 200 bytes each. The shuffle moves each text once, into
    ranges of ids; a task holds one record batch and one Arrow batch of texts.
    """
    path = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encode = encoder(path, cache_words)
        ids, lengths, sums = [], [], [0]

        def body(sink) -> None:
            wide = max(encode.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
            writer = _PartWriter(sink, seq_len, pa.uint32() if wide else pa.uint16())
            for group in together(itertools.chain([first], batches), SLICE):
                ids.extend(b.column(0) for b in group)
                flat, sizes = encode(pa.concat_arrays([b.column(1) for b in group]))
                writer.add(np.insert(flat, np.cumsum(sizes), end_id))
                lengths.append(sizes + 1)
            writer.close()
            sums[0] = writer.total

        def index(sink) -> None:
            n = np.concatenate(lengths)
            t = pa.table({"doc_id": pa.chunked_array(ids), "start": np.cumsum(n) - n, "n_tokens": n})
            with pa.ipc.new_file(sink, t.schema) as f:
                f.write_table(t, max_chunksize=100_000)

        put_file(f"{out_dir}/part-{part:06d}.arrow", body, attempt)
        put_file(f"{out_dir}/part-{part:06d}.docs.arrow", index, attempt)
        release_memory()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": [sum(map(len, lengths))], "ids": sums})

    rows = ordered.mapInArrow(write, PARTS).collect()
    return sorted((r.part, r.docs, r.ids) for r in rows)


def read_token_files(spark: SparkSession, out_dir: str, parts: list[tuple[int, int, int]], id_type: T.DataType | None = None) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, part, n_sequences."""
    schema = T.StructType([T.StructField("doc_id", id_type or T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")), T.StructField("part", T.IntegerType())])
    if not parts:
        return spark.createDataFrame([], schema)
    where, base = [], 0
    for part, _, ids in parts:
        where.append((part, base))
        base += ids
    table = spark.sparkContext.broadcast(where)  # two numbers for each part

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # all is written; a worker that waits for other work needn't keep words
        release_memory()
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part, begin = table.value[k]
                name = f"{out_dir}/part-{part:06d}"
                seqs = SequenceFile(f"{name}.arrow")
                fs, path = file_system(f"{name}.docs.arrow")
                index = pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for ids in seqs.ids(start, n):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        sums.append(crc)
                    starts = pa.array(docs.column("start").to_numpy() + begin)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(sums, pa.int64()), pa.array([part] * len(sums), pa.int32())], names=schema.names)

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, schema)


def token_files(docs: DataFrame, out_dir: str | None = None, **options) -> DataFrame:
    """Write all of ``docs`` and return what the files hold, read back."""
    spark = docs.sparkSession
    out_dir = out_dir or shared_path(spark, "tokens")
    parts = write_token_files(docs, out_dir, **options)
    return read_token_files(spark, out_dir, parts, docs.schema[options.get("id_col", "doc_id")].dataType)
