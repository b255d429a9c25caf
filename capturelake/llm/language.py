"""Language identification by rank order of n-grams.

A profile is the list of the ``TOP`` most frequent n-grams, n = 1 to 3, of words in
lower case with one boundary mark at each end; ties go by code. A document is
compared with each language by the out-of-place distance: the sum over its own
profile of how far each n-gram's rank lies from its rank in the language, and
``TOP`` for an n-gram the language doesn't have. The nearest language wins, the first
by code point on ties; the score is how much nearer it is than the next, from 0 to 1.

The profiles of languages are learnt from labelled rows of the training folds. They
are the only thing fitted on a sample: about ``max_docs`` documents of each language, chosen by a
hash of the id. Predictions read whole texts and nothing but texts.

Nulls and odd input: a null text, or one without letters, is ``und`` with score 0; so is
every text if nothing could be learnt. Rows with a null language or a null id are not
learnt from; a null id is not held out. Equal texts get equal predictions, repeated
rows stay. Empty tables give no rows. A text of any length is counted whole. Own columns named ``lang_pred`` or
``score`` stay; the new ones then have underscores before their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import add_from_text, bounded_batches, free_name, in_parts, release_memory, written
from capturelake.llm.joins import join_small

#: N-grams of a profile; labelled documents of each language that profiles are learnt from, about.
TOP, MAX_DOCS = 300, 2000
UNKNOWN = "und"
_EDGE, _BITS = 32, 21


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text, each as often as it occurs; a code holds its code points, 21 bits each."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of each run of other characters the first, as a boundary
    seq = np.where(letter, points, _EDGE)[kept].astype(np.int64)
    seq = np.concatenate([[_EDGE] if seq[0] != _EDGE else [], seq, [_EDGE] if seq[-1] != _EDGE else []]).astype(np.int64)
    one = seq[seq != _EDGE]
    two = seq[:-1] << _BITS | seq[1:]
    three = (two[:-1] << _BITS | seq[2:])[seq[1:-1] != _EDGE]
    return np.concatenate([one, two, three])


def profile(text: str | None) -> np.ndarray:
    """Codes of the TOP most frequent n-grams, in order of rank."""
    codes = ngrams(text)
    if not len(codes):
        return codes
    codes.sort()
    begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(begin, len(codes)))
    order = np.argsort(-counts, kind="stable")[:TOP]
    return codes[begin[order]]


class RankOrder:
    """Language profiles, and the distance of texts from them. What it holds grows with the number of languages, ``TOP`` entries each."""

    def __init__(self, ranks: dict[str, list[int]]):
        self.langs = sorted(ranks)
        codes = np.concatenate([np.array(ranks[x], dtype=np.int64) for x in self.langs] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.lang = np.repeat(np.arange(len(self.langs)), [len(ranks[x]) for x in self.langs])[order]
        self.rank = np.concatenate([np.arange(len(ranks[x])) for x in self.langs] or [np.zeros(0, dtype=np.int64)])[order]

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = profile(text)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        begin = np.searchsorted(self.codes, own)
        n = np.searchsorted(self.codes, own, side="right") - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        near = TOP - np.minimum(np.abs(self.rank[at] - np.repeat(np.arange(len(own)), n)), TOP)  # how much less than TOP a known n-gram counts
        d = TOP * len(own) - np.bincount(self.lang[at], weights=near, minlength=len(self.langs)).astype(np.int64)
        best = int(np.argmin(d))
        rest = np.delete(d, best)
        second = int(rest.min()) if len(rest) else TOP * len(own)
        return self.langs[best], float(second - d[best]) / second if second else 0.0


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5: 0 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> RankOrder:
    """Profiles of all languages of the training folds."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where((fold(F.col("i")) != 0) & F.col("lang").isNotNull())
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    place = F.pmod(F.xxhash64("i"), F.lit(1 << 20))
    sample = join_small(rows, counts, "lang").where(place < F.lit(float(max_docs << 20)) / F.col("n")).select("lang", "t")

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})
            held.clear()

        for batch in (p for b in batches for p in in_parts(b, 1)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(codes := ngrams(text))
                size += len(codes)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()
        release_memory()

    sums = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranks: dict[str, list[int]] = {}
    for r in sums.withColumn("rank", rank).where(F.col("rank") <= TOP).orderBy("lang", "rank").collect():  # TOP rows for each language
        ranks.setdefault(r.lang, []).append(r.code)
    return RankOrder(ranks)


def identify(docs: DataFrame, model: RankOrder, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the predicted language and its score."""
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # TOP codes for each language

    def make():
        def run(texts):
            found = [held.value(t) for t in texts]
            return [[x for x, _ in found], [s for _, s in found]]

        return run

    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return add_from_text(docs, text_col, fields, make), *names


def languages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = learn(docs, id_col, text_col, lang_col, max_docs)
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, lang, score = identify(light, model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def with_language(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in some language: ``und`` is rejected."""
    model = learn(docs, **options)
    found, lang, score = identify(docs, model, options.get("text_col", "text"))
    return found.where(F.col(lang) != UNKNOWN).drop(lang, score)
