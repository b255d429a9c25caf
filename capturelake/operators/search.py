"""Full-text search with weighted bm25, boosts and filters.

The text of a capture is six token arrays. Every unit (a word or a phrase) must occur
in some of them. Texts are cut into tokens once a search, or once at ingest with an index (:mod:`text_index`); what
captures have of the query is written, and from it come each unit's row count, over missing captures too, and scores. Counts and the mean length are scalars, so they go
into the plan as literals. The score of a row is a closed expression in the JVM; only a page's snippets are cut in Python. A page of a
search for words reads the index's best blocks alone.
"""

from __future__ import annotations

import math
import re
import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.text import fold_term, tokens
from capturelake.operators.predicates import apply_filter, ev, live
from capturelake.plans.lineage import cut
from capturelake.plans.query_parser import ParsedQuery, parse
from capturelake.schemas import BASE_COLS, Library

# Weights of the text columns, bm25's parameters, boosts, and the snippet's length.
WEIGHTS = {"filename": 8.0, "ocr": 1.0, "tags": 12.0, "note": 4.0, "app": 6.0, "site": 6.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
PHRASE_BOOST, WEEK_BOOST, MONTH_BOOST = 100, 5, 3
SNIPPET_TOKENS, MOST_IDS = 16, 100_000
#: A token in a text: letters, digits and the marks on them.
_TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")


def documents(lib: Library) -> DataFrame:
    """Captures with their text as token arrays, ``t_<column>``, and the raw text ``ocr``."""
    tags = lib.screenshot_tags.join(lib.tags, lib.screenshot_tags.tag_id == lib.tags.id).groupBy("screenshot_id")
    tags = tags.agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("tag_names"))
    ocr = lib.ocr_text.select(F.col("screenshot_id").alias("ocr_id"), F.col("text").alias("ocr"))
    df = lib.captures.join(ocr, F.col("id") == F.col("ocr_id"), "left").drop("ocr_id").join(tags, F.col("id") == F.col("screenshot_id"), "left").drop("screenshot_id")
    text = {"filename": "filename", "ocr": "ocr", "tags": "tag_names", "note": "note", "app": "app_name", "site": "website_domain"}
    return df.withColumns({f"t_{k}": tokens(F.col(c)) for k, c in text.items()}).drop("tag_names")


def occurrences(words: Column, unit: list[str]) -> Column:
    """How often a unit occurs in a token array."""
    n = len(unit)
    if n == 1:
        return F.size(words) - F.size(F.array_remove(words, unit[0]))
    if not any(unit[:k] == unit[-k:] for k in range(1, n)):  # occurrences can't overlap: count them in one string
        joined, mark = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), f" {'  '.join(unit)} "
        return ((F.length(joined) - F.length(F.replace(joined, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    want = F.array(*map(F.lit, unit))
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    hits = F.size(F.filter(places, lambda i: F.slice(words, i, F.lit(n)) == want))
    return F.when(F.size(words) >= n, hits).otherwise(0)


def weighted(unit: list[str]) -> Column:
    return sum((w * occurrences(F.col(f"t_{c}"), unit) for c, w in WEIGHTS.items()), F.lit(0.0))


def rarity(rows: int, having: int) -> float:
    """A unit's idf; of one that more than half of all captures have, a least value."""
    idf = math.log((rows - having + 0.5) / (having + 0.5))
    return idf if idf > 0 else LEAST_IDF


def recency(ts: Column, now: int) -> Column:
    """Both boosts count for the last week."""
    boost = F.lit(0)
    for days, points in ((7, WEEK_BOOST), (30, MONTH_BOOST)):
        boost = boost + F.when(ts >= now - days * 86_400, points).otherwise(0)
    return boost


def scored(lib: Library, query: ParsedQuery, now: int, found: DataFrame, idf: list[float], mean: float) -> DataFrame:
    """The captures of ``found`` (id, d, f_0, ...) that match, with ``score`` and ``_sort``; ``idf`` of each unit, ``mean`` length of all captures."""
    docs = lib.captures
    for f in query.filters:
        docs = apply_filter(docs, f, lib)
    docs = docs.join(found, "id")
    norm = K1 * (1 - B + B * F.col("d") / F.lit(float(mean)))
    score, hit = F.lit(0.0), F.lit(True)
    for i, rare in enumerate(idf):
        n = F.col(f"f_{i}")
        score, hit = score + rare * n * (K1 + 1) / (n + norm), hit & (n > 0)
    boost = recency(F.col("created_ts"), now)
    if query.boost_phrase:
        ocr = lib.ocr_text.select(F.col("screenshot_id").alias("_ocr"), F.contains(F.lower("text"), F.lit(query.boost_phrase.lower())).alias("_phrase"))
        docs = docs.join(ocr, F.col("id") == F.col("_ocr"), "left").drop("_ocr")
        boost = boost + F.when(F.col("_phrase"), PHRASE_BOOST).otherwise(0)
    docs = docs.where(live() & hit).withColumn("score", score).withColumn("_sort", score + boost)
    return docs.drop("_phrase", "d", *(f"f_{i}" for i in range(len(idf))))


def ranked(lib: Library, query: ParsedQuery, now: int, index=None) -> DataFrame:
    """All matching rows with score (bm25 alone) and ``_sort`` (with boosts); 0 and event time without words.

    ``index``: a :class:`text_index.TextIndex` of the library. With it only the query's tokens are read, and for phrases the texts that
    have all of their words; without it all texts are cut into tokens."""
    units = query.units
    if not units:
        docs = lib.captures.withColumns({"score": F.lit(0.0), "_sort": F.lit(0.0)}).where(live())
        for f in query.filters:
            docs = apply_filter(docs, f, lib)
        return docs
    names = [f"f_{i}" for i in range(len(units))]
    some = F.lit(False)
    for n in names:
        some = some | (F.col(n) > 0)
    # what each capture has of the units, written once for statistics and scores: only captures that have some of them
    if index is None:
        length = sum((F.size(f"t_{c}") for c in WEIGHTS), F.lit(0))
        every = documents(lib).select("id", length.alias("d"), *(weighted(u).alias(n) for n, u in zip(names, units, strict=True)))
        all_rows = every.agg(F.count("*").alias("n"), F.avg("d").alias("avg")).first()
        rows, mean = all_rows.n, float(all_rows.avg or 1)
    else:
        from capturelake.operators.text_index import frequencies

        every, rows, mean = frequencies(index, lib, units), index.rows, index.mean
    found = cut(every.where(some), "found")
    stats = found.agg(*(F.count_if(F.col(n) > 0).alias(n) for n in names)).first()
    return scored(lib, query, now, found, [rarity(rows, stats[n]) for n in names], mean)


def order_of(query: ParsedQuery) -> list[Column]:
    if query.units:
        return [F.desc("_sort"), F.desc("created_ts"), F.desc("id")]
    return [ev().desc(), F.desc("id")]


def located(text: str) -> list[tuple[str, int, int]]:
    """The tokens of a text with where they begin and end in it."""
    return [(word, m.start(), m.end()) for m in _TOKEN.finditer(text) if (word := fold_term(m[0]))]


def occurrences_in(words: list[str], units: list[list[str]]) -> list[tuple[int, int, int]]:
    """(first token, tokens, unit) of each place where a unit's tokens follow one another, in order."""
    return sorted((i, len(u), k) for k, u in enumerate(units) for i in range(len(words) - len(u) + 1) if words[i : i + len(u)] == u)


def window(text: str, tokens: list[tuple[str, int, int]], hits: list[tuple[int, int, int]], most: int) -> int:
    """The first token of the best part: one that has many units, then many hits; rather from the text's or a sentence's beginning.

    Fixed values: a unit's first hit counts 1000, others 1, a sentence's beginning 100, the text's 120."""
    starts = [i for i, (_, begin, _) in enumerate(tokens) if i == 0 or re.search(r"[.:][ \t\n\r]+$", text[:begin][-64:] if begin > 64 else text[:begin])]

    def value(first: int) -> tuple[int, int]:
        inside = [h for h in hits if first <= h[0] < first + most]
        seen = {h[2] for h in inside}
        low, high = (inside[0][0], max(0, inside[-1][0] + inside[-1][1])) if inside else (first, first)
        middle = low - int((most - (high - low)) / 2)
        return 1000 * len(seen) + len(inside) - len(seen), max(0, min(middle, len(tokens) - most))

    best, at = 0, 0
    for first, _, _ in hits:
        score, middle = value(first)
        if score > best:
            best, at = score, middle
        if len(tokens) > most:
            before = [s for s in starts if s <= first]
            if before and before[-1] < first:
                score = value(before[-1])[0] + (120 if before[-1] == 0 else 100)
                if score > best:
                    best, at = score, before[-1]
    return at


def snippet(text: str | None, units: list[list[str]], most: int = SNIPPET_TOKENS) -> str:
    """``most`` tokens of a text around its best hits, with what lies between them; hits in brackets, overlapping ones as one, and dots where text was left out."""
    text = text or ""
    tokens = located(text)
    words = [w for w, _, _ in tokens]
    hits = occurrences_in(words, units)
    first = window(text, tokens, hits, most)
    last = min(len(tokens), first + most) - 1
    marks: list[list[int]] = []  # runs of tokens that hits cover
    for i, n, _ in hits:
        if marks and i <= marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], i + n - 1)
        else:
            marks.append([i, i + n - 1])
    if not tokens:
        return text
    at, out = (tokens[first][1] if first else 0), ["…" if first else ""]
    for a, b in marks:
        b = min(b, last)
        if first <= a <= b:  # a hit that begins before the part isn't marked
            out += [text[at : tokens[a][1]], "[", text[tokens[a][1] : tokens[b][2]], "]"]
            at = tokens[b][2]
    whole = last == len(tokens) - 1
    return "".join(out) + (text[at:] if whole else text[at : tokens[last][2]] + "…")


def search(lib: Library, text: str, now: int | None = None, limit: int = 60, offset: int = 0, index=None) -> DataFrame:
    """One page of results: grid columns, score and snippet. Snippets are cut for the page's rows only.

    ``index``: see :func:`ranked`; a query of single words then reads only the blocks that can have results of the page."""
    now = int(time.time()) if now is None else now
    query, limit, offset = parse(text, now), max(0, limit), max(0, offset)
    units = query.units
    if index is not None and units and all(len(u) == 1 for u in units) and limit:
        from capturelake.operators.text_index import best

        rows = best(index, lib, query, now, offset + limit).rows
    else:
        rows = ranked(lib, query, now, index)
    page = rows.orderBy(*order_of(query)).offset(offset).limit(limit)
    if not units:
        return page.select(*BASE_COLS, F.lit(None).cast("string").alias("snippet"), "score")
    ocr = lib.ocr_text.select(F.col("screenshot_id").alias("_ocr"), F.col("text").alias("ocr"))
    found = cut(page, "page")  # few rows, that their texts join
    page = found.join(ocr, F.col("id") == F.col("_ocr"), "left").orderBy(*order_of(query))
    snippets = F.pandas_udf(lambda s: pd.Series([snippet(t, units) for t in s]), "string")
    return page.select(*BASE_COLS, snippets("ocr").alias("snippet"), "score")


def search_total(lib: Library, text: str, now: int | None = None, index=None) -> DataFrame:
    """One row: how many captures match."""
    now = int(time.time()) if now is None else now
    return ranked(lib, parse(text, now), now, index).agg(F.count("*").alias("total"))


def search_ids(lib: Library, text: str, now: int | None = None, limit: int | None = MOST_IDS, index=None) -> DataFrame:
    """Ids in rank order: 1 to 100,000 of them, which is for interactive callers, or all with ``limit`` None."""
    now = int(time.time()) if now is None else now
    query = parse(text, now)
    found = ranked(lib, query, now, index).orderBy(*order_of(query))
    if limit is not None:
        found = found.limit(min(MOST_IDS, max(1, limit)))
    return found.select("id")
