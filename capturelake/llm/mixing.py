"""Mixing sources to target weights, by balanced sampling with the cube method.

A source's target is its weight's share of all words, at most ``CAP`` times its
own words; what is cut off goes to the others by weight until none is above. So
a document is taken ``floor(r)`` times, r = target / words of its source, and once
more with probability ``r - floor(r)``. Which documents those are is a sample
balanced on words and on documents: starting from the probabilities, the flight
phase moves those of three documents at a time within the null space of both
constraints until one of them is 0 or 1, which keeps both totals exactly.

A source is dealt out in chunks of some ``CHUNK`` documents by a hash. Each chunk
ends with at most two open documents; these meet in the next level's chunks, a
two-thousandth in number, until a source has one chunk. Its last two open documents and
``LANDING`` documents kept out of its flight land together: of all their
roundings, the one with the nearest totals is taken.

The sample is a function of rows and seed: reruns and tasks that are run again agree.

Nulls and odd input: a null source is a source, the last in order. A null or
empty text has no words and is taken 0 times. A null id is an id. Rows that repeat with the
same id, source and text are taken equally often. An empty table gives no rows. A text of any length is counted in the JVM
and goes no further; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import free_name, word_count, written
from capturelake.llm.joins import join_small, running_sums

#: Times a source or a document may be taken; weights of sources in order, repeating; documents of a chunk; documents that land.
CAP, WEIGHTS, CHUNK, LANDING = 3, (5, 2, 1), 4096, 14
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, source_size) one row each: also rank, weight and target.

    The cut-off sources are those with the least ``CAP * size / weight``; the level
    for all others follows from running sums in that order, so neither step
    gathers the sources.
    """
    null_last = F.col("source").isNull()
    ranked = running_sums(sizes, [null_last.asc(), F.col("source").asc()], {"rank": F.lit(1)})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = ranked.withColumn("weight", w)
    level = CAP * F.col("source_size") / F.col("weight")
    filled = running_sums(weighed.withColumn("level", level), [F.col("level").asc(), F.col("rank").asc()], {"cut": CAP * F.col("source_size"), "spent": F.col("weight")})
    filled = written(filled, "sources")
    total = filled.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    if not total.t:
        return filled.withColumn("target", F.lit(0.0))
    share = (F.lit(float(total.t)) - F.col("cut")) / (F.lit(float(total.w)) - F.col("spent"))
    level = filled.where(share <= F.col("level")).agg(F.min_by(share, F.struct("level", "rank"))).first()[0]
    target = F.least(CAP * F.col("source_size").cast("double"), F.col("weight") * F.lit(float(level)))
    return filled.withColumn("target", target)


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, rows: np.ndarray | None = None) -> np.ndarray:
    """Probabilities moved to 0 or 1, all but two at most; the sums of p * rows (1 each if not given) and of p * size stay."""
    p = p.copy()
    r = [1] * len(p) if rows is None else rows.tolist()
    todo = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    x, q = sizes.tolist(), p.tolist()
    draws = iter(rng.random(len(todo) + 8).tolist())
    todo.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) == 3:
            a, b, c = active
            u = (r[b] * x[c] - r[c] * x[b], r[c] * x[a] - r[a] * x[c], r[a] * x[b] - r[b] * x[a])
            if not any(u):
                u = (r[b], -r[a], 0)
        elif len(active) == 2 and r[active[0]] * x[active[1]] == r[active[1]] * x[active[0]]:
            u = (r[active[1]], -r[active[0]])
        else:
            break
        up = min(((1 - q[i]) if v > 0 else q[i]) / abs(v) for i, v in zip(active, u, strict=True) if v)
        down = min((q[i] if v > 0 else (1 - q[i])) / abs(v) for i, v in zip(active, u, strict=True) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            q[i] += step * v
            if q[i] < _EPS:
                q[i] = 0.0
            elif q[i] > 1 - _EPS:
                q[i] = 1.0
        active = [i for i in active if 0 < q[i] < 1]
    return np.array(q)


def land(p: np.ndarray, sizes: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The open probabilities, a few, rounded so that the sizes' total and then the rows' is nearest."""
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = picks - p[open_]
    x = sizes[open_].astype(np.float64)
    count = np.ones(len(x)) if rows is None else rows[open_].astype(np.float64)
    best = picks[np.argmin(np.abs(off @ x) + 0.01 * (x.mean() if len(x) else 0) * np.abs(off @ count))]
    out = p.copy()
    out[open_] = best
    return np.round(out)


def settle(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, last: bool, rows: np.ndarray | None = None) -> np.ndarray:
    """One chunk, sizes in descending order. The last chunk of a source keeps up to
    ``LANDING`` documents out of the flight, most of them large, since large ones stay open
    longest; so what lands is a small problem with a near solution."""
    if not last:
        return flight(p, sizes, rng, rows)
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    kept = open_ if len(open_) <= LANDING + 2 else open_[np.unique(np.geomspace(1, len(open_), LANDING).astype(int)) - 1]
    flying = np.setdiff1d(open_, kept, assume_unique=True)
    out = p.copy()
    out[flying] = flight(p[flying], sizes[flying], rng, None if rows is None else rows[flying])
    return land(out, sizes, rows)


UNIT = "unit long, twin long, doc_id {id}, source string, size long, rows long, words long, base long, p double, source_size long, target double"


def cube_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per distinct document: unit and twin (its hash, 128 bits), doc_id, source, size, rows (how often it
    repeats in ``docs``), copies (how often each is taken), source_size, target."""
    kind = docs.schema[id_col].dataType.simpleString()
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *unit_of(docs, ("unit", "twin"), id_col, text_col, source_col))
    units = written(light.groupBy("unit", "twin").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("rows")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    aimed = written(targets(sources, weights), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = aimed.withColumn("base", F.floor(rate).cast("long")).withColumn("p", rate - F.floor(rate)).withColumn("chunks", F.ceil(F.col("units") / CHUNK).cast("long"))
    rest = join_small(units, aimed.select("source", "base", "p", "chunks", "source_size", "target"), "source").withColumn("words", F.col("size") * F.col("rows"))
    schema, done, level = UNIT.format(id=kind), [], 0
    most = aimed.agg(F.max("chunks")).first()[0] or 0
    while most:
        last = "chunks = 1"

        now = level

        def move(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["words", "unit"], ascending=[False, True], kind="stable", ignore_index=True)
            p, x = pdf["p"].to_numpy(), pdf["words"].to_numpy()
            p = settle(p, x, np.random.default_rng([seed, now, int(pdf["unit"].iloc[0]) & 0xFFFFFFFF]), pdf["chunks"].iloc[0] == 1, pdf["rows"].to_numpy())
            return pdf.assign(p=p).drop(columns="chunk")

        chunk = F.pmod(F.xxhash64("unit", F.lit(seed + level)), F.col("chunks"))
        moved = rest.withColumn("chunk", chunk).groupBy("source", "chunk").applyInPandas(move, schema + ", chunks long")
        moved = written(moved, "flight")
        done.append(moved.where((F.col("p") == 0) | (F.col("p") == 1) | F.expr(last)))
        rest = moved.where("p > 0 and p < 1 and chunks > 1").withColumn("chunks", F.ceil(2 * F.col("chunks") / CHUNK).cast("long"))
        most, level = (0 if most == 1 else -(-2 * most // CHUNK)), level + 1
    if not done:
        out = rest.limit(0).select("unit", "twin", "doc_id", "source", "size", "rows", "base", "p", "source_size", "target")
    else:
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
    copies = F.when(F.col("size") > 0, F.col("base") + F.round("p").cast("long")).otherwise(0)
    return out.select("unit", "twin", "doc_id", "source", "size", "rows", copies.alias("copies"), "source_size", "target")


def unit_of(docs: DataFrame, names: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """Two hashes that together tell documents apart; nulls are values of their own."""
    cols = [c for x in (docs[id_col], docs[source_col], docs[text_col]) for c in (x, x.isNull())]
    return [F.xxhash64(*cols).alias(names[0]), F.xxhash64(F.lit(names[1]), *cols).alias(names[1])]


def mixture(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    units = cube_mix(docs, **options).where("rows > 0")
    each = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mixture takes it."""
    unit, twin, copies = (free_name(docs, n) for n in ("unit", "twin", "copies"))
    names = {k: options.get(k, k.removesuffix("_col") if k != "id_col" else "doc_id") for k in ("id_col", "text_col", "source_col")}
    taken = cube_mix(docs, **options).where("copies > 0").select(F.col("unit").alias(unit), F.col("twin").alias(twin), F.col("copies").alias(copies))
    hashes = [h.alias(n) for h, n in zip(unit_of(docs, ("unit", "twin"), names["id_col"], names["text_col"], names["source_col"]), (unit, twin), strict=True)]
    own = docs.select("*", *hashes)
    # a merge at any size: what is taken grows with the documents, and so must not be broadcast
    out = own.join(taken.hint("merge"), [unit, twin]).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return out.select(*docs.columns)
