"""Timelines, bursts, exact and near duplicates."""

from __future__ import annotations

import re
from datetime import date
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions.hashing import phash_from_hex
from capturelake.operators.predicates import available, ev, live
from capturelake.plans.lineage import cut
from capturelake.schemas import BASE_COLS, Library

#: Bounds and defaults of a burst's gap in seconds and of a Hamming distance.
GAP_LEAST, GAP_MOST, GAP = 60, 86_400, 1800
DISTANCE_MOST, DISTANCE = 16, 8
PREVIEWS, TOP_TAGS = 4, 3
#: Values that a hash asks for in one block, at most.
MOST_MASKS = 4096
#: Costs (ns) of asking for a value, of meeting a hash in a join, and of comparing one in a tile; asking is shuffled, so it weighs more than its time.
COST_ASKED, COST_MET, COST_PLAIN = 5000, 20, 4
#: Rows of a partition of asked values, hashes of a tile, a tile's rows that are compared at once, and tasks that compare tiles, at most.
PART_ROWS, TILE, ROWS, MOST_PARTS = 1_000_000, 16_384, 32, 1024
#: Comparisons of a task.
PER_TASK = 100_000_000
#: Hashes of the first range that leaders are settled for, and how much larger the next ranges are.
FIRST_RANGE, GROWTH = 16_384, 4


# --- timelines -------------------------------------------------------------------------------------------------------


def _local(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(ts), tz)


def timeline_months(captures: DataFrame, tz: str = "UTC") -> DataFrame:
    """Counts by local month, newest first."""
    day = _local(ev(), tz)
    df = captures.where(live() & ev().isNotNull()).groupBy(F.year(day).cast("long").alias("year"), F.month(day).cast("long").alias("month")).agg(F.count("*").alias("count"))
    return df.select("year", "month", F.format_string("%04d-%02d", "year", "month").alias("key"), "count").orderBy(F.desc("year"), F.desc("month"))


def timeline_days(captures: DataFrame, year: int, month: int, tz: str = "UTC") -> DataFrame:
    """Counts by local day of one month, newest first."""
    if not 1 <= month <= 12 or not 1970 <= year <= 9999:
        raise ValueError(f"no such month: {year}-{month}")
    day = F.date_format(_local(ev(), tz), "yyyy-MM-dd")
    df = captures.where(live() & ev().isNotNull()).withColumn("date", day).where(F.col("date").startswith(f"{year:04d}-{month:02d}-"))
    return df.groupBy("date").agg(F.count("*").alias("count")).orderBy(F.desc("date"))


def timeline_items(captures: DataFrame, day: str, limit: int | None = None, offset: int = 0, tz: str = "UTC") -> DataFrame:
    """Grid rows of one local day, newest first; all without a limit."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError(f"not a day: {day!r}")
    df = captures.where(live() & (F.date_format(_local(ev(), tz), "yyyy-MM-dd") == day)).orderBy(ev().desc(), F.desc("id")).select(*BASE_COLS)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


# --- bursts ----------------------------------------------------------------------------------------------------------


def clamp_gap(gap: int) -> int:
    return min(GAP_MOST, max(GAP_LEAST, gap))


def sessionize(df: DataFrame, ts: str, gap: int, tie: str) -> DataFrame:
    """Add session_start: the first ``ts`` of the run of rows whose steps are ``gap`` at most.

    One run over all rows, but no task that holds them all: rows are dealt out by range of
    time, each range is cut on its own, and the ranges' ends, one row for each, settle what goes on
    across them.
    """
    part = "_part"
    dealt = cut(df.repartitionByRange(ts, tie).withColumn(part, F.spark_partition_id()), "ranges")
    w = Window.partitionBy(part).orderBy(ts, tie)
    prev = F.lag(ts).over(w)
    first_of = F.when(prev.isNull() | (F.col(ts) - prev > gap), F.col(ts))
    marked = dealt.withColumn("_own", F.last(first_of, True).over(w))
    ends = sorted(tuple(r) for r in marked.groupBy(part).agg(F.min(ts), F.max(ts), F.max("_own"), F.min("_own")).collect())
    rows, last, start = [], None, None
    for p, least, most, own_last, own_first in ends:
        joins = last is not None and least - last <= gap
        rows.append((p, own_first, start if joins else own_first))
        start = (start if joins else own_first) if own_last == own_first else own_last
        last = most
    carried = df.sparkSession.createDataFrame(rows, f"{part}_c int, _first long, _carried long")
    out = marked.join(F.broadcast(carried), marked[part] == carried[f"{part}_c"])  # one row for each range
    return out.select(*df.columns, F.when(F.col("_own") == F.col("_first"), F.col("_carried")).otherwise(F.col("_own")).alias("session_start"))


def burst_rows(captures: DataFrame, gap: int = GAP) -> DataFrame:
    """Live captures with a time, with the start of their run."""
    timed = captures.where(live() & ev().isNotNull()).withColumn("ev", ev())
    return sessionize(timed, "ev", clamp_gap(gap), "id")


def detect_bursts(captures: DataFrame, gap: int = GAP) -> DataFrame:
    """Runs of two or more: key, start_ts, end_ts, count, newest first."""
    g = burst_rows(captures, gap).groupBy(F.col("session_start").alias("start_ts")).agg(F.max("ev").alias("end_ts"), F.count("*").alias("count")).where("count > 1")
    return g.select(F.concat_ws("-", F.col("start_ts"), F.col("end_ts")).alias("key"), "start_ts", "end_ts", "count").orderBy(F.desc("start_ts"))


def mode_by(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """The most frequent non-null value for each key, the least on ties. Counts come first, so a key's rows never meet."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(column, F.struct((-F.col("n")).alias("n"), F.col(column))).alias(out))


def burst_themes(lib: Library, gap: int = GAP) -> DataFrame:
    """Bursts with top_category, top_app, top_tags and preview_hashes (nulls kept)."""
    rows = cut(burst_rows(lib.captures, gap), "bursts")
    g = rows.groupBy("session_start").agg(F.max("ev").alias("end_ts"), F.count("*").alias("count")).where("count > 1")
    newest = F.row_number().over(Window.partitionBy("session_start").orderBy(F.desc("ev"), F.desc("id")))
    top = rows.withColumn("_n", newest).where(F.col("_n") <= PREVIEWS)
    previews = top.groupBy("session_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "content_hash"))), lambda s: s["content_hash"]).alias("preview_hashes"))
    tagged = rows.select("id", "session_start").join(lib.screenshot_tags, F.col("id") == F.col("screenshot_id")).select("session_start", "tag_id").join(lib.tags, F.col("tag_id") == F.col("id"))
    counts = tagged.groupBy("session_start", "name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("session_start").orderBy(F.desc("n"), "name"))
    tags = counts.withColumn("_n", place).where(F.col("_n") <= TOP_TAGS).groupBy("session_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda s: s["name"]).alias("top_tags"))
    for extra in (mode_by(rows, "session_start", "category", "top_category"), mode_by(rows, "session_start", "app_name", "top_app"), tags, previews):
        g = g.join(extra, "session_start", "left")
    none = F.array().cast("array<string>")
    return g.select(F.concat_ws("-", "session_start", "end_ts").alias("key"), F.col("session_start").alias("start_ts"), "end_ts", "count", "top_category", "top_app", F.coalesce("top_tags", none).alias("top_tags"), "preview_hashes").orderBy(F.desc("start_ts"))


def burst_items(captures: DataFrame, start: int, end: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Grid rows between two times, newest first; all without a limit."""
    if start < 0 or start > end:
        raise ValueError(f"no such range: {start} to {end}")
    df = captures.where(live() & ev().between(start, end)).orderBy(ev().desc(), F.desc("id")).select(*BASE_COLS)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def burst_membership(captures: DataFrame, gap: int = GAP) -> DataFrame:
    """(id, key) of available captures in bursts."""
    rows = cut(burst_rows(captures, gap), "bursts")
    ends = rows.groupBy("session_start").agg(F.max("ev").alias("end_ts"), F.count("*").alias("n")).where("n > 1")
    return rows.where(available()).join(ends, "session_start").select("id", F.concat_ws("-", "session_start", "end_ts").alias("key"))


# --- duplicates ------------------------------------------------------------------------------------------------------


def duplicate_members(captures: DataFrame) -> DataFrame:
    """One row for each member of an exact group, with the group's size: the form for groups of any size."""
    alive = captures.where(available() & F.col("content_hash").isNotNull())
    many = alive.groupBy("content_hash").agg(F.count("*").alias("count")).where("count > 1")
    return alive.join(many, "content_hash")


def exact_duplicates(captures: DataFrame) -> DataFrame:
    """Available captures of one content: key, size of the group, ids newest first; largest first.

    A group's ids are one value; see :func:`duplicate_members` where a group may be huge.
    """
    rows = duplicate_members(captures)
    g = rows.groupBy(F.col("content_hash").alias("key"), "count").agg(F.sort_array(F.collect_list(F.struct(ev().alias("ev"), "id")), asc=False).alias("items"))
    return g.select(F.lit("exact").alias("kind"), "key", "count", F.transform("items", lambda s: s["id"]).alias("ids")).orderBy(F.desc("count"), "key")


def all_but_newest(captures: DataFrame) -> DataFrame:
    """Ids of all members of exact groups but the newest. The newest is an aggregate, so a hot group isn't sorted."""
    alive = captures.where(available() & F.col("content_hash").isNotNull()).withColumn("_at", F.struct(ev().alias("ev"), "id"))
    keep = alive.groupBy("content_hash").agg(F.max("_at").alias("_keep"))
    return alive.join(keep, "content_hash").where(F.col("_at") != F.col("_keep")).select("id", "content_hash")


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def _blocks(distance: int, rows: int) -> list[tuple[int, int, int]] | None:
    """(shift, width, radius) of the blocks that cost the least against so many random hashes; None if comparing with all of them does.

    Few, wide blocks ask for many values that few hashes have; many, narrow ones for few that many have."""
    best = rows * COST_PLAIN, None
    for n in range(1, distance + 2):
        widths, radius = [64 // n + (i < 64 % n) for i in range(n)], distance // n
        masks = [sum(comb(w, r) for r in range(radius + 1)) for w in widths]
        cost = sum(m * (COST_ASKED + COST_MET * rows / 2**w) for m, w in zip(masks, widths, strict=True))
        if max(masks) <= MOST_MASKS and cost < best[0]:
            best = cost, [(sum(widths[:i]), w, radius) for i, w in enumerate(widths)]
    return best[1]


def _by_blocks(a: DataFrame, b: DataFrame, distance: int, blocks: list[tuple[int, int, int]], rows: int, same: bool) -> DataFrame:
    """Pairs by equal joins on blocks. A pair is given by the first block that finds it, so no pairs are shuffled to be made distinct."""
    part = lambda c, shift, width: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    key = lambda i, value: value * len(blocks) + i

    def asked_of(i: int, shift: int, width: int, radius: int) -> Column:
        masks = F.array(*(F.lit(m).cast("long") for m in _masks(width, radius)))
        return F.transform(masks, lambda m: key(i, m.bitwiseXOR(part(F.col("bits"), shift, width))))

    asks = sum(len(_masks(w, r)) for _, w, r in blocks)
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * asks // PART_ROWS))
    asked = a.select(F.col("id").alias("a_id"), F.col("bits").alias("a_bits"), F.explode(F.flatten(F.array(*(asked_of(i, *s) for i, s in enumerate(blocks))))).alias("k")).repartition(parts, "k")
    own = F.array(*(key(i, part(F.col("bits"), s, w)) for i, (s, w, _) in enumerate(blocks)))
    keyed = b.select(F.col("id").alias("b_id"), F.col("bits").alias("b_bits"), F.explode(own).alias("b_k")).repartition(parts, "b_k")
    apart = F.col("a_bits").bitwiseXOR(F.col("b_bits"))
    first = F.lit(len(blocks) - 1)
    for i, (shift, width, radius) in reversed(list(enumerate(blocks))):
        first = F.when(F.bit_count(part(apart, shift, width)) <= radius, i).otherwise(first)
    near = (F.col("k") == F.col("b_k")) & (F.bit_count(apart) <= distance)
    if len(blocks) > 1:  # the only block may have all 64 bits
        near = near & (F.pmod(F.col("k"), F.lit(len(blocks))) == first)
    if same:
        near = near & (F.col("a_id") < F.col("b_id"))
    return asked.join(keyed.hint("merge"), near).select("a_id", "b_id", F.bit_count(apart).cast("long").alias("d"))


def _tiles(nodes: DataFrame, tiles: int, side: str) -> DataFrame:
    """One row for each tile of some thousand hashes: its number, ids in order and bits."""
    rows = nodes.where("id is not null and bits is not null").groupBy(F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias(side)).agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("r"))
    return rows.select(side, F.col("r.id").alias(f"{side}_id"), F.col("r.bits").alias(f"{side}_bits"))


def _by_tiles(a: DataFrame, b: DataFrame, distance: int, rows: tuple[int, int], same: bool, first: bool) -> DataFrame:
    """Pairs by comparing all hashes, a tile with a tile at a time, with numpy: memory is bounded whatever the number of hashes or of pairs.

    ``first``: only the least b_id for each a_id and tile."""
    size = min(TILE, max(256, -(-max(rows) // 16)))
    n_a, n_b = (max(1, -(-r // size)) for r in rows)
    left, right = cut(_tiles(a, n_a, "a"), "tiles"), cut(_tiles(b, n_b, "b"), "tiles")
    left = left.select("*", F.explode(F.sequence(F.col("a") if same else F.lit(0), F.lit(n_b - 1))).alias("with"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("b") if same else F.lit(n_a - 1))).alias("for"))
    parts = min(MOST_PARTS, n_a * n_b, max(16, rows[0] * rows[1] // PER_TASK))
    left, right = left.repartition(parts, "a", "with"), right.repartition(parts, "for", "b")
    met = left.join(right.hint("merge"), (F.col("a") == F.col("for")) & (F.col("with") == F.col("b")))

    def compare(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            for t_a, t_b, ids_a, bits_a, ids_b, bits_b in zip(*cols, strict=True):
                x, y = (np.asarray(v.values, dtype=np.int64).view(np.uint64) for v in (bits_a, bits_b))  # numpy counts a negative number's bits without its sign
                i_a, i_b = (np.asarray(v.values, dtype=np.int64) for v in (ids_a, ids_b))
                once = same and t_a.as_py() == t_b.as_py()
                for at in range(0, len(x), ROWS):
                    # a few rows with all of the tile at a time
                    near = np.bitwise_count(x[at : at + ROWS, None] ^ y[None, :])
                    hits = near <= distance
                    if once:
                        hits &= i_a[at : at + ROWS, None] < i_b[None, :]
                    if first:
                        at_a = np.flatnonzero(hits.any(axis=1))
                        at_b = hits[at_a].argmax(axis=1)
                    else:
                        flat = np.flatnonzero(hits)
                        at_a, at_b = flat // len(y), flat % len(y)
                    if len(at_a):
                        p, q, d = i_a[at + at_a], i_b[at_b], near[at_a, at_b].astype(np.int64)
                        lo, hi = (np.minimum(p, q), np.maximum(p, q)) if same else (p, q)
                        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(d)], names=["a_id", "b_id", "d"])

    return met.select("a", "b", "a_id", "a_bits", "b_id", "b_bits").mapInArrow(compare, "a_id long, b_id long, d long")


def near_pairs(a: DataFrame, b: DataFrame, distance: int, first: bool = False) -> DataFrame:
    """(a_id, b_id, d) for pairs of hashes (id, bits) of two sets within ``distance``; ``first``: each a_id's least b_id, at least."""
    rows = a.count(), b.count()
    blocks = _blocks(distance, rows[1])
    return _by_tiles(a, b, distance, rows, False, first) if blocks is None else _by_blocks(a, b, distance, blocks, rows[0], False)


def hamming_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """(lo, hi, d) for pairs of (id, bits) with lo < hi within ``distance``.

    The 64 bits are cut into blocks, by the number of rows; two hashes within the distance agree in one block
    but for distance // blocks bits, so one side asks for all values within that radius. Where that costs more than comparing
    all pairs, as with wide distances, tiles of hashes are compared."""
    rows = nodes.count()
    blocks = _blocks(distance, rows)
    out = _by_tiles(nodes, nodes, distance, (rows, rows), True, False) if blocks is None else _by_blocks(nodes, nodes, distance, blocks, rows, True)
    return out.select(F.col("a_id").alias("lo"), F.col("b_id").alias("hi"), "d")


def _settled(nodes: DataFrame, distance: int) -> DataFrame:
    """(id, leader) of distinct hashes. Rounds settle nodes whose lower neighbours are settled; each round's states are written."""
    edges = cut(hamming_pairs(nodes, distance), "edges")
    state = cut(nodes.select("id", F.lit(None).cast("boolean").alias("leads")), "state")
    while True:
        low = edges.join(state.withColumnRenamed("leads", "low"), edges.lo == F.col("id")).groupBy(F.col("hi").alias("id"))
        low = low.agg(F.max(F.coalesce("low", F.lit(False))).alias("some"), F.max(F.col("low").isNull()).alias("open"))
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("some", F.lit(False)), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True)
        state = cut(state.join(low, "id", "left").select("id", leads.alias("leads")), "state")
        if not state.where("leads is null").limit(1).count():
            break
    lead = state.where("leads").select(F.col("id").alias("leader"))
    joined = edges.join(lead, edges.lo == lead.leader).groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("leader"))
    return state.join(joined, "id", "left").select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("leader")).alias("leader"))


def leaders(nodes: DataFrame, distance: int) -> DataFrame:
    """(id, leader): each node in order of id joins the first leader within the distance, or leads.

    Leaders are the first maximal independent set in order of id. Ranges of ids are settled one after the other, each some times larger than the
    one before: nodes near an earlier range's leader join it, and only the others are compared with one another. So a
    dense cluster's pairs are made for its first members alone.
    """
    firsts = cut(nodes.where("bits is not null").groupBy("bits").agg(F.min("id").alias("id")).select("id", "bits"), "firsts")  # equal hashes follow the least id
    n, shares = firsts.count(), []
    while n * GROWTH ** -(len(shares) + 1) >= FIRST_RANGE:
        shares.insert(0, GROWTH ** -(len(shares) + 1))
    bounds = [None, *sorted(set(firsts.approxQuantile("id", shares, 1e-3))), None] if shares else [None, None]
    done, known = None, None
    for low, high in zip(bounds, bounds[1:], strict=False):
        rest = firsts if low is None else firsts.where(F.col("id") > low)
        rest = rest if high is None else rest.where(F.col("id") <= high)
        if known is not None:
            joined = near_pairs(rest, known, distance, first=True).groupBy(F.col("a_id").alias("id")).agg(F.min("b_id").alias("leader"))
            joined = cut(joined, "joined")
            done, rest = done.union(joined), cut(rest.join(joined, "id", "left_anti"), "rest")
        own = cut(_settled(rest, distance), "settled")
        lead = rest.join(own.where("id = leader").select("id"), "id", "left_semi").select("id", "bits")
        done, known = (own, cut(lead, "leaders")) if known is None else (done.union(own), cut(known.union(lead), "leaders"))
    of_first = done.select(F.col("id").alias("first"), "leader")
    return nodes.join(firsts.select("bits", F.col("id").alias("first")), "bits").join(of_first, "first").select("id", "leader")


def similar_groups(captures: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Groups of similar pictures: key (the leader), count, ids newest first by created_ts; largest first."""
    distance = min(DISTANCE_MOST, max(0, distance))
    shots = captures.where(available()).withColumn("bits", phash_from_hex(F.col("phash"))).where("bits is not null")
    member = shots.join(leaders(shots.select("id", "bits"), distance), "id")
    g = member.groupBy(F.col("leader").alias("key")).agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct(F.coalesce("created_ts", F.lit(0)).alias("ts"), "id")), asc=False).alias("items"))
    return g.where("count > 1").select(F.lit("similar").alias("kind"), "key", "count", F.transform("items", lambda s: s["id"]).alias("ids")).orderBy(F.desc("count"), "key")
