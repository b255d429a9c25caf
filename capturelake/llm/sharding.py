"""A uniform shuffle into shards of exact sizes, by a communication matrix.

Rows lie in ``P`` parts (by a hash of the row). The matrix says how many rows of
each part go to each shard: its rows are drawn one after the other from the
multivariate hypergeometric law, which is the law of those counts under a uniform
permutation, and its columns sum to the exact shard sizes. Then every part is
permuted on its own and cut by its row of the matrix, the pieces are exchanged,
and every shard is permuted again: its rows are ordered by a second random key,
in blocks by the key's leading bits, and a block's first slot is the number of
rows in the blocks before it. A block has some ``PART_ROWS`` rows, whatever the
size of a shard, so no task holds a shard.

Both orders are functions of the row and the seed, so a task that is run again
deals out the same rows.

Nulls and odd input: null ids and texts count as values of their own; a null text
has size 1. Equal texts under different ids are spread like any rows. Rows
that repeat with the same id and text follow one another in a part's and in a shard's order.
Empty tables give no rows. Shards may be empty if there are fewer rows than shards.
Of a text of any length only size and hashes move. Other columns are ignored, whatever their names.
The driver holds one row and as many draws as there are shards for each part of some 50,000 rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import free_name, written
from capturelake.llm.joins import join_small

#: Rows of a part and of a block of a shard, about.
PART_ROWS = 50_000
#: numpy's own sampler takes populations below this.
NUMPY_MOST = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; for populations of any size."""
    if n == 0 or good == 0:
        return 0
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    lg = math.lgamma
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda a, b: lg(a + 1) - lg(b + 1) - lg(a - b + 1)
    p = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u = rng.random() - p  # inversion outward from the mode, both sides in turn
    k_up = k_down = mode
    p_up = p_down = p
    while u > 0 and (k_up < high or k_down > low):
        if k_up < high:
            p_up *= (good - k_up) * (n - k_up) / ((k_up + 1) * (bad - n + k_up + 1))
            k_up += 1
            u -= p_up
            if u <= 0:
                return k_up
        if k_down > low:
            p_down *= k_down * (bad - n + k_down) / ((good - k_down + 1) * (n - k_down + 1))
            k_down -= 1
            u -= p_down
            if u <= 0:
                return k_down
        if p_up + p_down < 1e-18:
            break
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with row sums ``parts`` and column sums ``shards``."""
    rng = np.random.default_rng(seed)
    left, out = list(shards), []
    for n in parts:
        row, rest, todo = [], sum(left), n
        for j, have in enumerate(left):
            rest -= have
            k = hypergeometric(rng, have, rest, todo)
            row.append(k)
            todo -= k
            left[j] -= k
        out.append(row)
    return out


def shuffle_into_shards(rows: DataFrame, n_shards: int = 16, seed: int = 7, by: list[str] | None = None) -> DataFrame:
    """``rows``, which should be a written table, with two more columns: shard int, slot long.

    ``by``: the columns that tell rows apart, all if not given. Sizes differ by at most one row.
    """
    by = by or rows.columns
    part, key, cum, block = (free_name(rows, n) for n in ("part", "key", "cum", "block"))
    n = rows.count()
    n_parts = max(1, -(-n // PART_ROWS))
    placed = rows.withColumn(part, F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(n_parts)).cast("int")).withColumn(key, F.xxhash64(F.lit(seed + 1), *by))
    counts = dict(placed.groupBy(part).count().collect())  # one row for each part
    names = sorted(counts)
    sizes = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts[p] for p in names], sizes, seed)
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(p, np.cumsum(row).tolist()) for p, row in zip(names, matrix, strict=True)], f"{part} int, {cum} array<long>")
    rank = F.row_number().over(Window.partitionBy(part).orderBy(key, *by)) - 1
    dealt = join_small(placed.withColumn("slot", rank), cuts, part)
    dealt = dealt.withColumn("shard", F.size(F.filter(cum, lambda c: c <= F.col("slot")))).drop(part, cum, "slot")
    bits = max(0, math.ceil(math.log2(max(1, n / n_shards / PART_ROWS))))
    again = F.xxhash64(F.lit(seed + 2), *by)
    lead = F.shiftrightunsigned(again, 64 - bits).cast("int") if bits else F.lit(0)
    dealt = written(dealt.withColumn(key, again.bitwiseXOR(F.lit(-(2**63)))).withColumn(block, lead), "dealt")
    per = dealt.groupBy("shard", block).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("shard", block, before.alias("offset_rows"))
    own = F.row_number().over(Window.partitionBy("shard", block).orderBy(key, *by)) - 1
    out = dealt.withColumn("own_slot", own).join(offsets, ["shard", block])
    return out.withColumn("slot", (F.col("own_slot") + F.col("offset_rows")).cast("long")).select(*rows.columns, "shard", "slot")


def shards_of(docs: DataFrame, n_shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only the id, size and checksum of a document travel.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "light")
    out = shuffle_into_shards(light, n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
