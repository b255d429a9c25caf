"""Joins and running sums that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import free_name, written

#: Rows up to which a side that was written and counted is broadcast.
BROADCAST_ROWS = 100_000
#: Pieces of each key of the large side where the small one is too large for that.
SALTS = 64
#: A key is hot with more than this part of all rows.
SHARE = 1000


def counted(small: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has ``bound`` rows at most; else
    as it is, for keys that are near unique on both sides."""
    return F.broadcast(small) if small.count() <= bound else small


def join_small(large: DataFrame, small: DataFrame, on: str, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``large`` with a written table of narrow rows that has each key of ``on`` once.

    The rows of ``small`` are counted: up to ``bound`` they are broadcast. Beyond,
    each key of ``large`` is split by a salt and ``small`` repeated for each salt,
    so that no task gets a whole hot key. Null keys match null keys.
    """
    key = free_name(large, "join_key")
    right = small.withColumnRenamed(on, key)
    equal = large[on].eqNullSafe(right[key])
    if small.count() <= bound:
        return large.join(F.broadcast(right), equal, how).drop(key)
    salt = free_name(large, "salt")
    left = large.withColumn(salt, F.pmod(F.xxhash64(*large.columns), F.lit(SALTS)).cast("int"))
    right = right.withColumn(salt + "_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    equal = left[on].eqNullSafe(right[key]) & (left[salt] == right[salt + "_r"])
    return left.join(right, equal, how).drop(key, salt, salt + "_r")


def hot_keys(large: DataFrame, on: str) -> DataFrame | None:
    """The keys of a written table with more than a ``SHARE``-th of its rows each, fewer than ``SHARE``; None if there are none."""
    rows = large.where(F.col(on).isNotNull())
    most = rows.count() // SHARE
    hot = written(rows.groupBy(on).agg(F.count("*").alias("n")).where(F.col("n") > most).select(on), "hot") if most else None
    return hot if hot is not None and hot.limit(1).count() else None


def join_hot(large: DataFrame, small: DataFrame, on: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join of two written tables; ``small`` has each key of ``on`` once, and may have as many rows as ``large``.

    ``hot``: the keys of ``large`` that no task should get whole, see :func:`hot_keys`. Their rows of ``small`` are broadcast
    and those of ``large`` stay where they are; a merge joins the rest. Null keys match nothing.
    """
    rows = large.where(F.col(on).isNotNull())
    if hot is None:
        return rows.join(small.hint("merge"), on)
    hot = F.broadcast(hot)  # SHARE rows at most
    return rows.join(hot, on, "left_anti").join(small.hint("merge"), on).unionByName(rows.join(F.broadcast(small.join(hot, on, "left_semi")), on))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add for each of ``sums`` the sum over all rows before this one in ``order``.

    Rows are dealt out by range and summed within their part; only one row for each
    part goes through the driver. ``order`` must tell rows apart.
    """
    part = free_name(df, "part")
    cut = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    totals = sorted(tuple(r) for r in cut.groupBy(part).agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect())
    before, rows = [0] * len(sums), []
    for p, *own in totals:
        rows.append((p, *before))
        before = [a + (b or 0) for a, b in zip(before, own, strict=True)]
    names = [free_name(df, f"before_{n}") for n in sums]
    spark = df.sparkSession
    offsets = spark.createDataFrame(rows, f"{part}_o int, " + ", ".join(f"{n} long" for n in names))
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in sums.items()))
    out = own.join(F.broadcast(offsets), own[part] == offsets[f"{part}_o"])  # one row for each part
    return out.select(*df.columns, *((F.col(n) + F.col(b)).alias(n) for n, b in zip(sums, names, strict=True)))
