"""Cutting a lineage, and the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``, used by nobody else.

    Where that is unset, as on one machine in tests, a temporary folder is set; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="capturelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back; see :func:`shared_path`."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, order: list[Column], first: int = 0) -> DataFrame:
    """``df`` with a column of consecutive numbers in an order that tells rows apart.

    Rows are dealt out by range and numbered within their range; how many rows lie before a range
    is one number for each, so no task sees all rows.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before, rows = first, []
    for r in sorted(dealt.groupBy("_part").count().collect()):
        rows.append((r["_part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(rows, "_q int, _before long")
    n = (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).cast("long")
    out = dealt.withColumn("_n", n).join(F.broadcast(offsets), F.col("_part") == F.col("_q"))  # one row for each range
    return out.withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_q", "_n", "_before")
