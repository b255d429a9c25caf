"""Helpers that the training-data operators share.

Everything here is about running well on a cluster: a folder that all machines
see, tables that cut a lineage, and passing text through Python in Arrow batches
without touching the other columns.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests on one machine, a temporary folder is made
    once and set on the session and its context; on a cluster that is an error, as machines don't share one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="capturelake-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under :func:`shared_root`, used by nobody else."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage; the files outlive any executor.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def release_memory() -> None:
    """Give freed memory back to the system, at the end of a task: an idle worker would else keep it from its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def add_from_text(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], done: Callable[[], None] | None = None, hold: int = 0) -> DataFrame:
    """Add columns that a Python function computes from whole texts.

    ``make()`` runs once in each task and returns a function from a list of texts
    (None for null) to one list of values for each of ``fields``; ``done()`` runs at the task's end; a list has PART_BYTES of text, or ``hold``, or one longer text. All columns of
    ``df`` pass through untouched, as Arrow; only the text is converted. The names
    of ``fields`` must be free (see :func:`free_name`).
    """
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [_arrow_type(f.dataType) for f in fields]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for group in together((p for b in batches for p in in_parts(b, at)), hold):
            new = fn([t for p in group for t in p.column(at).to_pylist()])
            begin = 0
            for part in group:
                own = (v.slice(begin, part.num_rows) if isinstance(v, pa.Array) else pa.array(v[begin : begin + part.num_rows], type=k) for v, k in zip(new, kinds, strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, *(f.name for f in fields)])
                begin += part.num_rows
        if done:
            done()
        release_memory()

    return df.mapInArrow(run, schema)


def together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches of ``most`` bytes together, or one larger one."""
    group, held = [], 0
    for batch in batches:
        if group and held + batch.nbytes > most:
            yield group
            group, held = [], 0
        group.append(batch)
        held += batch.nbytes
    if group:
        yield group


#: Text bytes that a Python worker handles at once; a longer text is a batch of its own.
PART_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and its Python workers, at most.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's own bound on Arrow batches to BATCH_BYTES, where it is higher: rows of
    long texts would else make batches of 64 MB, several of them for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most PART_BYTES of text in column ``at`` each, or one row."""
    if batch.num_rows == 0:
        return
    if batch.nbytes <= PART_BYTES:
        yield batch
        return
    import pyarrow.compute as pc

    if not (pa.types.is_string(batch.column(at).type) or pa.types.is_large_string(batch.column(at).type) or pa.types.is_binary(batch.column(at).type) or pa.types.is_large_binary(batch.column(at).type)):
        step = max(1, batch.num_rows * PART_BYTES // batch.nbytes)
        yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > PART_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    yield batch.slice(begin)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def file_system(uri: str):
    """pyarrow's file system for ``uri`` and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def put_file(uri: str, write: Callable[[object], None], attempt: str) -> None:
    """Write a file under another name first and move it when whole, so that a task that is run again or twice leaves one whole file."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{attempt}.tmp"
    with fs.open_output_stream(tmp) as out:
        write(out)
    try:
        fs.move(tmp, path)
    except OSError:  # some stores don't replace what an earlier attempt left
        fs.delete_file(path)
        fs.move(tmp, path)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null; stays in the JVM."""
    ends = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(ends, F.lit(0)).cast("long")
