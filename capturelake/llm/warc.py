"""WARC derivatives: metadata and plain-text conversion records from responses.

Every response gives two records. The ``metadata`` record is JSON: the response's own
WARC and HTTP headers in order, its digests, title and links. The ``conversion`` record is
the page's plain text, a line for each block. Both name the response in
``WARC-Refers-To``, keep its target, date, payload digest and other source headers, and
point at each other with ``WARC-Concurrent-To``. Record ids are functions of the response's
id, so a task that is run again writes the same files.

Files are gzip, one member for each record. A task writes one file and holds one
record; readers stream, also through files of any length.

Nulls and odd input: a null or empty page is a response without a body; its records are there with an
empty text. A null url has no target. A response whose declared digest is wrong gives
records that say so (``digest_ok`` false). Repeated rows each have records, with equal ids
where all is equal. Pages of any length are one record. Empty tables give no rows. Ids and urls
come back as they were, line breaks included. Other columns are ignored, whatever their names. What is no whole record of a given
file is passed over and reported, or an error (see :func:`derive_files`).
"""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import bounded_batches, file_system, in_parts, put_file, shared_path
from capturelake.llm.html_extraction import parse

Headers = list[tuple[str, str]]
#: Headers that a derivative has of its own; all others of a response are kept.
OWN = frozenset("warc-type warc-record-id warc-refers-to warc-concurrent-to warc-block-digest content-type content-length warc-truncated".split())
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
_TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|source|form)\b[^>]*?\b(href|src|action)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


@functools.lru_cache(maxsize=64)
def _base32(data: bytes) -> str:
    return base64.b32encode(data).decode()


def digest(data: bytes) -> str:
    return "sha1:" + _base32(hashlib.sha1(data).digest())  # a response's digests are asked for twice


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _clean(value: str) -> str:
    """A header's value on one line."""
    return (re.sub(r"\s*[\r\n]\s*", " ", value) if "\n" in value or "\r" in value else value).strip()


def to_bytes(headers: Headers, block: bytes) -> bytes:
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member, without a time."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class BrokenRecord(ValueError):
    pass


def records(stream, bad: Callable[[str], None] | None = None) -> Iterator[tuple[Headers, bytes]]:
    """Records of a WARC file, gzip or plain, one at a time. What is no record is an error; or ``bad`` is told
    why, and reading goes on at the next line that begins a record, or ends where the file can't be unpacked."""
    try:
        yield from _records(stream, bad)
    except (EOFError, OSError, zlib.error) as e:
        if not bad:
            raise BrokenRecord(f"the file can't be unpacked: {e}") from e
        bad(f"the file can't be unpacked: {e}")


def _records(stream, bad: Callable[[str], None] | None) -> Iterator[tuple[Headers, bytes]]:
    def broken(why: str) -> None:
        if not bad:
            raise BrokenRecord(why)
        bad(why)

    if isinstance(stream, pa.NativeFile):
        stream = io.BufferedReader(stream, 1 << 20)
    packed = stream.read(2) == b"\x1f\x8b"
    stream.seek(0)
    stream = gzip.GzipFile(fileobj=stream) if packed else stream
    lost = False
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            if not lost:
                broken(f"no record begins with {line[:40]!r}")
            lost = True
            continue
        lost = False
        headers: Headers = []
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and headers:
                headers[-1] = headers[-1][0], f"{headers[-1][1]} {text.strip()}"
            else:
                name, _, value = text.partition(":")
                headers.append((name.strip(), value.strip()))
        length = get(headers, "Content-Length") or "0"
        if not (length.isascii() and length.isdigit()):
            broken(f"a record has a length of {length[:40]!r}")
            lost = True
            continue
        block = stream.read(int(length))
        if len(block) != int(length):
            broken("a record is cut off")
            return
        yield headers, block


def quoted(value: str) -> str:
    """Any text as a header's value that is read back as it was: one that no line can hold, an empty one, or one in quotes is quoted as in JSON."""
    return value if value and value.isprintable() and _clean(value) == value and value[0] != '"' else json.dumps(value)


def unquoted(value: str | None) -> str | None:
    """What :func:`quoted` was given; a value that isn't quoted as it is."""
    if value is None or not value.startswith('"'):
        return value
    try:
        return json.loads(value)
    except ValueError:
        return value


def response_of(key: str | None, url: str | None, page: str | None, date: str = "2026-01-01T00:00:00Z") -> tuple[Headers, bytes]:
    """A page as the response record that a crawler would have written. Its key, and a url that no header's line can hold
    as it is, are kept in headers of their own."""
    body = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    payload = digest(body)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(f"{'' if key is None else key} {url} {payload}")), ("WARC-Date", date)]
    if key is not None:
        headers.append(("WARC-Source-Key", quoted(key)))
    if url is not None:
        headers.append(("WARC-Target-URI", url))
        if _clean(url) != url or not url.isprintable():
            headers.append(("WARC-Source-URL", quoted(url)))
    return [*headers, ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest)], body


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response; none of other records."""
    if get(headers, "WARC-Type") != "response":
        return []
    status, http, body = split_http(block)
    payload, own = digest(body), get(headers, "WARC-Payload-Digest")
    charset = _CHARSET.search(get(http, "Content-Type") or "")
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = "\n".join(b.text for b in parse(page, "")[0]).encode()
    title = _TITLE.search(page)
    links = [{"path": f"{m[1].lower()}@{m[2].lower()}", "url": entities.unescape(m[3].strip("\"'"))} for m in _LINK.finditer(page)]
    source = get(headers, "WARC-Record-ID") or record_id(payload)
    envelope = {
        "WARC-Header": headers,
        "HTTP-Status": status,
        "HTTP-Header": http,
        "Payload-Digest": payload,
        "Digest-OK": own in (None, payload) and get(headers, "WARC-Block-Digest") in (None, digest(block)),
        "Payload-Length": len(body),
        "Title": " ".join(entities.unescape(title[1]).split()) if title else None,
        "Links": links,
    }
    ids = [record_id(f"{source} {kind}") for kind in ("metadata", "conversion")]
    kept = [(k, v) for k, v in headers if k.lower() not in OWN]
    if own is None:
        kept.append(("WARC-Payload-Digest", payload))
    made = (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode()), ("conversion", "text/plain; charset=utf-8", text))
    return [
        ([("WARC-Type", kind), ("WARC-Record-ID", ids[i]), ("WARC-Refers-To", source), ("WARC-Concurrent-To", ids[1 - i]), *kept, ("WARC-Block-Digest", digest(data)), ("Content-Type", what), ("Content-Length", str(len(data)))], data)
        for i, (kind, what, data) in enumerate(made)
    ]


def _write(out_dir: str, made: Iterator[tuple[Headers, bytes]]) -> Iterator[pa.RecordBatch]:
    """One file of this task's records; yields its name if there are any."""
    from itertools import chain

    from pyspark import TaskContext

    first = next(made, None)
    if first is None:
        return
    task = TaskContext.get()
    name = f"{out_dir}/part-{task.partitionId():06d}.warc.gz"

    def body(sink) -> None:
        for headers, block in chain([first], made):
            sink.write(member(to_bytes(headers, block)))

    put_file(name, body, str(task.taskAttemptId()))
    yield pa.RecordBatch.from_pydict({"file": [name]})


def derive_files(spark: SparkSession, sources: list[str], out_dir: str, problems: list[tuple[str, str]] | None = None) -> list[str]:
    """Derivatives of WARC files: one file for each, in ``out_dir``. Returns the names.

    What is no whole record is passed over, and ``problems`` gets (source, reason) of each; without it, that is an error.
    """
    names, strict = spark.sparkContext.broadcast(sources), problems is None

    def run(batches):
        told: list[tuple[str, str]] = []

        def made():
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    fs, path = file_system(names.value[i])
                    with fs.open_input_file(path) as f:
                        for headers, block in records(f, None if strict else lambda why, n=names.value[i]: told.append((n, why))):
                            yield from derive(headers, block)

        for batch in _write(out_dir, made()):
            yield pa.RecordBatch.from_pydict({"file": batch.column(0), "source": pa.nulls(batch.num_rows, pa.string()), "reason": pa.nulls(batch.num_rows, pa.string())})
        if told:
            yield pa.RecordBatch.from_pydict({"file": pa.nulls(len(told), pa.string()), "source": [n for n, _ in told], "reason": [w for _, w in told]})

    if not sources:
        return []
    rows = spark.range(0, len(sources), 1, len(sources)).mapInArrow(run, "file string, source string, reason string").collect()
    if problems is not None:
        problems.extend(sorted((r.source, r.reason) for r in rows if r.file is None))
    return sorted(r.file for r in rows if r.file is not None)


def derive_pages(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """Derivatives of a table of pages, by way of their response records: a file for each task. Returns the names."""
    bounded_batches(pages.sparkSession)
    light = pages.select(F.col(id_col).cast("string").alias("k"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))

    def run(batches):
        def made():
            for batch in (p for b in batches for p in in_parts(b, 2)):
                for key, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    yield from derive(*response_of(key, url, page))

        yield from _write(out_dir, made())

    return sorted(r.file for r in light.mapInArrow(run, "file string").collect())  # a name for each task


ROW = T.StructType([T.StructField(n, k) for n, k in (
    ("source_key", T.StringType()), ("url", T.StringType()), ("kind", T.StringType()), ("record_id", T.StringType()), ("refers_to", T.StringType()), ("concurrent_to", T.StringType()),
    ("payload_digest", T.StringType()), ("block_digest", T.StringType()), ("n_bytes", T.LongType()), ("n_items", T.LongType()), ("digest_ok", T.BooleanType()), ("block_sha256", T.StringType()),
)])


def read_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """One row for each record of WARC files, as read back.

    n_items: links of a metadata record, characters of a conversion record. digest_ok: the
    block has its declared digest and a metadata record says that its source had.
    """
    if not files:
        return spark.createDataFrame([], ROW)
    names = spark.sparkContext.broadcast(files)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fs, path = file_system(names.value[i])
                held = []
                with fs.open_input_file(path) as f:
                    for headers, block in records(f):
                        kind, ok = get(headers, "WARC-Type"), get(headers, "WARC-Block-Digest") == digest(block)
                        items = None
                        if kind == "metadata":
                            envelope = json.loads(block)
                            items, ok = len(envelope["Links"]), ok and envelope["Digest-OK"]
                        elif kind == "conversion":
                            items = len(block.decode())
                        own = (get(headers, n) for n in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Payload-Digest", "WARC-Block-Digest"))
                        held.append((unquoted(get(headers, "WARC-Source-Key")), unquoted(get(headers, "WARC-Source-URL")) or get(headers, "WARC-Target-URI"), kind, *own, len(block), items, ok, hashlib.sha256(block).hexdigest()))
                        if len(held) == 5000:
                            yield _rows(held)
                            held = []
                if held:
                    yield _rows(held)

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, ROW)


_ARROW = (*(pa.string(),) * 8, pa.int64(), pa.int64(), pa.bool_(), pa.string())


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], names=ROW.names)


def page_derivatives(pages: DataFrame, out_dir: str | None = None, **columns) -> DataFrame:
    """Two rows for each page, from the files: page_id, url, kind, record_id, refers_to, concurrent_to,
    payload_digest, block_digest, n_bytes, n_items, digest_ok, block_sha256."""
    spark = pages.sparkSession
    files = derive_pages(pages, out_dir or shared_path(spark, "warc"), **columns)
    kind = pages.schema[columns.get("id_col", "page_id")].dataType
    rows = read_records(spark, files)
    return rows.select(F.col("source_key").cast(kind).alias("page_id"), *ROW.names[1:])
