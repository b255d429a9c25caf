import base64
import gzip
import hashlib
import io
import json
import re

import pytest

from capturelake.llm import warc


def plain_records(data):
    """Records by splitting at declared lengths, apart from the reader under test."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + n]))
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        at = end + 8 + n
    return out


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


PAGES = [
    (1, "http://a.org/x", "<title>T &amp; u</title><nav><a href='/m'>menu</a></nav><p>One<p>Two <img src=i.png>"),
    (2, None, "<p>no url é</p>"), (3, "http://b.org", None), (4, "http://c.org", ""), (5, "http://d.org/\n x", "<p>" + "long " * 20_000),
    (None, "http://e.org", "<p>null id"), (6, "http://f.org", "<p>same"), (6, "http://f.org", "<p>same"),
]


def test_files_and_rows(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, kind string")
    rows = warc.page_derivatives(pages, f"file://{tmp_path}/w").collect()
    assert len(rows) == 2 * len(PAGES) and all(r.digest_ok for r in rows)
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.warc.gz")))
    found = plain_records(data)
    assert len(found) == len(rows)
    by_id = {h["WARC-Record-ID"]: (h, b) for h, b in found}
    for r in rows:
        head, block = by_id[r.record_id]
        html = next(h or "" for i, u, h in PAGES if (i, u) == (r.page_id, r.url)).encode()
        assert (head["WARC-Type"], head["WARC-Refers-To"], head["WARC-Block-Digest"], head["WARC-Payload-Digest"]) == (r.kind, r.refers_to, sha1(block), sha1(html))
        assert (r.n_bytes, r.block_sha256, head.get("WARC-Target-URI")) == (len(block), hashlib.sha256(block).hexdigest(), r.url and " ".join(r.url.split()))
        other = by_id[r.concurrent_to][0]
        assert other["WARC-Concurrent-To"] == r.record_id and other["WARC-Refers-To"] == r.refers_to and other["WARC-Type"] != r.kind
    meta = json.loads(next(b for h, b in found if h["WARC-Type"] == "metadata" and h.get("WARC-Source-Key") == "1"))
    assert meta["Title"] == "T & u" and [x["url"] for x in meta["Links"]] == ["/m", "i.png"] and ["Content-Type", "text/html; charset=utf-8"] in meta["HTTP-Header"]
    assert dict(map(tuple, meta["WARC-Header"]))["WARC-Record-ID"] == next(r.refers_to for r in rows if r.page_id == 1)
    assert next(b for h, b in found if h["WARC-Type"] == "conversion" and h.get("WARC-Source-Key") == "1").decode() == "menu\nOne\nTwo"


def test_files_of_a_crawler(spark, tmp_path):
    own = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-IP-Address", "1.2.3.4"), ("WARC-Target-URI", "http://z.org")]
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>é".encode("latin-1")
    good = [*own, ("WARC-Payload-Digest", sha1("<p>é".encode("latin-1"))), ("Content-Length", str(len(block)))]
    bad = [*own[:1], ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Payload-Digest", "sha1:WRONG"), ("Content-Length", str(len(block)))]
    info = warc.to_bytes([("WARC-Type", "warcinfo"), ("Content-Length", "2")], b"hi")
    (tmp_path / "plain.warc").write_bytes(info + warc.to_bytes(good, block))
    (tmp_path / "packed.warc.gz").write_bytes(warc.member(info) + warc.member(warc.to_bytes(bad, block)))
    names = warc.derive_files(spark, [f"file://{tmp_path}/plain.warc", f"file://{tmp_path}/packed.warc.gz"], f"file://{tmp_path}/out")
    rows = {(r.refers_to, r.kind): r for r in warc.read_records(spark, names).collect()}
    assert {k: r.digest_ok for k, r in rows.items()} == {("<urn:uuid:1>", "metadata"): True, ("<urn:uuid:1>", "conversion"): True, ("<urn:uuid:2>", "metadata"): False, ("<urn:uuid:2>", "conversion"): True}
    text = gzip.decompress((tmp_path / "out" / "part-000000.warc.gz").read_bytes())
    assert text.count(b"WARC-IP-Address: 1.2.3.4\r\n") == 2 and "é".encode() in text
    assert warc.derive_files(spark, [], f"file://{tmp_path}/no") == []


def test_ids_and_urls_come_back_as_they_were(spark, tmp_path):
    keys = [None, "", " a ", "b\nc", '"q"', "é", "plain", "tab\t", "\u2028"]
    pages = spark.createDataFrame([(k, k, f"<p>{i}") for i, k in enumerate(keys)], "page_id string, url string, html string")
    got = warc.page_derivatives(pages, f"file://{tmp_path}/k").collect()
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(k), str(k)) for k in keys for _ in "mc")


def test_broken_records_are_told_and_passed_over(spark, tmp_path):
    head = [("WARC-Type", "response"), ("WARC-Target-URI", "http://z.org")]
    block = b"HTTP/1.1 200 OK\r\n\r\n<p>text"
    whole = lambda i: warc.to_bytes([*head, ("WARC-Record-ID", f"<urn:uuid:{i}>"), ("Content-Length", str(len(block)))], block)
    bad = warc.to_bytes([*head, ("Content-Length", "many")], block)
    (tmp_path / "a.warc").write_bytes(whole(1) + bad + whole(2) + b"junk\r\n" * 3 + whole(3) + whole(4)[:-9])
    (tmp_path / "b.warc.gz").write_bytes(warc.member(whole(5)) + warc.member(whole(6))[:-12])
    sources, problems = [f"file://{tmp_path}/{n}" for n in ("a.warc", "b.warc.gz")], []
    names = warc.derive_files(spark, sources, f"file://{tmp_path}/out", problems)
    refers = [r.refers_to for r in warc.read_records(spark, names).where("kind = 'conversion'").collect()]
    assert {f"<urn:uuid:{i}>" for i in (1, 2, 3, 5)} <= set(refers) and "<urn:uuid:4>" not in refers
    assert [n for n, _ in problems] == [sources[0]] * 3 + [sources[1]] and any("many" in why for _, why in problems)
    with pytest.raises(Exception, match="length"):
        warc.derive_files(spark, sources[:1], f"file://{tmp_path}/strict")


def test_broken_files():
    whole = warc.to_bytes([("WARC-Type", "x"), ("Content-Length", "5")], b"hello")
    assert list(warc.records(io.BytesIO(whole * 2))) == [([("WARC-Type", "x"), ("Content-Length", "5")], b"hello")] * 2
    for data in (whole[:-7], b"junk\r\n"):
        with pytest.raises(warc.BrokenRecord):
            list(warc.records(io.BytesIO(data)))
    folded = re.sub(b"x\r\n", b"x\r\n\ty\r\n", whole, count=1)
    assert next(warc.records(io.BytesIO(folded)))[0][0] == ("WARC-Type", "x y")


def test_empty_table(spark, tmp_path):
    assert warc.page_derivatives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e").collect() == []
