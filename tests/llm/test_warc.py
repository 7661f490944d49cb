import base64
import gzip
import hashlib
import tracemalloc

import pytest

from fluxmill.llm import warc

ROWS = [
    (1, "http://a/x", "<p>one</p>"),
    (2, "http://a/y z\r\n", "<p>one</p>"),
    (3, None, "é🙂" * 10),
    (4, "u", None),
    (5, "u", ""),
    (6, "u", "x" * 100_000),
    (6, "u", "x" * 100_000),
    (None, "n", "lonely"),
    (None, "n", "<p>one</p>"),
    (7, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "k", 1) for r in ROWS], "page_id long, url string, html string, kind string, size int")


def test_roundtrip(spark, pages):
    folder = warc.scratch(spark, "warc-test")
    manifest = warc.write_archives(warc.label(pages), folder)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    chunks = warc.read_archives(manifest, chunk=1000).orderBy("record_id", "chunk_no").collect()
    last = [c for c in chunks if c["last"]]
    assert len(last) == len(ROWS)
    top = {}
    for i, _, h in ROWS:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = sorted((str(i), len((h or "").encode()), digest(h), "response" if top.get(h or "", i) == i else "revisit", str(None if top.get(h or "", i) == i else top[h or ""])) for i, _, h in ROWS)
    assert sorted((str(c["ident"]), c["payload_bytes"], c["payload_digest"], c["record_type"], str(c["refers_to"])) for c in last) == want
    whole = {}
    for c in chunks:
        if c["record_type"] == "response" and c["ident"] in (3, 7):
            whole[c["ident"]] = whole.get(c["ident"], b"") + bytes(c["chunk"])
    assert whole == {i: h.encode() for i, _, h in ROWS if i in (3, 7)}
    big = [c for c in chunks if c["ident"] == 6 and c["record_type"] == "response"]
    assert sorted({c["chunk_no"] for c in big}) == list(range(100)) and max(len(c["chunk"]) for c in chunks) <= 1000
    assert all(base64.b32encode(hashlib.sha1(b"x" * c["seen_bytes"]).digest()).decode() == c["seen_digest"] for c in big)
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_small_payloads_never_revisit(spark, pages):
    kinds = {(r["ident"], r["kind"]) for r in warc.label(pages, least=11).collect()}
    assert (1, "response") in kinds and (5, "response") in kinds


def test_archive_streams_in_bounded_memory(tmp_path):
    w = warc.ArchiveWriter(str(tmp_path), 1)
    block = bytes(range(256)) * 256
    payload = block * 480  # 30 MB
    w.add("response", 1, "u", base64.b32encode(hashlib.sha1(payload).digest()).decode(), None, memoryview(payload), "2000-01-01T00:00:00Z")
    w.close()
    size = len(payload)
    del payload
    tracemalloc.start()
    total = sum(len(r["chunk"]) for r in warc.records(w.path, chunk=1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == size and peak < 3 << 20


def test_damage_is_seen(tmp_path):
    w = warc.ArchiveWriter(str(tmp_path), 1)
    with pytest.raises(ValueError):
        w.add("response", 1, "u", "A" * 32, None, memoryview(b"abc"), "d")
    v = warc.ArchiveWriter(str(tmp_path), 1)
    v.add("response", 2, "u", digest("abc"), None, memoryview(b"abc"), "d")
    v.close()
    bad = gzip.decompress(open(v.path, "rb").read()).replace(b"abc", b"abd")
    with open(v.path, "wb") as f:
        f.write(gzip.compress(bad))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(v.path))
