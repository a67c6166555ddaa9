import gzip
import hashlib
import io
import os
import random
import zlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, first long, at string, n int"


def slow(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        least = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        again = len(body) >= 100 and least is not None and (i is None or i > least)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", least if again else None))
    return out


def key(r):
    return r[0] is not None, r[0] or 0, r[2]


def check(spark, rows):
    df = spark.createDataFrame([(*r, 5, "a", 1) for r in rows], SCHEMA)
    got = warc.round_trip(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(slow(rows), key=key)


def test_pages(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    check(spark, rows)


def test_odd_pages(spark):
    long, nasty = "x" * 100, "WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    bodies = [None, "", "x" * 99, long, "é" * 50, "é" * 49, nasty, nasty + "\r\n\r\n", "\r\n\r\n" + nasty, "🙂" * 700_000, "\x00\x1f\x8b" * 60]
    rows = [(3 * i + j, f"http://e/{i}", x) for i, x in enumerate(bodies) for j in (2, 0, 1)]
    rows += [(None, None, long), (None, "u", "y" * 200), (None, "u", "y" * 200), (70, "a", "z" * 200), (70, "a", "z" * 200), (71, "b", "z" * 200), (-4, "bad\r\nWARC-Type: x\r\n\r\n", "q" * 300), (90, "  ", None), (5, "again", "q" * 300)]
    random.Random(1).shuffle(rows)
    check(spark, rows)
    check(spark, [])


def test_hot_payload(spark):
    rows = [(i, "u", "hot " * 60 if i % 3 else f"{i} " * 80) for i in range(3000)]
    check(spark, rows + [(5000 + i, "u", "") for i in range(500)])


def test_index_and_members(spark, tmp_path):
    """Every member opens alone at its offset, members fill their archive, and revisits get their payload back."""
    rows = [(i, f"http://e/{i % 7}", (f"page {i % 40} " * 30)) for i in range(200)]
    df = spark.createDataFrame([(*r, 5, "a", 1) for r in rows], SCHEMA).repartition(3)
    warc.write(df, f"{tmp_path}/whole")
    for d, _, names in os.walk(tmp_path / "whole"):
        for x in (f"{d}/{x}" for x in names if x.endswith(".gz")):
            member = zlib.decompressobj(31)
            member.decompress(open(x, "rb").read())
            assert member.eof and not member.unused_data  # one stream
    index = warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/records")
    by = {}
    for r in index.collect():
        by.setdefault(r.archive, []).append(r)
    for archive, found in by.items():
        data, at = open(archive, "rb").read(), 0
        for i, r in enumerate(sorted(found, key=lambda r: r.offset)):
            assert (r.record, r.offset) == (i, at)
            text = zlib.decompress(data[r.offset : r.offset + r.length], 31)
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and r.record_id.encode() in text and r.target_uri.encode() in text
            at += r.length
        assert at == len(data)
        whole = gzip.decompress(data)
        assert whole.count(b"WARC/1.1\r\n") == len(found)
    some = warc.read(index.where("record_id = '<urn:page:37>'"), payloads=True).collect()
    assert [r.payload.decode() for r in some] == [rows[37][2]]
    back = warc.resolved(warc.read(index, payloads=True)).collect()
    assert sorted((r.page_id, r.target_uri, r.payload.decode()) for r in back) == sorted(rows)
    again = warc.normalise(spark, f"{tmp_path}/records", f"{tmp_path}/twice")  # what is normal already stays as it is
    assert sorted((r.record_id, r.length) for r in again.collect()) == sorted((r.record_id, r.length) for r in index.collect())


def test_streams_are_cut_anywhere(monkeypatch):
    bodies = [b"", b"a\r\n\r\nb" * 9, b"WARC/1.0\r\n\r\n"]
    plain = b"".join(b"WARC/1.0\r\nWARC-Record-ID: <%d>\r\ncontent-LENGTH: %d\r\n\r\n%s\r\n\r\n" % (i, len(x), x) for i, x in enumerate(bodies))
    two = gzip.compress(plain) + gzip.compress(b"") + gzip.compress(plain)
    for chunk in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        got = [(f["warc-record-id"], b"".join(p).split(b"\r\n\r\n", 1)[1]) for f, p in warc.records(warc.inflated(io.BytesIO(two)))]
        assert got == [(f"<{i}>", x + b"\r\n\r\n") for _ in range(2) for i, x in enumerate(bodies)]
    for bad in (two[:-9], gzip.compress(plain[:-9]), gzip.compress(b"HTTP/1.1 200\r\n\r\n"), gzip.compress(plain[:30])):
        with pytest.raises((ValueError, KeyError)):
            for _, p in warc.records(warc.inflated(io.BytesIO(bad))):
                b"".join(p)
