import base64
import gzip
import hashlib
import zlib

import pytest

from quarrylight.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
PAGES = [
    (4, "http://a.example/", "<p>one</p>", "x"), (2, "http://b.example/\r\nX: y", "<p>one</p>", "x"), (9, None, "<p>one</p>", "x"),
    (7, "http://c.example/", None, "x"), (8, "http://d.example/", "", "x"), (1, "http://e.example/", "ü\r\n\r\nWARC/1.1\r\n", "x"),
    (3, "u", "z" * 3_000_000, "x"), (None, "v", "<p>one</p>", "x"), (2, "http://b.example/", "<p>one</p>", "x"), (None, "w", "only here", "x"),
]


def naive(pages, least=0):
    out = []
    for p, _, html, _ in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min((q for q, _, h, _ in pages if (h or "") == (html or "") and q is not None), default=None)
        again = len(data) >= least and p != first
        out.append((p, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def tuples(index):
    return sorted(
        (tuple(r) for r in index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str
    )


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_of_odd_pages(spark, least):
    frame = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    assert tuples(warc.archived_pages(frame, revisit_bytes=least)) == naive(PAGES, least)


def test_index_reads_single_records(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, SCHEMA).coalesce(1)
    warc.write_monolithic(frame, f"{tmp_path}/whole", records_per_file=4)
    whole = sorted((tmp_path / "whole").glob("*.gz"))
    assert len(whole) == 3
    for path in whole:  # one stream each
        stream = zlib.decompressobj(31)
        stream.decompress(path.read_bytes())
        assert stream.eof and not stream.unused_data
    index = warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/out")
    rows = index.collect()
    archives = {p.parent.name.split("=")[1]: p.read_bytes() for p in (tmp_path / "out" / "archives").rglob("part-*")}
    assert len(archives) == 3 and len(rows) == len(PAGES)
    text = {}
    for r in rows:
        record = zlib.decompress(archives[r["archive"]][r["offset"] : r["offset"] + r["length"]], 31)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and r["record_id"].encode() in record
        text[(r["archive"], r["offset"])] = record
    # members are one after the other without a gap, in the order of the stream
    for name, data in archives.items():
        own = sorted((r["offset"], r["length"]) for r in rows if r["archive"] == name)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert gzip.decompress(data) == b"".join(text[(name, o)] for o, _ in own)
    assert b"".join(gzip.decompress(p.read_bytes()) for p in whole) == b"".join(gzip.decompress(archives[p.name.split(".")[0]]) for p in whole)
    wanted = index.where("page_id = 1")
    read = warc.read_records(spark, f"{tmp_path}/out", wanted).collect()
    assert len(read) == 1 and "ü\r\n\r\nWARC/1.1\r\n".encode() in bytes(read[0]["record"])


def test_long_member_is_padded():
    record = b"WARC/1.1\r\n" + b"a" * (1 << 24)
    packed = warc.member(record)
    assert packed[-1] == 0 and zlib.decompress(packed[:-1], 31) == record
    assert [(o, n, r) for o, n, r in warc._walk(memoryview(packed + warc.member(b"b")))] == [(0, len(packed) - 1, record), (len(packed), len(warc.member(b"b")), b"b")]


def test_streams_are_inflated_in_chunks(monkeypatch):
    data = bytes(range(256)) * 3000
    monkeypatch.setattr(warc, "CHUNK", 1000)
    chunks = list(warc._inflated(gzip.compress(data)))
    assert b"".join(chunks) == data and max(map(len, chunks)) <= 1000
    assert b"".join(warc._inflated(gzip.compress(b"a") + gzip.compress(data))) == b"a" + data
    with pytest.raises(ValueError):
        list(warc._inflated(gzip.compress(data)[:-20]))


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0
