import gzip
import hashlib

from arbora.llm import warc
from arbora.llm.common import new_path

SCHEMA = "page_id long, url string, html string, id string, doc long"
TEXT = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 9
ROWS = [
    (3, "http://a/ b\r\nc", "x" * 100), (1, None, "x" * 100), (2, "", "x" * 99), (9, "u", "x" * 99),
    (4, "http://é", None), (5, "u", ""), (6, "u", TEXT), (7, "u", "é" * 5000), (8, "u", "é" * 5000),
    (10, "u", "y" * 300), (10, "u", "z" * 300), (None, "u", "q" * 200), (11, "u", "q" * 200),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)


def test_round_trip_with_segments(spark):
    got = warc.round_trip(pages(spark), segment_bytes=64).collect()
    want = []
    first = {}
    for page, _, html in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and payload in first
        digest = hashlib.sha256(payload).hexdigest()
        want.append((page, len(payload), digest, "revisit" if revisit else "response", first.get(payload) if revisit else None, None))
        first.setdefault(payload, page)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_payloads_come_back(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(pages(spark), path, segment_bytes=100, file_records=3)
    got = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert got[6] == TEXT.encode() and got[7] == ("é" * 5000).encode() and got[4] == b""


def test_empty(spark):
    assert warc.round_trip(pages(spark, []).limit(0)).count() == 0


def test_damage_is_reported(spark):
    block = warc.HEAD + warc.chunked(b"p" * 200)
    whole = len(block)
    digest = hashlib.sha256(b"p" * 200).hexdigest()
    parts = lambda key, cuts, total: [
        ("response" if n == 1 else "continuation", f"{key}" if n == 1 else f"{key}:{n}", 1, "u", digest, None,
         None if n == 1 else key, n, total if n == max(cuts) else None, block[(n - 1) * 60 : n * 60])
        for n in cuts
    ]
    last = -(-whole // 60)
    rows = parts("ok", range(1, last + 1), whole)
    rows += [r for r in parts("gap", range(1, last + 1), whole) if r[7] != 2]
    rows += parts("size", range(1, last + 1), whole + 1) + parts("head", range(2, last + 1), whole)
    got = warc.reassembled(spark.createDataFrame(rows, warc.PARSED)).collect()
    found = {r["id"]: r["problem"] for r in got}
    assert found["ok"] is None and "missing" in found["gap"] and "length" in found["size"] and "missing" in found[None]


def test_framing():
    for n in (0, 1, 4096, 10_000):
        assert warc.unchunked(warc.chunked(b"a" * n)) == b"a" * n
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    one = warc.record([(b"WARC-Type", b"response")], b"b\r\nb") + b"\r\n"
    assert [b for _, b in warc.split_records(one * 2)] == [b"b\r\nb"] * 2
    assert gzip.decompress(gzip.compress(one)) == one
