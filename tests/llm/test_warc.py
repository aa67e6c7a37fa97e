import glob
import gzip
import hashlib
import io
import re
import time

import duckdb

from ledgerloom.llm import warc as W
from ledgerloom.llm.common import scratch

from ..conftest import DATA


def member(i, payload=b"x" * 200):
    return W._packed(W.record(i, f"http://a/{i}", payload, len(payload), hashlib.sha256(payload).hexdigest(), None))


def test_query_equals_sql(spark):
    from ledgerloom.llm.catalog import SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = set(con.sql(f"SELECT {', '.join(names)} FROM ({SQL['op8_warc']})").fetchall())
    assert {tuple(r[c] for c in names) for r in W.op8_warc(spark, DATA).collect()} == want


def test_salvage():
    m = [member(i) for i in range(5)]
    broken = bytearray(m[2])
    broken[len(broken) // 2] ^= 0xFF
    data = m[0] + b"noise" + m[1] + bytes(broken) + m[3] + m[4][:-9]
    got = list(W.salvage(io.BytesIO(data)))
    good = [x[2]["warc-record-id"] for x in got if x[3] is not None]
    gaps = [(a, n) for a, n, _, block in got if block is None]
    assert good == [f"<urn:x-page:{i}>" for i in (0, 1, 3)]
    assert gaps[0] == (len(m[0]), 5) and gaps[1] == (len(m[0]) + 5 + len(m[1]), len(broken)) and gaps[2][0] + gaps[2][1] == len(data)
    assert sum(n for _, n, *_ in got) == len(data)


def test_plain_archives_and_a_false_length():
    plain = b"".join(gzip.decompress(member(i)) for i in range(3))
    assert [x[2]["warc-record-id"][-2] for x in W.salvage(io.BytesIO(plain))] == ["0", "1", "2"]
    one = gzip.decompress(member(0)).replace(b"Content-Length: 2", b"Content-Length: 9", 1)
    got = list(W.salvage(io.BytesIO(one + plain)))
    assert [x[2]["warc-record-id"][-2] for x in got if x[3] is not None][-3:] == ["0", "1", "2"] and got[0][3] is None
    assert list(W.salvage(io.BytesIO(b""))) == [] and [x[3] for x in W.salvage(io.BytesIO(b"nothing here"))] == [None]


def ids(got):
    return [x[2]["warc-record-id"][12:-1] for x in got if x[3] is not None]


def test_blocks_of_any_size_pass(monkeypatch):
    """Nothing is refused for its size: with all bounds lowered, digests and sizes still come, payloads up to KEEP."""
    monkeypatch.setattr(W, "KEEP", 1000)
    monkeypatch.setattr(W, "_PIECE", 512)
    big = bytes(range(256)) * 2000
    long_url = W.record(3, "http://a/" + "u" * 3_000_000, b"y" * 200, 200, hashlib.sha256(b"y" * 200).hexdigest(), None)
    plain = gzip.decompress(member(1, big)) + long_url + gzip.decompress(member(2))
    for data in (plain, member(1, big) + W._packed(long_url) + member(2)):
        got = list(W.salvage(io.BytesIO(data)))
        assert ids(got) == ["1", "3", "2"] and sum(x[1] for x in got) == len(data)
        assert [(x[3].payload_bytes, x[3].payload_digest) for x in got][0] == (len(big), hashlib.sha256(big).hexdigest())
        assert got[0][3].payload is None and got[2][3].payload == b"x" * 200


def test_a_quoted_record_is_not_invented():
    quoted = gzip.decompress(member(999))
    bad = bytearray(gzip.decompress(member(1, b"<pre>" + quoted + b"</pre>" + b"z" * 300)))
    bad[-20] ^= 1  # inside the payload, so the block digest fails; the length is sound
    plain = gzip.decompress(member(0)) + bytes(bad) + gzip.decompress(member(2))
    got = list(W.salvage(io.BytesIO(plain)))
    assert ids(got) == ["0", "2"] and [x[:2] for x in got if x[3] is None] == [(len(gzip.decompress(member(0))), len(bad))]


def test_members_of_many_records():
    plain = [gzip.decompress(member(i)) for i in range(4)]
    bad = bytearray(plain[1])
    bad[-20] ^= 1
    data = W._packed(plain[0] + bytes(bad) + plain[2]) + member(3)
    got = list(W.salvage(io.BytesIO(data)))
    assert ids(got) == ["0", "2", "3"] and sum(x[1] for x in got) == len(data) and [x[2] for x in got if x[3] is None] == ["block digest differs"]


def test_sha1_digests_and_lengths_that_lie():
    import base64

    one = gzip.decompress(member(0))
    block = one.partition(b"\r\n\r\n")[2][:-4]
    sha1 = base64.b32encode(hashlib.sha1(block).digest())
    good = re.sub(rb"WARC-Block-Digest: [^\r]*", b"WARC-Block-Digest: sha1:" + sha1, one)
    rest = gzip.decompress(member(1)) + gzip.decompress(member(2))
    assert ids(W.salvage(io.BytesIO(good + rest))) == ["0", "1", "2"]
    assert ids(W.salvage(io.BytesIO(good.replace(b"xxx", b"xyx", 1) + rest))) == ["1", "2"]
    for had in (good, re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", one)):
        longer = had.replace(b"Content-Length: 2", b"Content-Length: 5", 1)  # would swallow the next record
        assert ids(W.salvage(io.BytesIO(longer + rest)))[-2:] == ["1", "2"]


def test_false_signs_are_linear():
    noise = (b"\x1f\x8b\x08\x00" + b"n" * 246 + b"WARC/1.1\r\n" + b"m" * 240) * 4000
    data = member(0) + noise + member(1)
    began = time.perf_counter()
    got = list(W.salvage(io.BytesIO(data)))
    assert ids(got) == ["0", "1"] and sum(x[1] for x in got) == len(data)
    assert time.perf_counter() - began < 1


def test_revisits_edges_and_files(spark):
    big, small = "<p>" + "é" * 300, "tiny"
    rows = [(5, "u", big, "z"), (3, "u", big, "z"), (9, None, big, "z"), (1, "u", small, "z"), (2, "u", small, "z"), (4, "a b\r\nc", None, "z"), (None, "u", big, "z"), (3, "u", big, "z"), (6, "u", "", "z"), (7, "u", "w" * 3_000_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    where = scratch(spark, "warc-test")
    made = W.write(W.plan(df), where)
    assert made.agg({"records": "sum"}).first()[0] == len(rows)
    assert not glob.glob(where.removeprefix("file://") + "/.[0-9]*")
    back = W.read_archives(made).collect()
    got = sorted((r["record_id"][12:-1], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back)
    n = len(big.encode())
    assert ("3", "response", None, n) in got and ("5", "revisit", "<urn:x-page:3>", n) in got and ("9", "revisit", "<urn:x-page:3>", n) in got
    assert ("1", "response", None, 4) in got and ("4", "response", None, 0) in got and ("null", "response", None, n) in got
    assert all(r["gap"] is None for r in back) and {r["payload"].decode() for r in back if r["payload"]} >= {big, small}
    empty = W.write(W.plan(df.where("page_id = 99")), scratch(spark, "warc-test"))
    assert W.read_archives(empty).count() == 0


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", "page" * 50 + str(i % 4)) for i in range(40)], "page_id long, url string, html string")
    want = {(r["page_id"], r["refers_to"]) for r in W.plan(df).collect()}
    monkeypatch.setattr(W, "GROUPS", 0)
    assert {(r["page_id"], r["refers_to"]) for r in W.plan(df).collect()} == want and (7, 3) in want and (3, None) in want
