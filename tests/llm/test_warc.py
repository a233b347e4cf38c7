import base64
import gzip
import hashlib
import io
import random
from collections import defaultdict

import pytest

from stratagrid.llm import shared, warc

SCHEMA = "page_id bigint, url string, html string"


def pages(rng):
    big = "<p>" + "x" * 40_000 + "é" * 30
    rows = [(i, f"http://h/{i}", "<b>" + str(rng.random()) * rng.randint(1, 3000)) for i in range(12)]
    rows += [(20, "http://h/20", big), (21, "http://h/21", big), (19, "http://h/19", big), (30, None, None), (31, "u\r\nv", ""), (32, "http://h/32", None), (40, "http://h/40", "same"), (40, "http://h/40", "same"), (41, "http://h/41", "same")]
    return rows


def brute(rows):
    by = defaultdict(list)
    for i, _, t in rows:
        by[(t or "").encode()].append(i)
    out = []
    for raw, ids in by.items():
        digest, top, first = base64.b32encode(hashlib.sha1(raw).digest()).decode(), max(ids), True
        for i in ids:
            lead = i == top and first
            first = first and not lead
            out.append((i, len(raw), digest, "response" if lead else "revisit", None if lead else top))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "2 AS n", "3 AS payload")
    folder = warc.write(df, shared.new_folder(spark, "warc"), segment=3000)
    assert any("/more-" in r.path for r in spark.read.parquet(f"{folder}/files").collect())
    got = warc.read(spark, folder).select(warc.page_of("record_id").alias("p"), "payload_bytes", "digest", "record_type", warc.page_of("refers_id").alias("r"), "problem", "record_id").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert all(r.problem is None for r in got) and len({r.record_id for r in got}) == len(rows)


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "xxxx"), (4, "d", "xxxx"), (5, "e", None)], SCHEMA)
    got = warc.read(spark, warc.write(df, shared.new_folder(spark, "warc"), least=3)).collect()
    assert sorted((r.payload_bytes, r.record_type) for r in got) == [(0, "response"), (1, "response"), (1, "response"), (4, "response"), (4, "revisit")]


def test_empty_table(spark):
    assert warc.read(spark, warc.write(spark.createDataFrame([], SCHEMA), shared.new_folder(spark, "warc"))).collect() == []


def read_bytes(spark, tmp_path, content):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(content)
    return warc.records(spark.createDataFrame([(f"file://{path}", len(content))], warc.FILES)).collect()


def put(spark, tmp_path, records):
    return {r.record_id: r for r in read_bytes(spark, tmp_path, b"".join(map(gzip.compress, records)))}


def whole(n, body=b"abc", **more):
    return warc.response(f"urn:page:{n}:h:0", "u", body, 10**6)[0]


def test_several_records_in_a_member_and_plain_files(spark, tmp_path):
    for content in (gzip.compress(whole(1) + whole(2) + whole(3)), whole(1) + whole(2) + whole(3), gzip.compress(whole(1)) + gzip.compress(whole(2) + whole(3))):
        got = read_bytes(spark, tmp_path, content)
        assert sorted((r.record_id, r.payload_bytes, r.problem) for r in got) == [(f"urn:page:{n}:h:0", 3, None) for n in (1, 2, 3)]


def test_malformed_archives_give_problems(spark, tmp_path):
    pack = gzip.compress
    good = pack(whole(9))
    no_digest = b"\r\n".join(x for x in whole(1, b"z" * 1000).split(b"\r\n") if not x.startswith(b"WARC-Payload-Digest"))
    cases = {
        b"garbage": "header",
        b"": None,
        b"\x1f\x8b\x08garbage": "damaged",
        pack(b"garbage\r\n\r\n"): "no record",
        pack(whole(1, b"z" * 900))[:-30]: "damaged",
        pack(no_digest[:-300]): "shorter",
        pack(whole(1).replace(b"Content-Length: ", b"Content-Length: x")): "length is no number",
        pack(whole(1).replace(b"WARC-Date", b"WARC-Segment-Number: one\r\nWARC-Date")): "no number",
        pack(whole(1).replace(b"3\r\nabc", b"-\r\nabc")): "hexadecimal",
        pack(warc.record("response", "urn:page:1:h:0", [], b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc")): "differs from its length",
    }
    for content, problem in cases.items():
        got = read_bytes(spark, tmp_path, content)
        assert (got == []) if problem is None else (len(got) == 1 and problem in got[0].problem and got[0].digest is None), (content, got)
        # what follows in members of its own is read
        if content:
            got = {r.record_id: r for r in read_bytes(spark, tmp_path, good + content + pack(whole(8)))}
            assert got["urn:page:9:h:0"].problem is None and (got["urn:page:8:h:0"].problem is None)


def test_other_types(spark, tmp_path):
    got = put(spark, tmp_path, [warc.record("warcinfo", "urn:i", [], b"software: x\r\n"), whole(1)])
    assert (got["urn:i"].record_type, got["urn:i"].payload_bytes, got["urn:i"].problem) == ("warcinfo", 13, None)


def test_large_files_are_read_in_time(tmp_path):
    content = b"".join(gzip.compress(whole(i, b"%d" % i * 50)) for i in range(20_000))
    began = __import__("time").perf_counter()
    assert sum(p is None for _, _, p in warc.parse(io.BytesIO(content))) == 20_000
    assert __import__("time").perf_counter() - began < 20


def test_segments_out_of_order_and_broken(spark, tmp_path):
    first, rest = warc.response("urn:page:1:h:0", "u", b"z" * 500, 100)
    f2, r2 = warc.response("urn:page:2:h:0", "u", b"y" * 500, 100)
    f3, r3 = warc.response("urn:page:3:h:0", "u", b"w" * 500, 100)
    got = put(spark, tmp_path, [*reversed(rest), f2, *r2[:1], *r2[2:], first, *r3[:-1], f3])
    assert (got["urn:page:1:h:0"].payload_bytes, got["urn:page:1:h:0"].problem) == (500, None)
    assert "missing" in got["urn:page:2:h:0"].problem and got["urn:page:2:h:0"].digest is None
    assert "total length" in got["urn:page:3:h:0"].problem


def test_bad_digest_is_a_problem(spark, tmp_path):
    got = put(spark, tmp_path, [whole(1).replace(b"abc", b"abd")])
    assert "digest" in got["urn:page:1:h:0"].problem


def test_chunked_framing():
    for raw in (b"", b"a", b"b" * 4096, b"c" * 10_001):
        assert warc.unchunked(warc.chunked(raw)) == raw
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc", b"3\r\nabc\r\n-6\r\n", b"3\r\nabc\r\n0x0\r\n", b"+3\r\nabc\r\n0\r\n\r\n", b"fffffffffff\r\nabc"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
