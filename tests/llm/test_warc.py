import base64
import gzip
import hashlib
import io
import os

import pytest

from folio.llm import warc
from folio.llm.common import shared_folder
from folio.llm.queries import QUERIES

PAGES = "page_id bigint, url string, html string"


def pages(spark, rows, clash=False):
    if clash:
        return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], PAGES + ", page int, digest int, payload int")
    return spark.createDataFrame(rows, PAGES)


def result(df):
    return sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.first) for r in df.select(
        warc.page_of(df.metadata).alias("page"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(df.referred.metadata).alias("first")).collect()), key=str)


def brute(rows):
    least = {}
    for p, _, html in rows:
        key = (p is None, p)
        html = html or ""
        least[html] = min(least.get(html, key), key)
    out = []
    for p, _, html in rows:
        data = (html or "").encode()
        none, first = least[html or ""]
        revisit = not none and p != first
        out.append((None if p is None else str(p), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", str(first) if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, df, **options):
    folder = shared_folder(spark, "warc-test")
    warc.write_archives(df, folder, **options)
    return warc.read_records(spark, folder), folder


ODD = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (None, "http://a/n", "same"), (3, None, None), (4, "http://a/4", ""),
       (5, "http://a/5", "WARC/1.1\r\nContent-Length: 9\r\n\r\nx\r\n\r\nWARC/1.1\r\n"), (6, "http://a/\r\nevil: 1", "\r\n\r\n\r\n\r\n"),
       (7, "http://ü/7", "Ünï 中文 \0 nul \x85"), (7, "http://ü/7", "Ünï 中文 \0 nul \x85"), (8, "http://b", "long " * 400_000),
       (-9, "http://b", "long " * 400_000), (None, None, "lone"), (7, "http://other", "another of page 7")]


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_odd_rows(spark, compression):
    records, _ = round_trip(spark, pages(spark, ODD, clash=True), compression=compression)
    assert records.where("error is not null").count() == 0 and records.count() == 3 * len(ODD)
    assert result(warc.captures(records)) == brute(ODD)


def test_payloads_come_back(spark):
    records, _ = round_trip(spark, pages(spark, ODD))
    got = sorted((bytes(r.payload) for r in warc.captures(records).where("record_type = 'response'").select("payload").collect()))
    revisits = {(2, "same"), (None, "same"), (8, "long " * 400_000), (4, "")}
    assert got == sorted((h or "").encode() for p, _, h in ODD if (p, h) not in revisits)


def test_empty_table(spark):
    records, _ = round_trip(spark, pages(spark, [], clash=True))
    assert records.count() == 0 and warc.captures(records).count() == 0


def test_least_bytes_of_a_revisit(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = warc.captures(round_trip(spark, pages(spark, rows), min_bytes=3)[0])
    assert [(r[0], r[3]) for r in result(got)] == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def record(kind, rid, block=b"", *fields):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, *fields, b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(spark, name, data):
    folder = shared_folder(spark, "warc-files").removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)
    return folder


def test_transactions_in_any_direction_and_members(spark):
    http = b"Content-Type: application/http; msgtype=response"
    each = [record(b"warcinfo", b"<i>", b"software: x"),
            record(b"response", b"<r1>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", http, b"WARC-Concurrent-To: <q1>"),
            record(b"request", b"<q1>", b"GET /"), record(b"metadata", b"<m1>", b"a: 1", b"WARC-Concurrent-To:\r\n\t<q1>"),
            record(b"metadata", b"<m2>", b"b: 2", b"warc-concurrent-to: <r1>"),
            record(b"metadata", b"<lost>", b"c: 3", b"WARC-Concurrent-To: <nobody>"),
            record(b"resource", b"<r2>", b"raw")]
    folder = write(spark, "a.warc.gz", b"".join(gzip.compress(x) for x in each))
    records = warc.read_records(spark, folder)
    got = {r.record_id: r for r in warc.captures(records).collect()}
    assert set(got) == {"<r1>", "<r2>"} and bytes(got["<r1>"].payload) == b"body" and got["<r2>"].payload_bytes == 3
    assert [x.record_id for x in got["<r1>"].requests] == ["<q1>"]
    assert [x.record_id for x in got["<r1>"].metadata] == ["<m1>", "<m2>"] and got["<r2>"].metadata == []


def test_broken_archives_are_told(spark):
    good = record(b"resource", b"<x>", b"1")
    data = b"junk\r\n" + good + record(b"resource", b"<y>", b"2").replace(b"Content-Length: 1", b"Content-Length: z") + good[:-5]
    rows = warc.read_records(spark, write(spark, "b.warc", data)).collect()
    assert [r.error for r in rows] == ["4 bytes outside records", None, "no length", "1 bytes outside records", "cut short"]


def test_parse_folds_long_fields():
    fields, block, error = next(warc.parse(io.BytesIO(b"WARC/1.0\r\nA: b\r\n c\r\nContent-Length: 2\r\n\r\nxy")))
    assert fields == [("a", "b c"), ("content-length", "2")] and block == b"xy" and error is None
    assert list(warc.parse(io.BytesIO(b"\r\n\r\n"))) == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in QUERIES["op13_warc"](spark, sf).collect()), key=str)
    assert got == brute(rows)
