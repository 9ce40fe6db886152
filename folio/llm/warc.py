"""WARC archives: written from a table of pages, read back, and assembled into captures.

``write_archives`` writes a request, a response (or revisit) and a metadata record
for each page with Spark's text writer: a record is a row and the blank line that
ends a record is the line separator, so commits and retries are Spark's own.

``read_records`` reads any WARC files, plain or gzip, one file after the other within
a task and one record at a time, into flat rows.

``captures`` assembles transactions: side records (requests, metadata) meet the
record that holds the payload through ``WARC-Concurrent-To``, in either direction
and over further side records, and every capture becomes one nested row. A
revisit meets the response it refers to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import col
from folio.session import bounded_broadcast, cut_lineage

#: Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HOLDERS = ("response", "revisit", "resource")
SIDES = ("request", "metadata")

#: Payload bytes that a reading task hands on at once.
BYTES_AT_ONCE = 4_000_000
RECORD = ("path string, record_id string, type string, concurrent_to array<string>, target_uri string, date string, "
          "refers_to string, declared_digest string, http_head string, payload_bytes bigint, payload_digest string, "
          "fields string, payload binary, error string")


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a column's bytes: 20 bits of the hex digest give four letters."""
    def letters(hexed: Column) -> Column:
        bits = lambda i: F.conv(F.substring(hexed, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        at = lambda i: F.floor(bits(i) / F.element_at(F.array(*map(F.lit, (1 << 15, 1 << 10, 1 << 5, 1))), i % 4 + 1)) % 32
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(BASE32), at(i).cast("int") + 1, F.lit(1))), "")
    # In an array, so that the digest is taken once.
    return F.get(F.transform(F.array(F.sha1(data)), letters), F.lit(0))


def _urn(kind: str, *parts: Column) -> Column:
    """A record id from what the record is about: the same after a retry."""
    named = F.to_json(F.struct(F.lit(kind).alias("kind"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]))
    return F.regexp_replace(F.md5(named), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(fields: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """A record without the blank line that ends it; a null field is left out."""
    lines = [F.lit(VERSION + "\r\n")]
    for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("\r\n"), block)


def first_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page, uri, bytes, digest, check)`` of which several are equal -> one row a payload, with the
    least page id (null last) and of its rows the least address. Counted by payload with partial sums."""
    alike = pages.where(F.col("bytes") >= min_bytes).groupBy("digest", "check", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page").isNull().alias("none"), "page", "uri")).alias("first"))
    return alike.where("n > 1").select("digest", "check", "bytes", F.col("first.page").alias("first_page"),
                                       F.col("first.uri").alias("first_uri"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   date: str = "2000-01-01T00:00:00Z", min_bytes: int = 0, compression: str | None = None) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``pages`` below ``path``.

    The payload is the text in UTF-8; null is empty. Of rows with equal payloads of at least ``min_bytes``
    bytes, those with the smallest id (null last) are responses and the others revisits of it; repeated
    rows share their id and so are all responses, or all revisits. A null id or address is left out of
    the records; line ends in an address are percent-encoded. An empty table writes no record. Further
    columns are not read. ``compression="gzip"`` makes each file one gzip member.
    """
    payload = F.coalesce(col(pages, html_col).cast("string"), F.lit(""))
    uri = F.replace(F.replace(col(pages, url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(col(pages, id_col).alias("page"), uri.alias("uri"), F.octet_length(payload).alias("bytes"),
                        base32_sha1(payload).alias("digest"), F.xxhash64(payload).alias("check"), payload.alias("payload"))
    firsts = cut_lineage(first_captures(rows.drop("payload"), min_bytes))
    rows = rows.join(bounded_broadcast(firsts), ["digest", "check", "bytes"], "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("page").eqNullSafe(F.col("first_page"))
    rows = rows.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    own = _urn("capture", F.col("page"), F.col("uri"), F.col("digest"))
    said = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("uri"))]
    held = _record([("WARC-Type", F.expr("if(revisit, 'revisit', 'response')")), ("WARC-Record-ID", own), *common,
                    ("WARC-Payload-Digest", said), ("WARC-Profile", F.expr(f"if(revisit, '{SAME_PAYLOAD}', null)")),
                    ("WARC-Refers-To", F.when(F.col("revisit"), _urn("capture", F.col("first_page"), F.col("first_uri"), F.col("digest")))),
                    ("Content-Type", "application/http; msgtype=response")],
                   F.concat(head, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))))
    asked = F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", F.col("page"), F.col("uri"), F.col("digest"))),
                       ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")], asked)
    known = F.coalesce(F.concat(F.lit("page_id: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", F.col("page"), F.col("uri"), F.col("digest"))),
                        ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/warc-fields")], known)
    out = rows.select(F.explode(F.array(request, held, metadata)).alias("value")).write.option("lineSep", "\r\n\r\n")
    (out.option("compression", compression) if compression else out).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """(header fields, block, error) of each record; what is no record is skipped to the next one and told as an error."""
    lost = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            lost += len(line.strip())
            continue
        if lost:
            yield [], b"", f"{lost} bytes outside records"
            lost = 0
        fields: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}".strip())
            else:
                name, _, value = text.partition(":")
                fields.append((name.strip().lower(), value.strip()))
        size = dict(fields).get("content-length", "")
        if not re.fullmatch("[0-9]+", size):
            yield fields, b"", "no length"
            continue
        block = stream.read(int(size))
        yield fields, block, None if len(block) == int(size) else "cut short"
    if lost:
        yield [], b"", f"{lost} bytes outside records"


def _row(path: str, fields: list[tuple[str, str]], block: bytes, error: str | None, payload: bool) -> tuple:
    one = dict(reversed(fields))
    kind = one.get("warc-type", "").lower() or None
    http = one.get("content-type", "").lower().startswith("application/http")
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    digest = re.sub("^sha1:", "", one["warc-payload-digest"]) if "warc-payload-digest" in one else None
    full = kind in ("response", "resource")
    return (path, one.get("warc-record-id"), kind, [v for k, v in fields if k == "warc-concurrent-to"],
            one.get("warc-target-uri"), one.get("warc-date"), one.get("warc-refers-to"), digest,
            head.decode("utf-8", "replace") if http else None, len(body) if full else None,
            base64.b32encode(hashlib.sha1(body).digest()).decode() if full else None,
            block.decode("utf-8", "replace") if kind == "metadata" else None, body if full and payload else None, error)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One flat row (``RECORD``) for every record of the archives below ``path``.

    Digest and length are computed from the payload that was read. A file on a mounted file system is
    streamed, others come through Spark's reader whole. Bytes outside records, a record without a length
    and one cut short give rows with ``error``; ``payload=False`` leaves the payload out.
    """
    names = [f.split(":")[0] for f in RECORD.replace(", ", ",").split(",")]
    names = [n.split(" ")[0] for n in names]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                raw = io.BufferedReader(io.BytesIO(content)) if content is not None else open(re.sub("^file:/+", "/", name), "rb")  # noqa: SIM115
                with raw, gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw as stream:
                    rows, size = [], 0
                    for fields, block, error in parse(stream):
                        rows.append(_row(name, fields, block, error, payload))
                        size += len(block)
                        if size > BYTES_AT_ONCE:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path)
    here = F.col("path").startswith("file:")
    local = files.select("path", F.lit(None).cast("binary").alias("content")).where(here)
    far = files.select("path", "content").where(~here)
    mounted = path.startswith("file:") or path.startswith("/")
    return (local if mounted else far).mapInPandas(read, RECORD)


def _sides(records: DataFrame) -> DataFrame:
    """``(side, holder)``: each request and metadata record with the record that holds its capture's payload.

    A side record names it, or is named by it, or names a side record that has one: the last is repeated
    until no further record finds its holder."""
    of = lambda kinds: records.where(F.col("type").isin(*kinds) & F.col("record_id").isNotNull())
    holders = of(HOLDERS).select(F.col("record_id").alias("holder")).distinct()
    sides = of(SIDES).select("record_id").distinct()
    named = of(SIDES).select(F.col("record_id").alias("side"), F.explode("concurrent_to").alias("to")).distinct()
    naming = of(HOLDERS).select(F.explode("concurrent_to").alias("side"), F.col("record_id").alias("holder")).distinct()
    found = cut_lineage(named.join(holders, F.col("to") == F.col("holder")).select("side", "holder").unionByName(
        naming.join(sides, F.col("side") == F.col("record_id"), "left_semi")).groupBy("side").agg(F.min("holder").alias("holder")))
    # Undirected among side records: a request that a metadata record names, or the other way round.
    between = named.join(sides, F.col("to") == F.col("record_id"), "left_semi")
    between = between.unionByName(between.select(F.col("to").alias("side"), F.col("side").alias("to"))).distinct()
    between = cut_lineage(between.join(found, "side", "left_anti"))
    while not between.isEmpty():
        more = cut_lineage(between.join(found.withColumnRenamed("side", "to"), "to").groupBy("side").agg(F.min("holder").alias("holder")))
        if more.isEmpty():
            break
        found = found.unionByName(more)
        between = cut_lineage(between.join(more, "side", "left_anti"))
    return found


def captures(records: DataFrame) -> DataFrame:
    """One nested row for every record that holds a payload or revisits one.

    ``(record_id, record_type, target_uri, date, http_head, payload_digest, payload_bytes, payload, refers_to,
    referred, requests, metadata)``: digest and length of a revisit are those of the response it refers to, as
    read, else the digest it declares and no length; ``requests`` and ``metadata`` are arrays, empty where a
    capture has none. Repeated records are captures of their own that share their side records; equal side
    records count once. A record without an id has no side records. No records give no rows.
    """
    records = cut_lineage(records.where("error is null"))
    members = _sides(records)
    side = records.where(F.col("type").isin(*SIDES)).withColumnRenamed("record_id", "side").join(members, "side")
    gather = lambda kind, *cols: F.sort_array(F.collect_set(F.when(F.col("type") == kind, F.struct(
        F.col("side").alias("record_id"), *cols))))
    side = side.groupBy("holder").agg(gather("request", "date", "http_head").alias("requests"),
                                      gather("metadata", "date", "fields").alias("metadata"))
    held = records.where(F.col("type").isin(*HOLDERS)).join(
        side, F.col("record_id") == F.col("holder"), "left")
    said = records.where("type = 'response' and record_id is not null").join(side, F.col("record_id") == F.col("holder"), "left") \
        .select(F.col("record_id").alias("said_id"), F.struct("payload_digest", "payload_bytes", "target_uri", "date", "metadata").alias("referred"))
    # Only responses that a revisit refers to, each once.
    asked = records.where("type = 'revisit' and refers_to is not null").select(F.col("refers_to").alias("said_id")).distinct()
    said = said.join(asked, "said_id", "left_semi").groupBy("said_id").agg(F.min("referred").alias("referred"))
    held = held.join(said, (F.col("refers_to") == F.col("said_id")) & (F.col("type") == "revisit"), "left")
    none = lambda name: F.coalesce(name, F.array().cast(side.schema[name].dataType)).alias(name)
    return held.select("record_id", F.col("type").alias("record_type"), "target_uri", "date", "http_head",
                       F.coalesce("payload_digest", "referred.payload_digest", "declared_digest").alias("payload_digest"),
                       F.coalesce("payload_bytes", "referred.payload_bytes").alias("payload_bytes"), "payload", "refers_to",
                       "referred", none("requests"), none("metadata"))


def page_of(metadata: Column) -> Column:
    """The page id that ``write_archives`` put into a capture's metadata; null if it has none."""
    return F.regexp_extract(F.get(F.filter(metadata, lambda m: m["fields"].rlike("^page_id: ")), F.lit(0))["fields"],
                            "^page_id: (.*?)\\r\\n", 1)
