"""Operator 3: WARC archives with a salvage reader.

Records are written by Spark's own writer, so they may go to any store that it
knows, and a lost executor's files are written again.  The reader checks each
record (version line, length, end mark, digest).  Where a check fails it looks
for the next gzip member or version line, goes on from there and logs the bytes
between as a quarantined gap.

Null payloads are written as empty ones.  Of records with equal payloads the
one with the largest page_id is the response and the others revisit it; rows
that repeat this page_id too are all responses, and null ids count as the
smallest.  Empty tables give empty archives.  A record is held in memory whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import new_path, stored, table

END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in a file, which is read in one piece; larger payloads get a file each.
RECORDS_PER_FILE, LARGE = 1000, 256_000
#: Repeated payloads (about 70 bytes each) that are sent to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 100_000
DATE = "2024-01-01T00:00:00Z"
FIELDS = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
SCHEMA = f"{FIELDS}, gap_start long, gap_end long, gap_reason string"


def base32(hex_digest):
    """Base32 of a hex digest column whose length is a multiple of five."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(ALPHABET), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Adds payload, payload_digest, payload_bytes and refers_to (null: a response)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"_sha1": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    # only payloads that occur again need their newest page; payloads themselves aren't shuffled while these are few
    again = p.filter(F.col("payload_bytes") >= at_least).groupBy("_sha1").agg(F.max("page_id").alias("_newest"), F.count("*").alias("n")).filter("n > 1").select("_sha1", "_newest")
    again = stored(again, "warc-repeated")
    p = p.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, "_sha1", "left")
    refers = F.when(F.col("_newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_newest")), F.col("_newest"))
    return p.select("page_id", "url", "payload", "payload_bytes", base32(F.col("_sha1")).alias("payload_digest"), refers.alias("refers_to"))


def records(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """``value``, each row's record up to its end mark, and ``large``: its payload has LARGE bytes or more."""
    p = revisits(pages, at_least)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(again, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    return p.withColumn("_block", block).select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name("refers_to"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("_block").cast("string"),
        F.lit(END), F.col("_block"),
    ).alias("value"), (F.col("payload_bytes") >= LARGE).alias("large"))


def write_archives(pages: DataFrame, path: str, at_least: int = 0) -> None:
    r = records(pages, at_least)
    r.filter(~F.col("large")).select("value").write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(f"{path}/small")
    if not pages.filter(F.octet_length("html") >= LARGE).isEmpty():
        r.filter("large").select("value").write.option("lineSep", END).option("maxRecordsPerFile", 1).text(f"{path}/large")


_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _record(data: bytes, at: int):
    """(fields, end) of the plain record at ``at``; raises ValueError where a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise ValueError("no version line")
    if (head_end := data.find(b"\r\n\r\n", at)) < 0:
        raise ValueError("header without end")
    head = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (size := head.get("content-length", "")).isdigit():
        raise ValueError("no content length")
    start = head_end + 4
    end = start + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no end mark where the length says")
    block = data[start:end]
    kind = head.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload differs from its digest")
    length = head.get("x-payload-length", "")
    size = len(payload) if kind != "revisit" else int(length) if length.isdigit() else None
    return (head.get("warc-record-id"), kind, head.get("warc-refers-to"), digest or None, size, payload if kind != "revisit" else None), end + 4


def _inflated(data: bytes, at: int, size: int = 1 << 16):
    """(bytes of the gzip member at ``at``, its end, None), or all bytes before an error, None and the error."""
    member, out = zlib.decompressobj(31), []
    while at < len(data) and not member.eof:
        before = member.copy()
        try:
            out.append(member.decompress(data[at : at + size]))
        except zlib.error as e:
            for k in range(at, at + size):  # the bytes before the bad one still count
                try:
                    out.append(before.decompress(data[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), None, str(e)[:80]
        at = min(at + size, len(data))
    return (b"".join(out), at - len(member.unused_data), None) if member.eof else (b"".join(out), None, "member without end")


def _inside(plain: bytes):
    """Records and gaps of a member's bytes, where no further member begins."""
    at, lost, reason = 0, None, ""
    while at < len(plain):
        try:
            fields, end = _record(plain, at)
        except ValueError as e:
            found = _VERSION.search(plain, at + 1)
            end = found.start() if found else len(plain)
            if lost is None:
                lost, reason = at, str(e)[:80]
        else:
            if lost is not None:
                yield "gap", (lost, at, reason)
                lost = None
            yield "record", fields
        at = end
    if lost is not None:
        yield "gap", (lost, len(plain), reason)


def salvage(data: bytes):
    """Yields ("record", fields) and ("gap", (start, end, reason)); bytes of ``data`` are all accounted for.

    A gap inside a gzip member has the member's limits and its own places in the reason.
    """
    at, lost, reason = 0, None, ""
    while at < len(data):
        got, error = [], None
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                plain, end, error = _inflated(data, at)
                got = list(_inside(plain))
                if error is None and got and all(kind == "gap" for kind, _ in got):
                    raise ValueError(got[0][1][2])
            else:
                fields, end = _record(data, at)
                got = [("record", fields)]
        except ValueError as e:
            got, error = [], str(e)[:80]
        good = [x for x in got if error is None or x[0] == "record"]
        if lost is not None and (error is None or good):
            yield "gap", (lost, at, reason)
            lost = None
        for kind, x in good:
            yield kind, x if kind == "record" else (at, end, f"inside a member, bytes {x[0]} to {x[1]}: {x[2]}")
        if error is not None:
            found = _NEXT.search(data, at + 1)
            end = found.start() if found else len(data)
            if lost is None:
                lost, reason = at, error
        at = end
    if lost is not None:
        yield "gap", (lost, len(data), reason)


def _salvaged(batches, payloads: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column("content"):
            rows = [(*x, None, None, None) if kind == "record" else (*[None] * 6, *x) for kind, x in salvage(content.as_py())]
            if not payloads:
                rows = [(*r[:5], None, *r[6:]) for r in rows]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files under ``path`` (gaps: gap_reason is set); without ``payloads`` these are checked only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(~F.col("path").rlike("/[_.][^/]*$")).select("content")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # a row is a file
    try:
        return stored(files.mapInArrow(partial(_salvaged, payloads=payloads), SCHEMA), "warc-records")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    write_archives(pages, path := new_path(spark, "warc"))
    read = read_archives(spark, path, payloads=False).filter(F.col("gap_reason").isNull())
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


_B32 = " || ".join(f"substr('{ALPHABET}', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT h, max(page_id) AS newest FROM p GROUP BY h)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM p JOIN n USING (h)
"""
