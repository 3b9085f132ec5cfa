"""WARC archives: write pages as records, reassemble segmented records on reading.

Writing. Each page is one record; equal payloads of at least ``min_revisit``
bytes are stored once, under the smallest page id, and the others are
``revisit`` records that refer to it. A response block is an HTTP response
with chunked transfer framing. A block longer than ``segment_bytes`` is split:
the first segment is a ``response`` record with ``WARC-Segment-Number: 1``,
the others are ``continuation`` records that carry the origin's id, and the
last one the total length. Archives are gzip files written by Spark's text
sink, whose line separator is the record terminator; ``records_per_file``
times ``segment_bytes`` bounds an archive's size, and segments of one record
may lie in different archives.

Reading. Archives are read as binary files and cut into records by their
``Content-Length`` in Arrow batches. Only segmented records are shuffled: they
are grouped by origin id, ordered by segment number and checked against the
total length. Then chunked framing is decoded and payload digests verified; a
record that fails is an error, as the archive is then damaged.

Defined results: a null html is an empty payload. Rows that repeat a page id
are records of their own; rows that share the smallest page id of a payload
are all responses. Null page ids are written as an empty id, come back as null
and are never referred to.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.llm.common import read
from seriesframe.session import scratch_path

CRLF = "\r\n"
RECORDS = "page_id long, record string, kind string, seq int, total long, refers_to long, digest string, block binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _bytes(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p.encode()) for p in parts])


def _utf8(c: Column) -> Column:
    return F.encode(c.cast("string"), "UTF-8")


def chunked(body: Column, chunk_bytes: int) -> Column:
    """Binary column in HTTP/1.1 chunked transfer framing."""
    n = F.ceil(F.octet_length(body) / chunk_bytes).cast("int")
    pieces = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                         lambda i: F.substring(body, i * chunk_bytes + 1, chunk_bytes))
    # bytes pass through strings unchanged, and strings can be joined without copying each time
    size = lambda p: F.lower(F.conv(F.octet_length(p).cast("string"), 10, 16))
    lines = F.transform(pieces, lambda p: F.concat(size(p), F.lit(CRLF), p.cast("string"), F.lit(CRLF)))
    return F.concat(F.array_join(lines, ""), F.lit("0" + CRLF * 2)).cast("binary")


def records(pages: DataFrame, min_revisit: int = 100, segment_bytes: int = 16384, chunk_bytes: int = 4096,
            date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row for each WARC record: ``record`` is its header and block, without the terminator."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    mine = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    # who holds a payload first: narrow rows, combined before the shuffle
    facts = pages.select("page_id", F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("digest"))
    first = (facts.where(F.col("n") >= min_revisit).groupBy("digest")
             .agg(F.min("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1"))
    named = mine.withColumn("digest", F.sha2("payload", 256))
    held = (facts.where(F.col("n") >= min_revisit).join(first, "digest")
            .groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.min("owner").alias("owner")))
    rows = named.join(held, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    other = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(other, F.col("owner")).alias("refers_to"))
    return _rendered(rows, segment_bytes, chunk_bytes, date)


def _rendered(rows: DataFrame, segment_bytes: int, chunk_bytes: int, date: str) -> DataFrame:
    is_revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")
    http = F.when(is_revisit, _bytes("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", _utf8(size), "\r\n\r\n")) \
        .otherwise(_bytes("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n", chunked(F.col("payload"), chunk_bytes)))
    rows = rows.withColumn("uid", F.uuid()).withColumn("block", http)
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("block") / segment_bytes)).cast("int")
    parts = rows.withColumn("segments", n).withColumn("total", F.octet_length("block")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("segments"))).alias("seq"))
    part = F.when(F.col("segments") == 1, F.col("block")).otherwise(
        F.substring(F.col("block"), (F.col("seq") - 1) * segment_bytes + 1, F.lit(segment_bytes)))
    kind = F.when(F.col("seq") > 1, "continuation").when(is_revisit, "revisit").otherwise("response")
    own = F.when(F.col("seq") == 1, F.col("uid")).otherwise(F.concat("uid", F.lit("-"), F.col("seq")))
    split = F.col("segments") > 1
    header = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), own, F.lit(">")),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(is_revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.when(split, F.concat(F.lit("WARC-Segment-Number: "), F.col("seq"))),
        F.when(F.col("seq") > 1, F.concat(F.lit("WARC-Segment-Origin-ID: <urn:uuid:"), F.col("uid"), F.lit(">"))),
        F.when(split & (F.col("seq") == F.col("segments")), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("part")))
    return parts.withColumn("part", part).select(
        _bytes(F.encode(header, "UTF-8"), "\r\n\r\n", F.col("part")).cast("string").alias("record"))


def write(recs: DataFrame, path: str, records_per_file: int = 2048) -> None:
    """Write records as gzip archives below ``path``."""
    recs.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _cut(data: bytes):
    """Records of one unpacked archive: header fields and block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8").split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in head[1:])}
        begin = end + 4
        at = begin + int(fields["content-length"])
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record cut short at byte {begin}")
        yield fields, data[begin:at]
        at += 4


def _unzip(content: bytes) -> bytes:
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def _uid(text: str) -> str:
    return text.removeprefix("<urn:uuid:").removesuffix(">")


def _number(text):
    return int(text) if text else None


def _parse(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for f, block in _cut(_unzip(content.as_py())):
                origin = _uid(f.get("warc-segment-origin-id", f["warc-record-id"]))
                rows.append({
                    "page_id": _number(f["x-page-id"]), "record": origin, "kind": f["warc-type"], "seq": _number(f.get("warc-segment-number")),
                    "total": _number(f.get("warc-segment-total-length")), "refers_to": _number(f.get("x-refers-to-page")),
                    "digest": f["warc-payload-digest"].removeprefix("sha256:"), "block": block})
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)


_RECORDS = pa.schema([("page_id", pa.int64()), ("record", pa.string()), ("kind", pa.string()), ("seq", pa.int32()), ("total", pa.int64()),
                      ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
_RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("payload", pa.binary())])


def dechunk(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; trailers are ignored."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = end + 2
        out.append(body[at:at + n])
        if len(out[-1]) < n or body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        at += n + 2


def _decode(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            head, _, body = r["block"].partition(b"\r\n\r\n")
            payload = None
            if r["kind"] == "revisit":
                n = int(re.search(rb"(?i)content-length: (\d+)", head)[1])
            else:
                payload = dechunk(body) if re.search(rb"(?i)transfer-encoding: chunked", head) else body
                n = len(payload)
                if hashlib.sha256(payload).hexdigest() != r["digest"]:
                    raise ValueError(f"payload of record {r['record']} does not have its digest")
            rows.append({"page_id": r["page_id"], "payload_bytes": n, "payload_digest": r["digest"], "record_type": r["kind"],
                         "refers_to": r["refers_to"], "payload": payload})
        yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)


def reassemble(recs: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, ordered by number, checked against the total length."""
    whole = recs.where("seq IS NULL")
    parts = F.sort_array(F.collect_list(F.struct("seq", "block")))
    first = lambda c: F.max(F.when(F.col("seq") == 1, F.col(c))).alias(c)
    grouped = (recs.where("seq IS NOT NULL").groupBy("record")
               .agg(*[first(c) for c in ("page_id", "kind", "refers_to", "digest")], F.max("total").alias("total"), parts.alias("parts")))
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    numbers = F.transform("parts", lambda p: p["seq"])
    joined = grouped.withColumn("block", block)
    good = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (F.octet_length("block") == F.col("total"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("segments missing or wrong total length: record "), F.col("record"))).cast("binary"))
    cols = ["page_id", "record", "kind", "refers_to", "digest", "block"]
    return whole.select(cols).unionByName(joined.withColumn("block", checked).select(cols))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``, with its decoded payload (null for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return reassemble(files.mapInArrow(_parse, RECORDS)).mapInArrow(_decode, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write(records(read(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).drop("payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END owner FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN owner <> page_id THEN owner END refers_to FROM f
"""
