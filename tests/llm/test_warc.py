import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from seriesframe.llm import warc as W


def round_trip(spark, tmp_path, rows, schema="page_id long, url string, html string, block string", **options):
    pages = spark.createDataFrame(rows, schema).repartition(3)
    W.write(W.records(pages, **options), f"{tmp_path}/w", records_per_file=3)
    return W.read_archives(spark, f"{tmp_path}/w").collect()


def brute(rows, least=100):
    first = {}
    for r in rows:
        body = (r[2] or "").encode()
        if len(body) >= least and r[0] is not None:
            first[body] = min(first.get(body, r[0]), r[0])
    out = []
    for r in rows:
        body = (r[2] or "").encode()
        owner = first.get(body)
        revisit = owner is not None and owner != r[0]
        out.append((r[0], len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/\r\nX: y", "<p>é" * 50, "x"), (2, "http://a/", "<p>é" * 50, None), (9, None, "<p>é" * 50, "z"), (3, "u", "short", "b"), (4, "u", "short", "b"),
    (7, "u", None, "b"), (8, "u", "", "b"), (10, "u", "WARC/1.1\r\n\r\n0\r\n\r\nContent-Length: 3\r\n\r\n" * 40, "b"),
    (11, "u", "né \U0001f600" * 3000, "b"), (11, "u", "né \U0001f600" * 3000, "b"), (None, "u", "<p>é" * 50, "n"), (12, "u", "\r\n\r\n", None)]


@pytest.mark.parametrize("segment, chunk", [(64, 7), (1000, 300), (1 << 20, 4096)])
def test_round_trip(spark, tmp_path, segment, chunk):
    got = round_trip(spark, tmp_path, ROWS, segment_bytes=segment, chunk_bytes=chunk)
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(ROWS)
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    for f in glob.glob(f"{tmp_path}/w/*.gz"):
        data = gzip.open(f).read()
        assert all(len(b) <= segment for _, b in W._cut(data)) and sum(1 for _ in W._cut(data)) <= 3


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, tmp_path, []) == []


def test_damage_is_an_error(spark):
    recs = spark.createDataFrame([(1, "r", "response", 1, None, None, "d", b"ab"), (1, "r", "continuation", 3, 4, None, "d", b"cd")], W.RECORDS)
    with pytest.raises(Exception, match="segments missing"):
        W.reassemble(recs).collect()
    with pytest.raises(ValueError):
        W.dechunk(b"5\r\nab\r\n0\r\n\r\n")


def test_segment_order(spark):
    recs = spark.createDataFrame([(None, "r", "continuation", 2, 4, None, "d", b"cd"), (1, "r", "response", 1, None, None, "d", b"ab")], W.RECORDS)
    assert [bytes(r.block) for r in W.reassemble(recs).collect()] == [b"abcd"]
    assert W.reassemble(recs.where(F.lit(False))).count() == 0
