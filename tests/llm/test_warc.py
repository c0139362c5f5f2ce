import hashlib
import re
from collections import Counter

import pytest

from cohortlake.llm import warc
from cohortlake.llm.common import stored
from cohortlake.session import shared_folder
from tests.oracle import connect, differences

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def by_hand(rows):
    first = {}
    for k, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and k is not None:
            first[b] = min(k, first.get(b, k))
    n = Counter((h or "").encode() for _, h in rows)
    out = Counter()
    for k, h in rows:
        b = (h or "").encode()
        to = first.get(b) if n[b] > 1 else None
        revisit = to is not None and to != k
        out[k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    return out


@pytest.fixture
def archive(spark):
    import uuid

    def make(rows, parts):
        path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        df = spark.createDataFrame([(k, f"http://x.y/{k}\r\nA: b", h, "z") for k, h in rows], "page_id long, url string, html string, digest string")
        warc.write_warc(df.repartition(parts), path)
        return path

    return make


ROWS = [(1, None), (2, ""), (3, "short"), (4, "x" * 100), (5, "x" * 100), (5, "x" * 100), (6, "x" * 99), (7, "x" * 99), (-8, "é" * 90), (9, "é" * 90),
        (None, "y" * 200), (None, "z"), (10, "a" + FAKE + "b"), (11, FAKE), (12, FAKE * 30), (13, "WARC/1.1\r\n"), (14, "\r\n\r\nWARC/1.1\r\n\r\n\r\n"),
        (15, "long " * 100_000 + FAKE), (16, "a\nb\rc\x00d"), (17, FAKE + "WARC/1.1\r\nContent-Length: 99999999\r\n\r\nq" + FAKE), (18, "WARC/1.1"), (19, "W" * 7)]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_records_come_back(spark, archive, split):
    rows = [*ROWS, *[(100 + i, f"page {i % 60} " * (i % 30)) for i in range(200)]]
    path = archive(rows, 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split if split == "128m" else "20000b")
    try:
        out = warc.page_records(warc.read_warc(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert Counter(map(tuple, out)) == by_hand(rows)


def test_chain_over_segments(spark):
    true = [(f"f{f}", 10 * i, 10 * (i + 1)) for f in range(3) for i in range(200)]
    false = [("f0", 10 * i + 5, 10 * i + 17) for i in range(150)] + [("f1", 10 * i + 3, 10 * i + 13) for i in range(150)] + [("f9", 5, 9)]
    df = spark.createDataFrame(true + false, "file string, at long, next long")
    for segment in (25, 64, 1 << 26):
        assert {tuple(r) for r in warc.chain(df, segment).collect()} == set(true)


def test_small_segments_join_pieces(spark, archive, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 300)
    rows = [(1, "q" * 50), (2, FAKE * 9 + "tail"), (3, FAKE), (4, "w" * 500)]
    assert Counter(map(tuple, warc.page_records(warc.read_warc(spark, archive(rows, 1))).collect())) == by_hand(rows)


def test_second_read_may_split_the_files_otherwise(spark, archive, monkeypatch):
    joined, before = warc.joined_pieces, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def later(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
        return stored(joined(*args), "test")

    monkeypatch.setattr(warc, "joined_pieces", later)
    path = archive(ROWS, 1)
    try:
        out = warc.page_records(warc.read_warc(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert Counter(map(tuple, out)) == by_hand(ROWS)


def test_records_say_when_and_what_they_are(spark, tmp_path):
    """A date on every record, and on revisits what they are of."""
    from pyspark.sql import functions as F

    rows = [(1, "http://a/", "p" * 200, "2024-05-06 07:08:09"), (2, "http://b/", "p" * 200, None), (3, None, None, "2024-01-01 00:00:00")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at string")
    warc.write_warc(pages, f"{tmp_path}/w", fetched=F.to_timestamp("at"))
    heads = {r.head.split("<urn:page:")[1].split(">")[0]: r.head for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert "WARC-Date: 2024-05-06T07:08:09Z" in heads["1"] and "WARC-Profile" not in heads["1"]
    assert re.search(r"WARC-Date: 20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", heads["2"]) and f"WARC-Profile: {warc.REVISIT_PROFILE}" in heads["2"]
    assert "WARC-Date: 2024-01-01T00:00:00Z" in heads["3"]


def test_empty_table(spark, archive):
    path = archive([(1, "a")], 1) + "-none"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(empty, path)
    assert warc.page_records(warc.read_warc(spark, path)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    from cohortlake.llm.registry import ORACLES

    assert differences(warc.op6_warc(spark, sf_dir), connect(sf_dir), ORACLES["op6_warc"]) == []
