"""WARC: records written as archives, and read back by verifying the chain of record boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import map_batches, stored
from cohortlake.llm.registry import query, table
from cohortlake.session import shared_folder

MAGIC = "WARC/1.1\r\n"
#: What a revisit record says of its relation to the response.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What ends a header and what follows a record.
HEADER_END, RECORD_END = "\r\n\r\n", "\r\n\r\n"
#: Payloads from this size on are written once.
LEAST_REVISIT = 100
#: Bytes of a file whose chain one task follows.
SEGMENT_BYTES = 64 << 20


# ---- writing

def first_holders(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``(_digest, _first)`` of the payloads that several pages hold: one row per repeated payload."""
    return stored(
        pages.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _first is not null").drop("_n"),
        "payloads",
    )


def records(pages: DataFrame, key: str, url: str, payload: str, fetched: Column | None = None) -> DataFrame:
    """The text of one record per row, without the line breaks after it. ``fetched`` is when the page was, else now.

    The payloads stay where they are unless the table of repeated payloads is
    too large to be sent around.
    """
    rows = pages.select(
        F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
        F.coalesce(*([fetched.cast("timestamp")] if fetched is not None else []), F.current_timestamp()).alias("fetched"),
    ).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn(
        "digest", F.sha2(F.col("payload").cast("binary"), 256)
    )
    holders = first_holders(rows.select("page_id", "bytes", "digest"))
    known = rows.join(holders, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= LEAST_REVISIT), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    utc = F.date_format(F.to_utc_timestamp("fetched", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), utc),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("_first").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return known.select(F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(HEADER_END), body).alias("value"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
               fetched: Column | None = None) -> None:
    """Write one record per page; each task writes one archive.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, the one with
    the smallest key is the response and the others revisit it. Null payloads
    are empty, null urls and keys are written as nothing. Repeated rows, also
    of the same key, give records of their own: copies of the response's row
    are responses too. A payload is one record, however long. An empty table
    writes an empty archive; further columns are not read.
    """
    records(pages, key, url, payload, fetched).write.option("lineSep", RECORD_END).text(path)


# ---- reading

CHUNK = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("place", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("head", T.StringType()), T.StructField("head_size", T.LongType()),
    T.StructField("content", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("ends", T.BooleanType()),
    T.StructField("chunk", T.BinaryType()),
])


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic, whether it begins a record or stands in a payload.

    Spark splits the files as it likes; each row is what follows a magic up to
    the next one, with its file, its block and its place in the block. A file
    that does not begin with the magic has no reachable record.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("bytes"),
    )


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records: header, sizes and, where the content ends inside the chunk, its digest; the digest of each chunk."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {f.name: [] for f in CHUNK}
        for file, block, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            end = data.find(HEADER_END.encode())
            head = data[:end].decode("utf-8", "replace") if end >= 0 else None
            length = header_value(head, "content-length") if head is not None else None
            content = int(length) if length is not None and length.isascii() and length.isdigit() and len(length) < 16 else None
            start = end + len(HEADER_END)
            body = data[start : start + content] if content is not None else b""
            whole = content is not None and len(body) == content
            row = (file, block, place, len(data), head if content is not None else None, start if end >= 0 else None,
                   content, hashlib.sha256(body).hexdigest() if whole else None,
                   whole and data[start + content :] == RECORD_END.encode(), hashlib.sha256(data).digest())
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        yield out

    return map_batches(chunks(spark, path), CHUNK, run)


def header_value(head: str, name: str) -> str | None:
    for line in head.split("\r\n"):
        field, colon, value = line.partition(":")
        if colon and field.strip().lower() == name:
            return value.strip()
    return None


def with_offsets(rows: DataFrame) -> DataFrame:
    """Adds ``at``, the offset in its file of the magic before each chunk.

    Sums run inside a block, whose size Spark bounds, and over one row per
    block of a file. The first chunk of a file stands before any magic, so a
    chunk begins one magic after the sum of the chunks and magics before it.
    """
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("size") + len(MAGIC)
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("_bytes"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_base"))
    local = rows.withColumn("_in", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    return local.join(bases, ["file", "block"]).withColumn("at", F.col("_base") + F.col("_in") - len(MAGIC)).drop("_base", "_in")


LINKS = "file string, segment long, at long, next long"


def exits(group: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a segment the first successor outside it, by pointer jumping inside the segment."""
    at = group["at"].to_numpy()
    order = np.argsort(at)
    at, to = at[order], group["next"].to_numpy()[order]
    here = np.searchsorted(at, to).clip(max=len(at) - 1)
    known = at[here] == to
    step = np.where(known, here, np.arange(len(at)))
    while True:  # each round doubles the jump
        further = step[step]
        if (further == step).all():
            break
        step = further
    return pd.DataFrame({"file": group["file"].iloc[0], "segment": group["segment"].iloc[0], "at": at, "next": to[step]})


def followed(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a segment on the chain from where the file's chain enters it."""
    at = group["at"].to_numpy()
    order = np.argsort(at)
    at, to, entry = at[order], group["next"].to_numpy()[order], group["entry"].to_numpy()[order]
    here = np.searchsorted(at, to).clip(max=len(at) - 1)
    step = np.where(at[here] == to, here, np.arange(len(at)))
    reached = entry.astype(bool)
    while True:  # the reached set doubles with the jump
        more = reached.copy()
        more[step[reached]] = True
        further = step[step]
        if (more == reached).all() and (further == step).all():
            break
        reached, step = more, further
    return pd.DataFrame({"file": group["file"].iloc[0], "segment": group["segment"].iloc[0], "at": at[reached],
                         "next": to[reached]})


def chain(candidates: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``(file, at, next)`` of the candidates reachable from the start of their file.

    ``candidates`` has file, at and next. A task follows pointers inside a
    segment of a file, by offset, so a group is bounded however large a file
    is; pointer jumping over the exits of segments, doubling each round, finds
    where the chain of a long file enters each of its segments.
    """
    links = stored(candidates.withColumn("segment", F.floor(F.col("at") / segment_bytes).cast("long")).select(
        "file", "segment", "at", "next"), "links")
    most = links.agg(F.max("segment")).first()[0] or 0
    entries = links.where("at = 0").select("file", F.col("at").alias("start"))
    if most:
        jump = stored(links.groupBy("file", "segment").applyInPandas(exits, LINKS).select("file", "at", "next"), "exits")
        for _ in range(int(most).bit_length()):
            there = jump.withColumnsRenamed({"at": "_at", "next": "_next"})
            more = entries.join(there, (entries["file"] == there["file"]) & (F.col("start") == F.col("_at"))).select(
                entries["file"], F.col("_next").alias("start"))
            entries = stored(entries.union(more).distinct(), "entries")
            twice = jump.alias("a").join(there.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b._at")), "left")
            jump = stored(twice.select("a.file", "a.at", F.coalesce("b._next", "a.next").alias("next")), "exits")
    start = entries.withColumn("_entry", F.lit(True))
    marked = links.alias("l").join(
        start.alias("s"), (F.col("l.file") == F.col("s.file")) & (F.col("l.at") == F.col("s.start")), "left"
    ).select("l.file", "l.segment", "l.at", "l.next", F.coalesce("s._entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "segment").applyInPandas(followed, LINKS).select("file", "at", "next")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, head, sha256, content)`` of every true record.

    A record is true if the chain of Content-Lengths from the start of its
    file reaches it; a magic inside a payload is not on that chain. A record
    whose payload holds a magic was cut, and is put together again from its
    pieces in a second pass over the archives. Files without a magic at their
    start have no true record, and empty archives none at all. Repeated
    records are records of their own. A record is one row, however long.
    """
    # stored first: blocks and places are those of one read
    rows = stored(with_offsets(stored(parsed(spark, path), "parsed")), "chunks")
    jump = F.col("at") + len(MAGIC) + F.col("head_size") + F.col("content") + len(RECORD_END)
    candidates = rows.where("content is not null and at >= 0").select("file", "at", jump.alias("next"))
    reached = stored(chain(candidates), "chain")
    true = rows.join(reached, ["file", "at"])
    whole = true.where("ends").select("file", "at", "head", "sha256", "content")
    cut = stored(true.where("not ends").select("file", "at", "next", "head", "head_size", "content"), "cut")
    if cut.isEmpty():
        return whole
    return whole.union(joined_pieces(spark, path, rows, cut))


def joined_pieces(spark: SparkSession, path: str, rows: DataFrame, cut: DataFrame) -> DataFrame:
    """The records that hold a magic: the pieces from their offset to their successor's, in order.

    Which record a piece belongs to comes from a running maximum of offsets
    inside a segment of the file; a record that began in an earlier segment is
    listed there once for each segment it reaches. The bytes are found by their
    digest: Spark may split the files otherwise when they are read again, so
    block and place do not carry over. A piece that is not found is an error.
    """
    first = F.floor(F.col("at") / SEGMENT_BYTES)
    last = F.floor((F.col("next") - 1) / SEGMENT_BYTES)
    spread = cut.select("file", F.explode(F.sequence(first, last)).alias("segment"), F.col("at").alias("start"),
                        F.col("next").alias("stop"))
    pieces = rows.select("file", "at", "chunk", F.floor(F.col("at") / SEGMENT_BYTES).alias("segment"))
    # records come before pieces at the same offset
    lined = spread.select("file", "segment", F.greatest("start", F.col("segment") * SEGMENT_BYTES).alias("at"), "start", "stop",
                          F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("chunk")).union(
        pieces.select("file", "segment", "at", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1), "chunk"))
    upto = Window.partitionBy("file", "segment").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == 0, F.struct("start", "stop")), ignorenulls=True).over(upto)
    wanted = stored(
        lined.withColumn("_owner", owner).where("kind = 1 and at < _owner.stop")
        .select("file", "at", "chunk", F.col("_owner.start").alias("start")), "pieces")
    again = chunks(spark, path).select(F.unhex(F.sha2("bytes", 256)).alias("chunk"), "bytes")
    found = again.join(wanted.select("chunk").distinct(), "chunk", "left_semi").groupBy("chunk").agg(F.first("bytes").alias("bytes"))
    texts = wanted.join(found, "chunk", "left").withColumn(
        "bytes", F.coalesce("bytes", F.raise_error(F.concat(F.lit("no bytes of a piece of "), F.col("file")))))
    lists = texts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("p"))
    heads = cut.withColumnRenamed("at", "start")
    # bytes between magics, the magics put back; a record is one row, as it was when it was written
    parts = F.transform("p", lambda x, i: F.when(i == 0, x["bytes"]).otherwise(F.concat(F.lit(MAGIC).cast("binary"), x["bytes"])))
    joined = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x))
    body = joined.substr(F.col("head_size").cast("int") + 1, F.col("content").cast("int"))
    return lists.join(heads, ["file", "start"]).select(
        "file", F.col("start").alias("at"), "head", F.sha2(body, 256).alias("sha256"), "content"
    )


def header(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def page_records(found: DataFrame) -> DataFrame:
    """What the records say of their pages; revisits take length and digest of the payload from their header.

    A record without a page in its id has a null ``page_id``; a header that is
    missing gives null. Repeated records give repeated rows, none give none.
    """
    page = lambda name: F.regexp_extract(header(name), r"<urn:page:(-?[0-9]+)>", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    kind = header("WARC-Type")
    stated = F.regexp_extract(header("WARC-Payload-Digest"), r"sha256:([0-9a-f]{64})", 1)
    return found.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        F.when(kind == "revisit", header("X-Payload-Length").cast("long")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(kind == "revisit", stated).otherwise(F.col("sha256")).alias("payload_digest"),
        kind.alias("record_type"), number(page("WARC-Refers-To")).alias("refers_to"),
    )


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path))
