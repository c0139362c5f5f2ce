"""Substring dedup: winnowed anchors as seeds, extended both ways to the repeats of other documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import (
    fields, map_batches, packed_text, run_hashes, span_hashes, stored, text_slices, unpacked, words_of_many,
)
from cohortlake.llm.registry import query, table

#: Least repeat in words, and words of an anchor.
LEAST_WORDS, ANCHOR_WORDS = 13, 5
#: Bytes of packed texts that a step of a task unpacks.
PACKED_BYTES = 1 << 18

LONG, INT = T.LongType(), T.IntegerType()
RUNS = fields(anchor=LONG, content=LONG, key=LONG, start=INT, windows=INT)


def anchored_runs(hashes: np.ndarray, begin: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Windows of ``least`` words in runs that share an anchor: ``(anchor, content, text, start, windows)``.

    The anchor of a window is its smallest hash of ``anchor`` words, the first
    of equal ones, so equal windows have equal anchors at equal places. The
    content is the hash of all words that the run's windows cover.
    """
    empty = np.empty(0, np.int64)
    count = len(hashes) - least + 1
    if count <= 0:
        return (empty,) * 5
    grams = run_hashes(hashes, anchor)
    best, place = grams[:count].copy(), np.arange(count)
    for j in range(1, least - anchor + 1):
        other = grams[j : j + count]
        smaller = other < best
        best[smaller] = other[smaller]
        place[smaller] = np.flatnonzero(smaller) + j
    left = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(hashes))
    inside = np.flatnonzero(left[:count] >= least)  # windows that do not reach into the next text
    if not len(inside):
        return (empty,) * 5
    at = place[inside]
    first = np.flatnonzero(np.r_[True, (np.diff(inside) != 1) | (np.diff(at) != 0)])
    windows = np.diff(np.r_[first, len(inside)])
    start = inside[first]
    content = span_hashes(hashes, start, start + windows + least - 1)
    text = np.searchsorted(begin, start, "right") - 1
    return grams[at[first]].view(np.int64), content.view(np.int64), text, start - begin[text], windows


def runs(docs: DataFrame, key: str, text: str, least: int, anchor: int) -> DataFrame:
    """All anchored runs of all documents that have a key and a text."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, texts in text_slices(batch, 1):
            hashes, begin = words_of_many(texts)
            anchors, content, which, start, windows = anchored_runs(hashes, begin, least, anchor)
            yield {"anchor": anchors, "content": content, "key": np.asarray(part.column(0))[which],
                   "start": start.astype(np.int32), "windows": windows.astype(np.int32)}

    usable = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(
        "key is not null and text is not null")
    return map_batches(usable, RUNS, run)


SPANS = "array<struct<start:int,windows:int,content:bigint,anchor:bigint>>"


def by_document(spans: DataFrame) -> DataFrame:
    """``(_of, spans)``: one row per document; a list is bounded by the length of its document."""
    return spans.groupBy(F.col("key").alias("_of")).agg(
        F.collect_list(F.struct("start", "windows", "content", "anchor")).alias("spans"))


def split_spans(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row bounds and flat arrays of a list of span structs; null is an empty list."""
    lengths = np.array([x or 0 for x in pc.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten()
    return np.r_[0, np.cumsum(lengths)], [np.asarray(flat.field(n)) for n in ("start", "windows", "content", "anchor")]


def holding(hashes: np.ndarray, start: np.ndarray, windows: np.ndarray, content: np.ndarray, least: int) -> np.ndarray:
    """Which spans the text really has where they say: rows that share a key may have different texts."""
    end = start + windows + least - 1
    fits = end <= len(hashes)
    fits[fits] = span_hashes(hashes, start[fits], end[fits]).view(np.int64) == content[fits]
    return fits


WINDOWS = fields(anchor=LONG, content=LONG, key=LONG, start=INT)


def single_windows(packed: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """The windows of some runs one by one, from the texts of their documents."""
    joined = packed.join(by_document(spans), F.col("key") == F.col("_of")).select("key", "packed", "spans")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        bounds, (start, windows, content, anchor) = split_spans(batch.column(2))
        for i, key in enumerate(keys):
            hashes, _ = words_of_many(unpacked([texts[i].as_py()]))
            own = slice(bounds[i], bounds[i + 1])
            ok = holding(hashes, start[own], windows[own], content[own], least)
            s, w, a = start[own][ok], windows[own][ok], anchor[own][ok]
            at = np.repeat(s, w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            yield {"anchor": np.repeat(a, w), "content": span_hashes(hashes, at, at + least).view(np.int64),
                   "key": np.full(len(at), key), "start": at.astype(np.int32)}

    return map_batches(joined, WINDOWS, gathered(run))


def gathered(run):
    """Join the small outputs of a batch into one."""

    def all_of(batch: pa.RecordBatch) -> Iterator[dict]:
        parts = list(run(batch))
        if parts:
            yield {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    return all_of


def repeats(docs: DataFrame, packed: DataFrame, key: str, text: str, least: int, anchor: int) -> DataFrame:
    """Spans ``(key, start, windows, content, anchor)`` whose windows also start in a document of a smaller key.

    1. Seeds: anchors that more than one run has. Tasks count before the
       shuffle, so a passage that all documents share is one row per task.
    2. The runs of the seeds, by a join that adaptive execution can split.
    3. Runs with equal content are extended together: all but those of the
       first document repeat it in full. A group of copies is one row from
       here on, whatever its size, and no pairs are formed.
    4. Where an anchor has several contents, repeats end inside a run. The
       first document of each content stands for it, and its windows are
       compared one by one with those of the other contents.
    """
    found = runs(docs, key, text, least, anchor)
    seeds = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor"), "seeds")
    hits = stored(found.join(seeds, "anchor"), "hits")
    contents = stored(hits.groupBy("anchor", "content").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("_n")), "contents")
    # written before the join, so that an anchor with very many contents is split among tasks there
    kinds = stored(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1"), "kinds")
    useful = stored(
        contents.join(kinds, "anchor", "left").where("_n > 1 or _kinds is not null")
        .select("anchor", "content", "first", F.col("_kinds").isNotNull().alias("several")), "useful")
    marks = stored(
        hits.join(useful, ["anchor", "content"])
        .where(F.col("key") > F.col("first")).select("key", "start", "windows", "content", "anchor"), "whole")
    leading = (
        hits.join(useful.where("several"), ["anchor", "content"])
        .where(F.col("key") == F.col("first")).select("key", "start", "windows", "content", "anchor"))
    singles = stored(single_windows(packed, leading, least), "windows")
    earliest = stored(
        singles.groupBy("anchor", "content").agg(F.min("key").alias("first"), F.max("key").alias("_last"))
        .where("_last > first").select("anchor", "content", "first"), "earliest")
    later = singles.join(earliest, ["anchor", "content"]).where(F.col("key") > F.col("first")).select(
        "key", "start", F.lit(1).alias("windows"), "content", "anchor")
    return marks.unionByName(later)


def removed_words(hashes: np.ndarray, start: np.ndarray, windows: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of covered words, as ``[start, end)``."""
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + windows + least - 1, -1)
    covered = np.r_[0, (np.cumsum(change[:-1]) > 0).astype(np.int8), 0]
    edges = np.diff(covered)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def kept_words(keys: pa.Array, texts: list, spans: pa.Array, key: str, least: int) -> dict:
    """The result columns of some documents."""
    bounds, (start, windows, content, _) = split_spans(spans)
    n_words, n_removed, cuts, kept = [], [], [], []
    for i, t in enumerate(texts):
        words, cut = (t or b"").split(), []
        if bounds[i + 1] > bounds[i]:
            own = slice(bounds[i], bounds[i + 1])
            hashes, _ = words_of_many([t or b""])
            ok = holding(hashes, start[own], windows[own], content[own], least)
            cut = removed_words(hashes, start[own][ok], windows[own][ok], least)
        rest, at = [], 0
        for a, b in cut:
            rest += words[at:a]
            at = b
        rest += words[at:]
        n_words.append(len(words))
        n_removed.append(len(words) - len(rest))
        cuts.append([{"start": a, "end": b} for a, b in cut])
        kept.append(b" ".join(rest))
    return {key: keys, "n_words": n_words, "n_removed": n_removed, "spans": cuts,
            "kept": pa.array(kept, pa.binary()).cast(pa.string())}


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS,
                    anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``(key, n_words, n_removed, spans, kept)`` of every document.

    A word goes if a window of ``least`` words covers it whose words also
    start in a document with a smaller key; windows are judged on the input.
    ``spans`` are the maximal removed runs of words, ``kept`` the other words
    joined by one space. Null texts have no words. Documents without a key
    are not compared. Rows that share a key are not compared with each other;
    repeated rows fare alike. Long texts are compared whole. An empty table
    gives an empty result; further columns are not read.
    """
    packed = packed_text(docs.where(F.col(key).isNotNull()), key, text, [])
    found = by_document(repeats(docs, packed, key, text, least, anchor))
    kind = docs.schema[key].dataType
    with_key = packed.join(found, F.col("key") == F.col("_of"), "left").select("key", "packed", "spans")
    without = packed_text(docs.where(F.col(key).isNull()), key, text, []).withColumn("spans", F.lit(None).cast(SPANS))
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.StringType()),
    ])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, texts in text_slices(batch, 1, PACKED_BYTES):
            yield kept_words(part.column(0), unpacked(texts), part.column(2), key, least)

    return map_batches(with_key.unionByName(without), schema, run)


@query(r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (g) WHERE doc_id > f),
left_over AS (
  SELECT x.r, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) x ANTI JOIN gone g ON x.r = g.r AND x.p = g.p
  GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
