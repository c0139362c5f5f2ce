"""Benchmark decontamination: a broadcast set of test n-grams, scanned over every word window."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import U64, map_batches, mixed, run_hashes, stored, text_back, text_slices, without_text
from cohortlake.llm.registry import query, table

WINDOW = 10
#: Words of benchmark items that one broadcast set holds: about 100 MB while it is built and 25 MB in a task.
#: More items are scanned in several rounds.
MOST_ITEM_WORDS = 250_000

#: A-Z lower-cased; digits, a-z and bytes from 0x80 stand for themselves; all else separates words.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def folded_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class ItemWindows:
    """The windows of a bounded set of items, looked up by hash and checked word by word.

    A window stands once, with the list of the items that hold it.
    """

    def __init__(self, items: list[tuple[object, bytes]], width: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in folded_words(t)], np.int64)
                 for _, t in items]
        #: Per size: hashes of the windows in order, their words, and the number of the first one.
        self.sets: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        self.owners: list[np.ndarray] = []
        for size in sorted({min(len(w), width) for w in words if len(w)}):
            mine = [i for i, w in enumerate(words) if min(len(w), width) == size]
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(words[i], size) for i in mine])
            owner = np.repeat(mine, [len(words[i]) - size + 1 for i in mine])
            window, place = np.unique(rows, axis=0, return_inverse=True)
            held = np.unique(np.stack([place.ravel(), owner]), axis=1)  # by window, then by item
            begin = np.searchsorted(held[0], np.arange(len(window) + 1))
            hashes = window_hashes(window)
            order = np.argsort(hashes, kind="stable")
            self.sets.append((size, hashes[order], window[order], len(self.owners)))
            self.owners += [held[1, begin[i] : begin[i + 1]] for i in order.tolist()]

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, width, window)`` of every occurrence in a row of word numbers; 0 is an unknown word."""
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
        unknown = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ids == 0, out=unknown[1:])
        values = mixed(ids.astype(U64))
        for size, hashes, window, first in self.sets:
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            h = run_hashes(values, size)[at] if size > 1 else mixed(values)[at]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            many = high - low  # windows of one hash: one, unless two windows collide
            pick = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            same = (ids[at[:, None] + np.arange(size)] == window[pick]).all(1)
            out.append((at[same], np.full(same.sum(), size), first + pick[same]))
        starts, widths, windows = (np.concatenate(c) for c in zip(*out, strict=True))
        return starts, widths, windows


def window_hashes(windows: np.ndarray) -> np.ndarray:
    """One hash per row of word numbers, the same as of those words inside a text."""
    values = mixed(windows.reshape(-1).astype(U64))
    size = windows.shape[1]
    return run_hashes(values, size)[::size] if size > 1 else mixed(values)


def item_sets(benchmark: DataFrame, item: str, text: str, most_words: int) -> list[list[int]]:
    """Bounds of item ranges whose words fit one broadcast set, from one pass over the item sizes.

    Items are dealt by hash into as many parts as the total size needs, so
    each part has about ``most_words`` words at most.
    """
    total = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(1, -(-total // (2 * most_words)))  # a word and its separator take two characters or more
    return [[i, parts] for i in range(parts)]


#: What a pass has found in one text: sorted spans of hit words as bounds, and the names of the items.
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("_at", T.ArrayType(T.LongType())),
                     T.StructField("_items", T.ArrayType(T.StringType()))])


def scanned(docs: DataFrame, benchmark: DataFrame, text: str, keep: list[Column], item: str = "item_id",
            item_text: str = "text", width: int = WINDOW, most_words: int = MOST_ITEM_WORDS,
            finish: tuple[T.StructType, Callable[[dict, list, dict], dict]] | None = None) -> DataFrame:
    """``keep`` columns and HITS, or what ``finish`` makes of kept columns, texts and hits of a slice.

    One pass over the documents per broadcast set; most benchmarks are smaller
    than a set, so there is one pass. The set of a pass is bounded by
    ``most_words``; later passes run over the stored outcome of the one before
    and add to it. The text goes through a pass once.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("t")).where(
        "id is not null and t is not null"
    )
    out = docs.select(*keep, F.col(text).alias("_text"))
    kept = out.columns[:-1]
    fields = [out.schema[c] for c in kept]
    between = T.StructType([*fields, out.schema["_text"], *HITS])
    last = T.StructType([*fields, *HITS]) if finish is None else finish[0]
    parts = item_sets(items, "id", "t", most_words)
    for part, of in parts:
        # bounded by most_words; sorted so that every rerun numbers the words alike
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(of)) == part).collect()
        shared = spark.sparkContext.broadcast(
            ItemWindows(sorted((r.id, r.t.encode()) for r in rows), width)
        )
        ends = part == of - 1

        def run(batch: pa.RecordBatch, shared=shared, ends=ends, later=part > 0) -> Iterator[dict]:
            names = batch.schema.names
            for rows, texts in text_slices(batch, names.index("_text")):
                own = {c: rows.column(names.index(c)) for c in kept}
                before = [rows.column(names.index(c)).to_pylist() for c in ("_at", "_items")] if later else None
                hits = slice_hits(texts, shared.value, before)
                if not ends:
                    yield own | {"_text": rows.column(names.index("_text"))} | hits
                elif finish is None:
                    yield own | hits
                else:
                    yield finish[1](own, texts, hits)

        out = map_batches(out, last if ends else between, run)
        if not ends:
            out = stored(out, "scan")
    return out


def slice_hits(texts: list, windows: ItemWindows, before: list[list] | None = None) -> dict:
    """HITS of some documents against one set of windows, with those of earlier sets."""
    words = [folded_words(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum(sizes + 1, out=begin[1:])  # one unknown word between documents
    ids = np.zeros(begin[-1], np.int64)
    get = windows.number.get
    for i, w in enumerate(words):
        ids[begin[i] : begin[i] + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
    at, width, window = windows.found(ids)
    doc = np.searchsorted(begin, at, "right") - 1
    old_spans, old_items = before or [[[] for _ in words]] * 2
    spans = [list(zip(s[::2], s[1::2], strict=True)) for s in old_spans]
    items = [set(i) for i in old_items]
    at = at - begin[doc]
    for d, a, b in zip(doc.tolist(), at.tolist(), (at + width).tolist(), strict=True):
        spans[d].append((a, b))
    for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():  # a window names its items once a document
        items[d].update(windows.ids[i] for i in windows.owners[w])
    return {
        "n_words": pa.array(sizes),
        "_at": pa.array([[x for s in joined_spans(s) for x in s] for s in spans], pa.list_(pa.int64())),
        "_items": pa.array([sorted(s) for s in items], pa.list_(pa.string())),
    }


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def n_hit() -> Column:
    ends = F.filter("_at", lambda _, i: i % 2 == 1)
    starts = F.filter("_at", lambda _, i: i % 2 == 0)
    add = lambda s, x: s + x
    return F.aggregate(ends, F.lit(0).cast("long"), add) - F.aggregate(starts, F.lit(0).cast("long"), add)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  **settings) -> DataFrame:
    """``(key, n_words, n_hit, spans, items, contaminated)`` of every document.

    ``spans`` are the hit runs as ``[start, end)`` word numbers, ``items`` the
    ids of the items that occur, sorted as strings. Null text has no words.
    Null items are left out; with an empty benchmark nothing is hit. Items
    with the same words are all named. Repeated rows are judged one by one.
    """
    found = scanned(docs, benchmark, text, [F.col(key).alias("_key")], **settings)
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("_at") - 2, F.lit(2)),
        lambda i: F.struct(F.get("_at", i).alias("start"), F.get("_at", i + 1).alias("end")),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return found.select(
        F.col("_key").alias(key), "n_words", n_hit().alias("n_hit"),
        F.when(F.size("_at") > 0, pairs).otherwise(none).alias("spans"),
        F.col("_items").alias("items"), (F.size("_at") > 0).alias("contaminated"),
    )


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them inside a span."""
    out, at, n, cut = [], 0, 0, None
    bounds = list(zip(spans[::2], spans[1::2], strict=True))[::-1]
    for word in _WORD_BYTES.finditer(text):
        if not bounds:
            break
        if n == bounds[-1][0]:
            cut = word.start()
        if n == bounds[-1][1] - 1:
            out.append(text[at:cut])
            at = word.end()
            bounds.pop()
        n += 1
    out.append(text[at:])
    return b"".join(out)


def cut_slice(own: dict, texts: list, hits: dict) -> dict:
    """Kept columns and texts without their spans; documents left without a word are gone."""
    spans = hits["_at"].to_pylist()
    new = [without_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
    stays = pa.array([not s or bool(folded_words(t)) for t, s in zip(new, spans, strict=True)], pa.bool_())
    cut = {"_new": pa.array(new, pa.binary()).cast(pa.string()), "_cut": pa.array([bool(s) for s in spans], pa.bool_())}
    return {c: v.filter(stays) for c, v in (own | cut).items()}


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = "n_chars",
                   **settings) -> DataFrame:
    """The documents without their hit spans, all columns kept; a document left without a word goes.

    Documents that hold no window stay as they are, null and empty texts
    among them. ``n_chars`` follows the new text where the table has that
    column. Whole texts are scanned and cut, however long, in the same pass.
    Repeated rows are treated alike; an empty table stays empty, and an empty
    benchmark cuts nothing. Names of further columns cannot clash.
    """
    rest = docs.select(without_text(docs, text)).schema["rest"]
    schema = T.StructType([rest, T.StructField("_new", T.StringType()), T.StructField("_cut", T.BooleanType())])
    cut = scanned(docs, benchmark, text, [without_text(docs, text)], finish=(schema, cut_slice), **settings)
    new = {text: F.col("_new")}
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        new[n_chars] = F.when(F.col("_cut"), F.length("_new").cast(kind)).otherwise(F.col("rest").getField(n_chars))
    return text_back(cut, docs, text, new)


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@query(f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM items))),
hits AS (SELECT r, i, n, item_id FROM win JOIN items USING (n, g)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
