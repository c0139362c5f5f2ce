"""Quality rules: thresholds learned per language and source from mergeable quantile sketches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import map_batches, stored, text_back, text_slices, without_text
from cohortlake.llm.registry import query, table

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Groups with fewer documents take the thresholds of their language, then of the whole table.
MIN_GROUP = 100
#: A fence lies this many spreads from the median; a spread is a quartile's distance from it, one unit at least.
SPREADS = 12
#: Metric: (numerator, denominator, scale, unit, is there a lower fence). The unit is what the smallest change makes
#: in a small document: one symbol in the 250 characters of 50 words of five, one line of 20, one character in 50 words.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1000, 4, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 50, False),
    "word_length": ("word_chars", "n_words", 100, 2, True),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Sketch: values below 2**(SKETCH_BITS + 1) have their own bucket, others 2**SKETCH_BITS buckets per power of two.
SKETCH_BITS = 8


def repeat_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``width`` words that stands twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    base, window = len(number), ids[: n - width + 1]
    if base == n:
        return 0
    for j in range(1, width):
        if j > 1 and base ** (j + 1) >= 1 << 62:  # the numbers would not fit: number the windows so far anew
            window = np.unique(window, return_inverse=True)[1]
        window = window * base + ids[j : n - width + 1 + j]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    repeated = np.zeros(n + 1, np.int64)
    hit = np.zeros(len(window), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(repeated, at, 1)
    np.add.at(repeated, at + width, -1)
    return int((np.cumsum(repeated[:n]) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The figures of one text, in the order of COUNTS; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    in_words = text.translate(None, SPACES)
    chars = len(in_words.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


def with_counts(docs: DataFrame, text: str, keep: list[Column], keep_text: bool = False) -> DataFrame:
    """``keep`` columns, the text as ``_text`` if asked for, and the figures of every text, in one pass over the texts."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    kept = source.columns if keep_text else source.columns[:-1]
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in COUNTS])
    at = len(keep)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, texts in text_slices(batch, at):
            figures = np.array([text_counts(t) for t in texts], np.int64)
            yield {c: part.column(i) for i, c in enumerate(kept)} | {
                c: pa.array(figures[:, i]) for i, c in enumerate(COUNTS)
            }

    return map_batches(source, schema, run)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )


def metric(name: str) -> Column:
    """The metric as a whole number; 0 where its denominator is 0."""
    top, bottom, scale, _, _ = METRICS[name]
    return F.when(F.col(bottom) > 0, F.expr(f"{scale} * {top} div {bottom}")).otherwise(F.lit(0).cast("long"))


def bucket(value: Column) -> Column:
    """Sketch bucket of a whole number >= 0: exact for small values, else within 1/2**SKETCH_BITS of the value."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(SKETCH_BITS + 1), F.lit(0)).cast("long")
    return shift * (1 << SKETCH_BITS) + F.floor(value / F.pow(F.lit(2.0), shift)).cast("long")


def bucket_value(b: Column) -> Column:
    """Least value of a bucket."""
    shift = F.greatest(F.expr(f"_bucket div {1 << SKETCH_BITS}") - 1, F.lit(0))
    return ((b - shift * (1 << SKETCH_BITS)) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(counts: DataFrame, lang: str, source: str) -> DataFrame:
    """The sketch of every (language, source, metric): ``(lang, source, metric, _bucket, n)``.

    Two sketches merge by adding their counts, whatever the partitioning, so
    tasks combine before the shuffle and a hot source is no heavier than
    another: each task sends at most one row per bucket and group. A sketch
    has a bounded number of buckets. Documents that fail the base rules do
    not count.
    """
    measured = F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), bucket(metric(m)))]))
    return (
        counts.where(~base_failed())
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), measured.alias("metric", "_bucket"))
        .groupBy("lang", "source", "metric", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Count and quartiles of each merged sketch: ``(keys, metric, docs, q1, q2, q3)``."""
    whole = Window.partitionBy(*keys, "metric")
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("_upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(whole))
    value = bucket_value(F.col("_bucket"))
    return ranked.groupBy(*keys, "metric").agg(
        F.max("docs").alias("docs"),
        *[F.min(F.when(F.lit(4) * F.col("_upto") >= F.lit(q) * F.col("docs"), value)).alias(f"q{q}") for q in (1, 2, 3)],
    )


def thresholds(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (language, source) with ``<metric>_high`` and ``<metric>_low``.

    The upper fence is the median plus SPREADS times the distance to the lower
    quartile, the lower one is its mirror; a distance counts as one unit of
    measurement at least, and as what the sketch can tell apart at the median,
    as smaller ones cannot be seen. The
    half of the distribution on the other side measures the spread, so junk of
    up to half of a source does not widen its own fence. A source with fewer
    than MIN_GROUP documents uses the merged sketch of its language, a language
    with fewer that of the table.
    """
    own = stored(sketches(counts, lang, source), "sketches")
    by_lang = own.groupBy("lang", "metric", "_bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("metric", "_bucket").agg(F.sum("n").alias("n"))
    a = quartiles(own, ["lang", "source"]).alias("a")
    b, c = quartiles(by_lang, ["lang"]).alias("b"), quartiles(overall, []).alias("c")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.metric") == F.col("b.metric"))).join(
        c, F.col("a.metric") == F.col("c.metric")
    )

    def level(q: str) -> Column:
        return (
            F.when(F.col("a.docs") >= MIN_GROUP, F.col(f"a.{q}"))
            .when(F.col("b.docs") >= MIN_GROUP, F.col(f"b.{q}"))
            .otherwise(F.col(f"c.{q}"))
        )

    chosen = joined.select("a.lang", "a.source", "a.metric", *[level(q).alias(q) for q in ("q1", "q2", "q3")])
    limits = []
    for m, (_, _, _, unit, lower) in METRICS.items():
        here = F.col("metric") == m
        least = F.greatest(F.lit(unit), F.expr(f"2 * (q2 div {1 << SKETCH_BITS})"))
        high = F.col("q2") + SPREADS * F.greatest(F.col("q2") - F.col("q1"), least)
        limits.append(F.max(F.when(here, high)).alias(f"{m}_high"))
        if lower:
            low = F.col("q2") - SPREADS * F.greatest(F.col("q3") - F.col("q2"), least)
            limits.append(F.max(F.when(here, low)).alias(f"{m}_low"))
    return chosen.groupBy("lang", "source").agg(*limits)


def inside_fences() -> Column:
    ok = F.lit(True)
    for m, (_, _, _, _, lower) in METRICS.items():
        ok = ok & (metric(m) <= F.coalesce(F.col(f"{m}_high"), metric(m)))
        if lower:
            ok = ok & (metric(m) >= F.coalesce(F.col(f"{m}_low"), metric(m)))
    return ok


def judged(counts: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counts`` with base_failed and kept, by a join with one row per (language, source).

    The planner broadcasts the thresholds while they are small; beyond that a
    hot source is on the side that adaptive execution splits.
    """
    t = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(
        t, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left"
    )
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside_fences())


def quality_figures(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                    keep: list[str] | None = None) -> DataFrame:
    """Figures and verdict of every document, without the texts.

    Null text counts as empty and fails the base rules. Null languages and
    sources form groups of their own. Repeated rows are judged one by one and
    alike. Long texts are measured whole. An empty table gives an empty
    result. ``keep`` names the columns carried along; one that is named like a
    figure is an error.
    """
    clash = set(keep or []) & {*COUNTS[:-1], "base_failed", "kept"}
    if clash:
        raise ValueError(f"columns named like figures: {sorted(clash)}")
    own = [F.col(c) for c in keep or []] + [F.col(lang).alias("_l"), F.col(source).alias("_s")]
    counts = stored(with_counts(docs, text, own), "quality")
    return judged(counts, thresholds(counts, "_l", "_s"), "_l", "_s").select(
        *(keep or []), *COUNTS[:-1], "base_failed", "kept"
    )


def quality_kept(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with all their columns.

    The texts stay where they are: one pass builds the sketches, a second one
    measures each document again and joins the thresholds. Null text counts
    as empty and fails the base rules, null languages and sources form groups,
    very long texts are measured whole, repeated rows share their fate, an
    empty table stays empty, and names of further columns cannot clash.
    """
    counts = with_counts(docs, text, [F.col(lang).alias("_l"), F.col(source).alias("_s")])
    limits = stored(thresholds(counts, "_l", "_s"), "thresholds")
    own = [without_text(docs, text), F.col(lang).alias("_l"), F.col(source).alias("_s")]
    kept = judged(with_counts(docs, text, own, keep_text=True), limits, "_l", "_s").where("kept")
    return text_back(kept, docs, text, {text: F.col("_text")})


def _oracle() -> str:
    """Figures by plain lists and joins; sketches, quartiles and fences as the operator defines them."""
    each = " UNION ALL ".join(
        f"SELECT r, lang, source, failed, '{m}' AS metric, CASE WHEN {bottom} > 0 THEN {scale} * {top} // {bottom} ELSE 0 END AS v, "
        f"{unit} AS unit, {lower} AS lower FROM judged"
        for m, (top, bottom, scale, unit, lower) in METRICS.items())
    size = 1 << SKETCH_BITS
    level = lambda name, keys: f"""
{name} AS (
  SELECT {keys}metric, max(upto) AS docs, {", ".join(
        f"min(low) FILTER (4 * upto >= {q} * docs) AS q{q}" for q in (1, 2, 3))} FROM (
    SELECT {keys}metric, b, (b - s * {size}) * (1::BIGINT << s) AS low, sum(n) OVER (PARTITION BY {keys}metric) AS docs,
      sum(n) OVER (PARTITION BY {keys}metric ORDER BY b) AS upto
    FROM (SELECT {keys}metric, b, greatest(b // {size} - 1, 0) AS s, count(*) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""  # noqa: E731
    return rf"""
WITH d AS (
  SELECT doc_id, lang, source, row_number() OVER () AS r, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
lines AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS kinds FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
repeated AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS failed FROM (
    SELECT doc_id, r, lang, source, len(w)::BIGINT AS n_words,
      coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(n_lines - kinds, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM d LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r))),
measured AS ({each}),
sketch AS (
  SELECT *, s * {size} + v // (1::BIGINT << s) AS b
  FROM (SELECT *, greatest(length(bin(v)) - {SKETCH_BITS + 1}, 0)::BIGINT AS s FROM measured WHERE NOT failed)),
{level("own", "lang, source, ")},{level("by_lang", "lang, ")},{level("overall", "")},
fences AS (
  SELECT o.lang, o.source, o.metric,
    {", ".join(f"CASE WHEN o.docs >= {MIN_GROUP} THEN o.q{q} WHEN l.docs >= {MIN_GROUP} THEN l.q{q} ELSE a.q{q} END AS q{q}" for q in (1, 2, 3))}
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN overall a ON a.metric = o.metric),
outside AS (
  SELECT DISTINCT m.r FROM measured m JOIN fences f
    ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source AND m.metric = f.metric
  WHERE v > q2 + {SPREADS} * greatest(q2 - q1, unit, 2 * (q2 // {size})) OR lower AND v < q2 - {SPREADS} * greatest(q3 - q2, unit, 2 * (q2 // {size})))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND r NOT IN (SELECT r FROM outside) AS kept
FROM judged
"""


@query(_oracle())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_figures(table(spark, sf_dir, "documents"), keep=["doc_id"])
