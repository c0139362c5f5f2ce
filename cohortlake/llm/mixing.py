"""Mixing sources to target weights: repetition rates per source, whole copies and one seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import WORD, as_row, stored
from cohortlake.llm.registry import query, table
from cohortlake.operators.ordered import number_all_rows

WEIGHTS = (5, 2, 1)
#: Words of the mix as a percentage of all words, and the largest multiple of a source.
SHARE_PERCENT, MOST_TIMES = 150, 2
SEED = 20260101
#: Steps of a draw: 53 bits of a hash.
_STEPS = 1 << 53


def n_words(text: str) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
                   most_times: int = MOST_TIMES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources are numbered by code point, null last, and take the weights in
    turn. Targets share ``share_percent`` of all sizes by weight; a target over
    ``most_times`` its source stops there and the excess is shared again until
    none is above. The rounds work on one row per source and bring three sums
    to the driver each time; they end when no further source is capped.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = number_all_rows(
        totals.withColumn("_null", F.col("source").isNull()), [F.col("_null"), F.col("source")], "_rank"
    )
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = stored(
        numbered.select("source", "source_size", turn.cast("long").alias("weight"),
                        (F.lit(most_times) * F.col("source_size")).alias("most")),
        "sources",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # what is left to share is left / 100, over the weight of the sources that are not capped
    left, weight, capped = share_percent * total, None, F.lit(False)
    seen = -1
    while True:
        open_weight, stopped, count = ranked.agg(
            F.sum(F.when(~capped, F.col("weight")).otherwise(0)),
            F.sum(F.when(capped, F.col("most")).otherwise(0)),
            F.sum(F.when(capped, 1).otherwise(0)),
        ).first()
        if count == seen or not open_weight:
            break
        seen = count
        left, weight = share_percent * total - 100 * (stopped or 0), open_weight
        over = F.col("weight").cast("decimal(38,0)") * F.lit(left).cast("decimal(38,0)")
        capped = over > F.col("most").cast("decimal(38,0)") * F.lit(100 * weight).cast("decimal(38,0)")
    shared = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(100 * (weight or 1)))
    return ranked.select(
        "source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(shared).alias("target")
    )


def copies(rate: Column, keys: list[Column], seed: int = SEED) -> Column:
    """Whole part of the rate, plus one with the probability of its fraction.

    The draw is a hash of the keys and the seed: a rerun, a retry or another
    partitioning draws the same.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(_STEPS)) / F.lit(float(_STEPS))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def with_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and rate of their source.

    One row per source on the right; the left side of a large source is what
    adaptive execution splits.
    """
    t = targets.withColumnRenamed("source", "_of")
    return rows.join(t, F.col("source").eqNullSafe(F.col("_of"))).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def mixture_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                 **settings) -> DataFrame:
    """``(key, size, source, source_size, target, copies)`` of every document.

    Null text has size 0; null sources are one source, the last. Repeated rows
    draw alike. An empty table gives no rows.
    """
    sizes = stored(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), n_words(text).alias("size")),
                   "sizes")
    rated = with_rates(sizes, stored(source_targets(sizes, **settings), "targets"))
    return rated.select(
        F.col("_key").alias(key), "size", "source", "source_size", "target",
        copies(F.col("rate"), [F.col("_key")]).alias("copies"),
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    **settings) -> DataFrame:
    """Every document as often as its source's rate and its draw say, with all its columns."""
    sizes = docs.select(F.col(source).alias("source"), n_words(text).alias("size"))
    targets = stored(source_targets(sizes, **settings), "targets")
    rows = docs.select(as_row(docs), F.col(source).alias("source"), F.col(key).alias("_key"))
    rated = with_rates(rows, targets).withColumn("copies", copies(F.col("rate"), [F.col("_key")]))
    repeated = rated.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select("row.*")


@query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixture_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
