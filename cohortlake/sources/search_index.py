"""Substring search over a table through postings of three-letter parts.

``postings`` holds (part, key) for every part of three characters of a row's
joined search fields, in folders by a hash of the part; ``counts`` holds how
many rows each part is in. A search reads the folders of the rarest parts of
its term, keeps the keys that are in all of them, and compares those rows
with the whole term. Terms that are shorter
than a part scan the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlake.functions.text import search_text
from cohortlake.operators.results import SEARCH_FIELDS, search

LENGTH = 3
BUCKETS = 64
#: Rows that one task takes apart; its postings, some dozens a row, are ordered in its memory.
TASK_ROWS = 200_000
#: Postings that are read for a term; more would hardly drop another key.
PARTS_READ = 4
#: A term whose rarest part is in more than this share of the rows scans the table.
SCAN_SHARE = 0.2


def parts_of(text: str) -> list[str]:
    return sorted({text[i : i + LENGTH] for i in range(len(text) - LENGTH + 1)})


def bucket(part: Column) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(BUCKETS)).cast("int")


def build_search_index(rows: DataFrame, path: str, key: str = "simulation_id", fields: list[str] = SEARCH_FIELDS) -> None:
    """Write postings and counts of all rows; ``key`` is unique.

    Rows are dealt to tasks by a hash of the key before they are taken apart,
    and each task writes its own postings, ordered by folder only: the
    postings, many times the rows, are not shuffled. So a part that most rows
    hold neither meets in one task nor in one file. Keys hardly repeat in a
    file, so the files need no dictionary of them.
    """
    spark = rows.sparkSession
    rows.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/size")
    tasks = max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{path}/size").first().n // TASK_ROWS))
    text = search_text(*[F.col(f) for f in fields if f in rows.columns])
    starts = F.sequence(F.lit(1), F.greatest(F.length("_text") - (LENGTH - 1), F.lit(1)))
    each = F.array_distinct(F.transform(starts, lambda i: F.substring("_text", i, F.lit(LENGTH))))
    texts = rows.select(key, text.alias("_text")).repartition(tasks, key).sortWithinPartitions(key)
    postings = texts.select(key, F.explode(each).alias("part")).withColumn("bucket", bucket(F.col("part")))
    dealt = postings.sortWithinPartitions("bucket")
    files = dealt.write.mode("overwrite").option(f"parquet.enable.dictionary#{key}", "false")
    files.partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/postings")
    counts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("part").sortWithinPartitions("part").write.mode("overwrite").parquet(f"{path}/counts")


def rarest_parts(spark: SparkSession, path: str, term: str) -> list[str] | None:
    """The parts to read, the rarest first; none if a part is in no row, null if the term has to scan."""
    parts = parts_of(term.lower())
    if not parts:
        return None
    found = spark.read.schema("part string, n long").parquet(f"{path}/counts").where(F.col("part").isin(parts))
    n = {r.part: r.n for r in found.collect()}  # one row per part of the term
    if len(n) < len(parts):
        return []
    size = spark.read.parquet(f"{path}/size").first().n
    order = sorted(parts, key=lambda p: (n[p], p))
    return order[:PARTS_READ] if n[order[0]] <= SCAN_SHARE * size else None


def read_postings(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """Postings of the parts; only the folders of their buckets are read."""
    buckets = spark.range(1).select(F.array(*[bucket(F.lit(p)) for p in parts])).first()[0]
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("part").isin(parts))


def candidates(spark: SparkSession, path: str, parts: list[str], key: str = "simulation_id") -> DataFrame:
    """Keys that are in the postings of all the parts."""
    counted = read_postings(spark, path, parts).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") == len(parts)).select(key)


def indexed_search(rows: DataFrame, path: str, term: str, key: str = "simulation_id",
                   fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """The rows that :func:`cohortlake.operators.results.search` finds, by way of the index."""
    parts = rarest_parts(rows.sparkSession, path, term) if term else None
    if parts is None:
        return search(rows, term, fields)
    if not parts:
        return rows.limit(0)
    return search(rows.join(candidates(rows.sparkSession, path, parts, key), key, "left_semi"), term, fields)
