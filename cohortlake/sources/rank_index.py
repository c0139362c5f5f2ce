"""Pages of a sorted table from an index of positions.

The key and the sort value are sorted once, across tasks, and stored in one
folder per range; a small table says which position each range begins with.
A page of any depth reads the folder that holds it, and the page's rows are
then taken from the table by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortlake.operators.results import PAGE_SIZE


def build_rank_index(rows: DataFrame, order: list[Column], path: str, key: str = "simulation_id") -> None:
    """Store every key with its place in the order; ``order`` ends in a unique column."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = rows.orderBy(*order).select(key, F.spark_partition_id().alias("part"), inside.alias("inside"))
    ranked.write.mode("overwrite").partitionBy("part").parquet(f"{path}/ranks")
    sizes = rows.sparkSession.read.schema(ranked.schema).parquet(f"{path}/ranks").groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    starts.write.mode("overwrite").parquet(f"{path}/starts")


def ranked_keys(spark: SparkSession, path: str, first: int, count: int, key: str = "simulation_id") -> DataFrame:
    """``(key, position)`` of ``count`` rows from position ``first`` (1 is the first), from the ranges that hold them."""
    last = first + count - 1
    starts = spark.read.parquet(f"{path}/starts").where((F.col("start") < last) & (F.col("start") + F.col("size") >= first))
    held = {r.part: r.start for r in starts.collect()}  # the ranges that a page touches
    if not held:
        return spark.createDataFrame([], f"`{key}` string, position long")
    ranks = spark.read.parquet(f"{path}/ranks").where(F.col("part").isin(list(held)))
    start = F.create_map(*[F.lit(x) for pair in held.items() for x in pair])[F.col("part")]
    position = (start + F.col("inside") + 1).cast("long")
    return ranks.select(key, position.alias("position")).where(F.col("position").between(first, last))


def indexed_page(rows: DataFrame, path: str, number: int, size: int = PAGE_SIZE, key: str = "simulation_id") -> DataFrame:
    """Page ``number`` of ``rows`` with ``position``, in the order that the index was built with.

    A page has ``size`` rows at most; their keys go into the scan as a filter.
    """
    found = ranked_keys(rows.sparkSession, path, (number - 1) * size + 1, size, key)
    places = {r[key]: r.position for r in found.collect()}
    if not places:
        return rows.limit(0).withColumn("position", F.lit(0).cast("long"))
    position = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])[F.col(key)]
    return rows.where(F.col(key).isin(list(places))).withColumn("position", position.cast("long")).orderBy("position")
