"""Ordered work per key that does not depend on any key being small.

A window over (key, order) sorts all rows of a key in one task. That is the
right plan while every key fits a task, so it stays the plan for such keys.
Keys that hold more rows than ``hot_rows`` are cut along their own order into
ranges, each range is worked on alone, and what earlier ranges leave behind is
added from a table with one row per (key, range). Results are the same either
way; only the cut differs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake.session import checkpointed

HOT_ROWS = 5_000_000
BROADCAST_KEYS = 1_000_000
CHUNK = "_range"


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than ``hot_rows`` rows (None when there are none)."""

    keys: DataFrame | None
    count: int
    ranges: int

    def marks(self) -> DataFrame:
        """The keys under other names; broadcast only while their counted number is small."""
        renamed = self.keys.withColumnsRenamed({k: f"_hot_{k}" for k in self.keys.columns})
        return F.broadcast(renamed) if self.count <= BROADCAST_KEYS else renamed


def find_hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> HotKeys:
    """Count rows per key (combined before the shuffle) and keep the large ones.

    There are at most ``rows / hot_rows`` of them, whatever the data.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    count, rows = large.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if count == 0:
        return HotKeys(None, 0, 0)
    return HotKeys(checkpointed(large.select(*keys)), count, 2 * math.ceil(rows / hot_rows))


@dataclass(frozen=True)
class Scan:
    """A value that runs along the order of a key.

    ``within`` works on one window, ``summary`` is what a range leaves behind,
    ``incoming`` combines what earlier ranges left, ``merge`` joins both.
    """

    within: Callable[[Callable], Column]
    summary: Callable[[Column], Column]
    incoming: Callable[[Column, object], Column]
    merge: Callable[[Column, Column], Column]


def last_value(value: Column, with_current: bool = True) -> Scan:
    """Last non-null value up to (or strictly before) each row."""
    return Scan(
        within=lambda window: F.last(value, ignorenulls=True).over(window(0 if with_current else -1)),
        summary=lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        incoming=lambda left, earlier: F.last(left, ignorenulls=True).over(earlier),
        merge=lambda local, carried: F.coalesce(local, carried),
    )


def first_value(value: Column) -> Scan:
    """Value of the key's first row, on every row."""
    return Scan(
        within=lambda window: F.first(value).over(window(0)),
        summary=lambda order: F.min_by(F.struct(value.alias("value")), order),
        incoming=lambda left, earlier: F.first(left).over(earlier),
        merge=lambda local, carried: F.when(carried.isNotNull(), carried["value"]).otherwise(local),
    )


def position() -> Scan:
    """Place of each row inside its key, from 1."""
    return Scan(
        within=lambda window: F.count(F.lit(1)).over(window(0)),
        summary=lambda order: F.count(F.lit(1)),
        incoming=lambda left, earlier: F.sum(left).over(earlier),
        merge=lambda local, carried: local + F.coalesce(carried, F.lit(0)),
    )


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a key and an order that is unique inside the key.

    ``whole`` holds the keys that fit one task, ``ranged`` the rows of the
    large keys with their range number (None when there are none). ``pairs``
    bounds the number of (key, range) pairs.
    """

    whole: DataFrame
    ranged: DataFrame | None
    keys: list[str]
    order: list[str]
    pairs: int = 0

    @staticmethod
    def of(df: DataFrame, keys: list[str], order: list[str], hot: HotKeys | None = None,
           hot_rows: int = HOT_ROWS) -> OrderedRows:
        """Separate large keys and cut them; rows of other keys do not move."""
        hot = hot or find_hot_keys(df, keys, hot_rows)
        if hot.keys is None:
            return OrderedRows(df, None, keys, order)
        marks = hot.marks()
        same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
        # One range partition holds neighbours in (key, order). The checkpoint
        # pins each row's range, so a lost executor cannot change it.
        ranged = checkpointed(
            df.join(marks, same, "left_semi")
            .repartitionByRange(hot.ranges, *keys, *order)
            .withColumn(CHUNK, F.spark_partition_id())
        )
        return OrderedRows(df.join(marks, same, "left_anti"), ranged, keys, order, hot.ranges + hot.count)

    def rows(self) -> DataFrame:
        if self.ranged is None:
            return self.whole
        return self.whole.unionByName(self.ranged.drop(CHUNK))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> OrderedRows:
        """Apply a row-wise change (columns or filter) to all rows."""
        ranged = None if self.ranged is None else change(self.ranged)
        return replace(self, whole=change(self.whole), ranged=ranged)

    def _window(self, first: int, last: int, ranged: bool = False):
        parts = [*self.keys, CHUNK] if ranged else self.keys
        return Window.partitionBy(*parts).orderBy(*self.order).rowsBetween(first, last)

    def _earlier(self, first: int):
        return Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(first, -1)

    def _with_incoming(self, df: DataFrame, incoming: DataFrame) -> DataFrame:
        """Add to each row what its range receives.

        One row per (key, range) joins; ranges share keys only at their ends,
        so there are no more rows than ranges and large keys together.
        """
        names = [*self.keys, CHUNK]
        other = incoming.withColumnsRenamed({n: f"_in_{n}" for n in names})
        if self.pairs <= BROADCAST_KEYS:
            other = F.broadcast(other)
        on = [F.col(n).eqNullSafe(F.col(f"_in_{n}")) for n in names]
        return df.join(other, on, "left").drop(*[f"_in_{n}" for n in names])

    def scan(self, **scans: Scan) -> OrderedRows:
        """Add the scans' columns; all of them share one shuffle and sort."""

        def within(ranged: bool, prefix: str = "") -> dict[str, Column]:
            window = lambda last: self._window(Window.unboundedPreceding, last, ranged)
            return {prefix + name: s.within(window) for name, s in scans.items()}

        whole = self.whole.withColumns(within(False))
        if self.ranged is None:
            return replace(self, whole=whole)
        at = F.struct(*self.order)
        left = self.ranged.groupBy(*self.keys, CHUNK).agg(
            *[s.summary(at).alias(f"_left_{name}") for name, s in scans.items()]
        )
        earlier = self._earlier(Window.unboundedPreceding)
        incoming = left.select(
            *self.keys, CHUNK,
            *[s.incoming(F.col(f"_left_{name}"), earlier).alias(f"_carried_{name}") for name, s in scans.items()],
        )
        joined = self._with_incoming(self.ranged.withColumns(within(True, "_local_")), incoming)
        merged = joined.withColumns(
            {name: s.merge(F.col(f"_local_{name}"), F.col(f"_carried_{name}")) for name, s in scans.items()}
        )
        temporary = [f"{p}{name}" for name in scans for p in ("_local_", "_carried_")]
        return replace(self, whole=whole, ranged=merged.drop(*temporary))

    def last_values(self, name: str, value: Column, count: int) -> OrderedRows:
        """Values of the ``count`` rows before each row, oldest first."""
        whole = self.whole.withColumn(name, F.collect_list(value).over(self._window(-count, -1)))
        if self.ranged is None:
            return replace(self, whole=whole)
        newest = Window.partitionBy(*self.keys, CHUNK).orderBy(*[F.col(o).desc() for o in self.order])
        tails = (
            self.ranged.select(*self.keys, CHUNK, *self.order, value.alias("_value"))
            .withColumn("_rank", F.row_number().over(newest))
            .where(F.col("_rank") <= count)
            .groupBy(*self.keys, CHUNK)
            .agg(F.sort_array(F.collect_list(F.struct(-F.col("_rank"), F.col("_value")))).alias("_tail"))
            .withColumn("_tail", F.col("_tail._value"))
        )
        # every range holds a row, so ``count`` ranges back are enough
        incoming = tails.select(
            *self.keys, CHUNK, F.flatten(F.collect_list("_tail").over(self._earlier(-count))).alias("_carried")
        )
        local = F.collect_list(value).over(self._window(-count, -1, True))
        empty = F.slice("_local", 1, 0)
        joined = F.concat(F.coalesce("_carried", empty), F.col("_local"))
        ranged = (
            self._with_incoming(self.ranged.withColumn("_local", local), incoming)
            .withColumn("_all", joined)
            .withColumn(name, F.when(F.size("_all") > count, F.slice("_all", -count, count)).otherwise(F.col("_all")))
            .drop("_local", "_carried", "_all")
        )
        return replace(self, whole=whole, ranged=ranged)


def number_all_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Position of every row in the order of the whole table, from 1.

    The table is range-sorted across tasks and pinned; a row's number is its
    place inside its partition plus the sizes of the partitions before it.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    pinned = checkpointed(
        df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_inside", inside)
    )
    sizes = pinned.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = sizes.select(
        F.col("_part").alias("_p"),
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )
    return (
        pinned.join(F.broadcast(before), F.col("_part") == F.col("_p"))
        .withColumn(name, F.col("_inside") + 1 + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_inside", "_p", "_before")
    )


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of the table up to each row; ``order`` is unique.

    The table is range-sorted across tasks and pinned; a row's total is that
    inside its partition plus the sums of the partitions before it.
    """
    pinned = checkpointed(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per partition
    sums = pinned.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum"))
    before = sums.select("_p", F.sum("_sum").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return (
        pinned.withColumn(name, F.sum(value).over(inside))
        .join(F.broadcast(before), F.col("_part") == F.col("_p"))
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_p", "_before")
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], count: int) -> DataFrame:
    """At most ``count`` rows per key in the given order.

    The rank filter is a plain ``row_number() <= count``: Spark then limits
    each map task to ``count`` rows per key before the shuffle, so a large key
    sends ``count`` rows per task and not all of its rows.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= count).withColumnRenamed("_rank", "rank")
