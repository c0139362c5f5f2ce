"""Portfolio statistics, distributions, similar trials and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake import fixed_values as V
from cohortlake.functions.scoring import mean
from cohortlake.operators.ordered import first_per_group

STATS = {
    "success": "success_rate",
    "duration_days": "avg_duration_days",
    "enrollment": "avg_enrollment",
    "dropout_rate": "avg_dropout_rate",
    "cost_usd": "avg_cost",
}


def portfolio_stats(trials: DataFrame, scale: int | None = None) -> DataFrame:
    """One row: trial count and null-skipping means; a fixed value for a missing column.

    ``scale`` states that rates and costs have that many decimals; their sums
    are then exact, so the result does not depend on how the table is
    partitioned. Partial sums leave one row per task to shuffle.
    """

    def average(name: str) -> Column:
        if name not in trials.columns:
            return F.coalesce(F.first(F.lit(V.DEFAULT_STATS[name])), F.lit(V.DEFAULT_STATS[name]))
        if name == "success":
            return F.avg(F.col(name).cast("int"))
        return mean(name, scale if name in ("dropout_rate", "cost_usd") else None)

    return trials.agg(
        F.count(F.lit(1)).alias("total_trials"), *[average(c).alias(out) for c, out in STATS.items()]
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts of the non-null values, most frequent first, then by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("trials"))
        .orderBy(F.desc("trials"), column)
    )


def distribution_map(df: DataFrame, column: str) -> DataFrame:
    """The distribution of a column with few values (phase, area) as one map."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ordered = F.sort_array(F.collect_list(F.struct(-F.col("_n"), F.col(column).alias("value"), "_n")))
    pairs = F.transform(ordered, lambda x: F.struct(x["value"], x["_n"]))
    return counts.agg(F.map_from_entries(pairs).alias(f"{column}_distribution"))


def portfolio_overview(trials: DataFrame, scale: int) -> DataFrame:
    """One row: the means of :func:`portfolio_stats` and the distributions of phase and area as sorted lists.

    The trials are read once, into one row per (phase, area); all figures come
    from these few rows. ``scale`` is the number of decimals of rates and costs.
    """
    exact = ("dropout_rate", "cost_usd")
    value = {c: F.col(c).cast(f"decimal(18,{scale})" if c in exact else "int" if c == "success" else "double") for c in STATS}
    groups = trials.groupBy("phase", "therapeutic_area").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(value[c]).alias(f"_sum_{c}") for c in STATS], *[F.count(c).alias(f"_n_{c}") for c in STATS])
    total = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_trials"),
        *[F.try_divide(F.sum(f"_sum_{c}").cast("double"), F.sum(f"_n_{c}")).alias(out) for c, out in STATS.items()],
        F.collect_list(F.struct("phase", "therapeutic_area", "n")).alias("_groups"),
    )

    def counted(column: str) -> Column:
        values = F.array_distinct(F.filter(F.transform("_groups", lambda g: g[column]), lambda v: v.isNotNull()))
        n_of = lambda v: F.aggregate(
            F.filter("_groups", lambda g: g[column] == v), F.lit(0).cast("long"), lambda s, g: s + g["n"])
        counts = F.transform(values, lambda v: F.struct((-n_of(v)).alias("m"), v.alias("value")))
        return F.transform(F.array_sort(counts), lambda c: F.struct(c["value"].alias("value"), (-c["m"]).alias("n")))

    return total.select("total_trials", *STATS.values(), counted("phase").alias("phases"), counted("therapeutic_area").alias("areas"))


def scalar(stats: DataFrame) -> Column:
    """A one-row table as a struct usable in any expression; computed once per query."""
    return stats.select(F.struct(*stats.columns)).scalar()


def with_benchmarks(trials: DataFrame, stats: DataFrame) -> DataFrame:
    """Portfolio means beside each trial and the trial's distance to them."""
    with_stats = trials.withColumn("_stats", scalar(stats))
    out = {f"benchmark_{c}": F.col(f"_stats.{name}") for c, name in STATS.items() if c in trials.columns}
    gaps = {
        f"gap_{c}": F.col(c).cast("int" if c == "success" else "double") - F.col(f"_stats.{name}")
        for c, name in STATS.items() if c in trials.columns
    }
    return with_stats.withColumns(out | gaps).drop("_stats")


def _newest_first() -> list[Column]:
    return [F.desc("start_date"), F.asc("trial_id")]


def similar_trials(trials: DataFrame, area: str, phase: str, limit: int = 5) -> DataFrame:
    """At most ``limit`` (1 to 20) trials of the same area and phase, newest first."""
    if not 1 <= limit <= MOST_SIMILAR:
        raise ValueError(f"limit must be 1 to {MOST_SIMILAR}")
    same = (F.col("therapeutic_area") == area) & (F.col("phase") == phase)
    return trials.where(same).orderBy(*_newest_first()).limit(limit)


MOST_SIMILAR = 20


def limit_fits() -> Column:
    return F.coalesce(F.col("limit").between(1, MOST_SIMILAR), F.lit(False))


def similar_trials_for(requests: DataFrame, trials: DataFrame) -> DataFrame:
    """Similar trials for a table of requests (therapeutic_area, phase, limit), as many as each asks for.

    Requests with a limit outside 1 to MOST_SIMILAR are refused whole, see
    :func:`refused_requests`. No request can see more than MOST_SIMILAR trials,
    so each (area, phase) sends no more of them, however many it has.
    """
    newest = first_per_group(
        trials.where(F.col("phase").isNotNull()), ["therapeutic_area", "phase"], _newest_first(), MOST_SIMILAR
    )
    return requests.where(limit_fits()).join(newest, ["therapeutic_area", "phase"]).where(F.col("rank") <= F.col("limit"))


def refused_requests(requests: DataFrame) -> DataFrame:
    """Requests for similar trials whose limit is not allowed, with the reason."""
    return requests.where(~limit_fits()).withColumn("reason", F.lit(f"limit must be 1 to {MOST_SIMILAR}"))


def trial_history(trials: DataFrame, phase: str | None = None, area: str | None = None,
                  limit: int = 50) -> DataFrame:
    """Filtered trials, newest first, at most ``limit`` (1 to 200)."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    if phase:
        trials = trials.where(F.col("phase") == phase)
    if area:
        trials = trials.where(F.col("therapeutic_area") == area)
    return trials.orderBy(*_newest_first()).limit(limit)


def results_with_trial(results: DataFrame, trials: DataFrame) -> DataFrame:
    """Results with their trial's columns; results without a trial are kept.

    Results that name no trial can never match. They get a spread-out join
    key, otherwise all of them would meet in the one task of the null key.
    """
    trial = trials.select(
        F.col("trial_id").alias("_key"),
        *[F.col(c).alias(f"trial_{c}" if c in results.columns else c)
          for c in trials.columns if c != "trial_id"],
    )
    spread = F.concat(F.lit("no trial "), F.pmod(F.xxhash64("simulation_id"), F.lit(4096)).cast("string"))
    return (
        results.withColumn("_key", F.coalesce("trial_id", spread)).join(trial, "_key", "left").drop("_key")
    )
