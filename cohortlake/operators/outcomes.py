"""Scores per trial from patient and event tables, scenarios and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlake import fixed_values as V
from cohortlake.functions.scoring import dropout_risk, exact_sum, outcome_scores
from cohortlake.operators.ordered import running_total


def events_by_severity(events: DataFrame, key: str = "trial_id") -> DataFrame:
    """Events per trial in four fixed severity columns, zero when there are none."""
    return events.groupBy(key).agg(
        *[
            F.count_if(F.col("severity") == s).alias(s.lower().replace("-", "_"))
            for s in V.SEVERITIES
        ]
    )


def trial_outcomes(trials: DataFrame, patients: DataFrame, events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Outcome scores per trial that has patients, with the trial's ``keep`` columns.

    Patients and events are each reduced to one row per trial before they meet.
    """
    people = patients.groupBy("trial_id").agg(
        F.count_if(~F.col("dropped_out")).alias("completed"),
        F.count_if(F.col("dropped_out")).alias("dropped"),
    )
    severe = (
        events.where(F.col("severity").isin("Severe", "Life-threatening"))
        .groupBy("trial_id")
        .agg(F.count(F.lit(1)).alias("severe"))
    )
    scored = (
        people.join(severe, "trial_id", "left")
        .join(trials.select("trial_id", "expected_success_rate", *keep), "trial_id")
        .withColumn("severe", F.coalesce("severe", F.lit(0)))
        .withColumn("_scores", outcome_scores("completed", "dropped", "severe", "expected_success_rate"))
    )
    return scored.select("trial_id", "completed", "dropped", "severe", "_scores.*", *keep)


def expected_dropouts(trials: DataFrame, patients: DataFrame) -> DataFrame:
    """Sum of the patients' dropout risks per trial.

    The risk is the trial's base rate times patient factors, so the factors
    are summed before the trial joins: one row per trial meets one row.
    """
    factors = patients.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("patients"),
        exact_sum(dropout_risk(F.lit(1.0), "age", "comorbidity_count"), 6).alias("_factor"),
    )
    return factors.join(trials.select("trial_id", "dropout_rate"), "trial_id").select(
        "trial_id", "patients", (F.col("dropout_rate") * F.col("_factor")).alias("expected_dropouts")
    )


def scenario_grid(designs: DataFrame, scenarios: int) -> DataFrame:
    """Each design with scenario numbers 0 to n-1 (n is 1 to 10); rows expand in place."""
    if not 1 <= scenarios <= 10:
        raise ValueError("scenarios must be 1 to 10")
    return designs.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))))


def eligible_patients(trials: DataFrame, patients: DataFrame) -> DataFrame:
    """Patients of a trial whose age lies in the trial's range."""
    bounds = trials.select("trial_id", "min_age", "max_age")
    return patients.join(bounds, "trial_id").where(F.col("age").between(F.col("min_age"), F.col("max_age")))


def eligible_pool_size(trials: DataFrame, patients: DataFrame) -> DataFrame:
    """How many patients of the whole pool fit each trial's age range; none without both bounds.

    The ages that occur, with their counts, and the different bounds stand in
    one sorted sequence, where a bound's running total tells how many patients
    are below it (or up to it, for an upper bound). Each trial looks up two
    totals. Ages and bounds may be any numbers, of any span, and no
    patient-trial pairs are built.
    """
    ages = patients.where(F.col("age").isNotNull()).groupBy(F.col("age").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    # at equal numbers: a lower bound stands before the age, an upper bound behind it
    lower, upper = (
        trials.where(F.col(c).isNotNull()).select(F.col(c).alias("_at"), F.lit(side).alias("_side"), F.lit(0).cast("long").alias("_n")).distinct()
        for c, side in (("min_age", 0), ("max_age", 2))
    )
    sequence = ages.select("_at", F.lit(1).alias("_side"), "_n").unionByName(lower).unionByName(upper)
    totals = running_total(sequence, ["_at", "_side"], "_n", "_upto")
    below, upto = (
        totals.where(F.col("_side") == side).select(F.col("_at").alias(f"_{name}_at"), F.col("_upto").alias(f"_{name}"))
        for side, name in ((0, "below"), (2, "upto"))
    )
    found = trials.join(below, F.col("min_age") == F.col("_below_at"), "left").join(
        upto, F.col("max_age") == F.col("_upto_at"), "left")
    eligible = F.when(F.col("min_age") <= F.col("max_age"), F.col("_upto") - F.col("_below"))
    return found.select("trial_id", "min_age", "max_age", F.coalesce(eligible, F.lit(0)).cast("bigint").alias("eligible"))
