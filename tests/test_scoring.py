"""Formulas on hand-worked rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import scoring as sc
from cohortlake.operators import outcomes as oc


def one(df, *columns):
    return df.select(*columns).first()


@pytest.fixture(scope="module")
def design(spark):
    return spark.createDataFrame(
        [("Phase II", "Oncology", 200, 730, 0.15), ("Phase V", "Other", 90, 30, 0.3), (None, None, 501, 731, 0.21)],
        "phase string, area string, n int, days int, dropout double",
    )


def test_cost(design):
    got = [r[0] for r in design.select(sc.cost_estimate("phase", "area", "n", "days")).collect()]
    assert got[0] == pytest.approx((7_000_000 + 15_000 * 200 + 50_000 * 730 / 30) * 1.5)
    assert got[1] == pytest.approx(5_000_000 + 15_000 * 90 + 50_000)
    assert got[2] == pytest.approx(5_000_000 + 15_000 * 501 + 50_000 * 731 / 30)


def test_cost_does_not_overflow(spark):
    df = spark.createDataFrame([(2_000_000_000, 30)], "n int, days int")
    got = one(df, sc.cost_estimate(F.lit("Phase I"), F.lit("Cardiology"), "n", "days"))[0]
    assert got == pytest.approx((1_500_000 + 15_000 * 2_000_000_000 + 50_000) * 1.3)


def test_heuristic_and_risks(design):
    rows = design.select(
        sc.heuristic_points("phase", "n", "dropout").alias("p"), sc.risk_factors("dropout", "days", "n", "area").alias("r")
    ).collect()
    assert [r.p for r in rows] == [50, 60 - 5 - 10, 60 + 5]
    assert rows[0].r == ["Complex therapeutic area"]
    assert rows[1].r == ["High expected dropout rate"]
    assert rows[2].r == ["High expected dropout rate", "Long trial duration"]


def test_no_risk_gives_default_entry(spark):
    df = spark.createDataFrame([(0.2, 730, 1000, "Cardiology")], "d double, days int, n int, area string")
    assert one(df, sc.risk_factors("d", "days", "n", "area"))[0] == ["Standard trial risks"]


def test_success_probability_uses_portfolio_rate_for_unknown_phase(spark):
    df = spark.createDataFrame([("Phase IV", 0.8), ("x", 0.8), (None, 0.8)], "phase string, overall double")
    got = [r[0] for r in df.select(sc.success_probability("phase", "overall", F.lit(0.65))).collect()]
    assert got == pytest.approx([0.75 * 0.4 + 0.48, 0.65 * 0.4 + 0.48, 0.65 * 0.4 + 0.48])


def test_bands_at_their_limits(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.5,), (0.4999,), (None,)], "p double")
    assert [r[0] for r in df.select(sc.risk_band("p")).collect()] == ["high", "moderate", "moderate", "low", "low"]


def test_interval_is_cut_and_read_back(spark):
    df = spark.createDataFrame([(0.1, "(0.592, 0.892)"), (0.95, "bad"), (None, None)], "p double, t string")
    rows = df.select(sc.probability_interval("p").alias("i"), sc.stored_interval("t").alias("s")).collect()
    assert (rows[0].i.lo, rows[0].i.hi) == (0.0, 0.25)
    assert (rows[1].i.lo, rows[1].i.hi) == (pytest.approx(0.8), 1.0)
    assert rows[2].i is None
    assert (rows[0].s.lo, rows[0].s.hi) == (0.592, 0.892)
    assert rows[1].s.lo is None and rows[2].s.lo is None


def test_adverse_event_rate(spark):
    df = spark.createDataFrame(
        [("Phase I", "Oncology", "Drug"), ("Phase I", "Oncology", "Placebo"), ("x", "y", None)], "p string, a string, arm string"
    )
    got = [r[0] for r in df.select(sc.adverse_event_rate("p", "a", "arm")).collect()]
    assert got == pytest.approx([0.3 * 0.4 * 1.5, 0.3 * 0.4 * 1.5 * 0.7, 0.3])


def test_dropout_risk_limits(spark):
    df = spark.createDataFrame([(66, 3), (65, 2), (24, 0), (25, 1)], "age int, n int")
    got = [r[0] for r in df.select(sc.dropout_risk(F.lit(0.1), "age", "n")).collect()]
    assert got == pytest.approx([0.1 * 1.3 * 1.4, 0.1 * 1.2, 0.1 * 1.2, 0.1 * 1.2])


def test_comorbidities_text(spark):
    df = spark.createDataFrame([("None",), ("Hypertension",), ("a, b,c",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(sc.comorbidity_count("c")).collect()] == [0, 1, 3, 0, 0]


def test_outcome_scores_clip(spark):
    df = spark.createDataFrame(
        [(90, 10, 10, 0.7), (0, 0, 0, 0.7), (1, 9, 50, 0.0)], "c long, d long, s long, e double"
    )
    rows = [r[0] for r in df.select(sc.outcome_scores("c", "d", "s", "e")).collect()]
    assert rows[0].safety_score == pytest.approx(0.95)
    assert rows[0].completion_rate == pytest.approx(0.9)
    assert rows[0].efficacy_score == pytest.approx(0.82)
    assert rows[0].overall_score == pytest.approx(0.82 * 0.7 + 0.95 * 0.3)
    assert rows[0].primary_endpoint_met and rows[0].success
    assert rows[1].safety_score == 1.0 and rows[1].completion_rate == 0.0 and not rows[1].success
    assert rows[2].safety_score == 0.3 and rows[2].efficacy_score == 0.2


def test_result_metrics_with_missing_values(spark):
    df = spark.createDataFrame(
        [(0, None, None, None, None, None), (200, 150, 0.255, 730, 1000.0, 0.6)],
        "patients_enrolled int, patients_completed int, dropout_rate double, actual_duration_days int, "
        "estimated_cost double, success_probability double",
    )
    m = sc.result_metrics()
    first, second = df.select(*[c.alias(n) for n, c in m.items()]).collect()
    assert first.completion_pct is None and first.cost_per_patient is None and first.dropout_count == 0
    assert second.completion_pct == 75.0 and second.dropout_count == 51 and second.cost_per_patient == 5.0
    assert second.above_average_dropout and second.success and second.safety_score == pytest.approx(0.745)


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 30), 31)], "d date, n int")
    assert one(df, sc.completion_date("d", "n"))[0] == dt.date(2024, 3, 1)


def test_scenarios_are_bounded(spark):
    df = spark.createDataFrame([("a",)], "id string")
    assert [r.scenario for r in oc.scenario_grid(df, 3).orderBy("scenario").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        oc.scenario_grid(df, 11)


def test_eligible_pool_outside_the_age_span(spark):
    trials = spark.createDataFrame([("t", 0, 200), ("u", 60, 50), ("v", 30, 30)], "trial_id string, min_age int, max_age int")
    patients = spark.createDataFrame([(18,), (30,), (30,), (100,), (17,), (101,)], "age int")
    got = {r.trial_id: r.eligible for r in oc.eligible_pool_size(trials, patients).collect()}
    assert got == {"t": 6, "u": 0, "v": 2}


def test_eligible_pool_of_far_and_fractional_ages(spark):
    trials = spark.createDataFrame(
        [("a", 18.0, 30.0), ("b", 18.5, 3e9), ("c", 0.25, 0.25), ("d", None, 40.0), ("e", 18.0, None), ("f", -5.0, 2e9), ("a", 18.0, 30.0)],
        "trial_id string, min_age double, max_age double")
    ages = [18.0, 30.0, 30.0, 2e9, 0.25, 30.5, None]
    patients = spark.createDataFrame([(a,) for a in ages], "age double")
    got = sorted((r.trial_id, r.eligible) for r in oc.eligible_pool_size(trials, patients).collect())
    assert got == [("a", 3), ("a", 3), ("b", 4), ("c", 1), ("d", 0), ("e", 0), ("f", 6)]
    whole = spark.createDataFrame([(18,), (30,), (2_000_000_000,)], "age long")
    got = {r.trial_id: r.eligible for r in oc.eligible_pool_size(trials, whole).collect()}
    assert got == {"a": 2, "b": 2, "c": 0, "d": 0, "e": 0, "f": 3}
    assert {r.eligible for r in oc.eligible_pool_size(trials, patients.limit(0)).collect()} == {0}
