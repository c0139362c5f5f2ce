"""Scores, estimates and bands of trial designs and results as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from cohortlake import fixed_values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick(key: Column | str, values: Mapping[str, float], otherwise: Column | float | None) -> Column:
    """Look ``key`` up in a small fixed table; a CASE stays inside generated code."""
    key = _col(key)
    chain = None
    for name, value in values.items():
        hit = key == name
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def exact_sum(value: Column | str, scale: int) -> Column:
    """Sum of a quantity with ``scale`` decimals, independent of partitioning and retries."""
    return F.sum(_col(value).cast(f"decimal(18,{scale})")).cast("double")


def mean(value: Column | str, scale: int | None = None) -> Column:
    """Null-skipping mean.

    With ``scale`` the values are taken as fixed-point numbers and summed
    exactly, which needs the column to have no more decimals than that.
    """
    c = _col(value)
    return F.avg(c) if scale is None else F.try_divide(exact_sum(c, scale), F.count(c))


def risk_band(probability: Column | str) -> Column:
    """high from 0.7, moderate from 0.5, else low; a missing value counts as 0."""
    p = F.coalesce(_col(probability), F.lit(0.0))
    return F.when(p >= 0.7, "high").when(p >= 0.5, "moderate").otherwise("low")


def band_text(band: Column | str) -> Column:
    return pick(band, V.BAND_TEXT, None)


def cost_estimate(phase, area, patients, days) -> Column:
    """(phase base + per-patient cost + monthly overhead) times the area factor."""
    base = pick(phase, V.COST_BASE, V.COST_BASE_OTHER)
    people = _col(patients).cast("bigint") * F.lit(V.COST_PER_PATIENT)
    months = _col(days) / F.lit(V.DAYS_PER_MONTH)
    factor = pick(area, V.COST_AREA_FACTOR, 1.0)
    return (base + people + months * F.lit(float(V.COST_PER_MONTH))) * factor


def success_probability(phase, overall_score, portfolio_rate) -> Column:
    """0.4 of the phase rate plus 0.6 of the overall score."""
    rate = pick(phase, V.PHASE_SUCCESS_RATE, _col(portfolio_rate))
    return rate * F.lit(0.4) + _col(overall_score) * F.lit(0.6)


def probability_interval(probability) -> Column:
    """The probability plus and minus 0.15 cut to [0, 1]."""
    p = _col(probability)
    width = F.lit(V.INTERVAL_HALF_WIDTH)
    return F.when(
        p.isNotNull(),
        F.struct(
            F.greatest(F.lit(0.0), p - width).alias("lo"), F.least(F.lit(1.0), p + width).alias("hi")
        ),
    )


def stored_interval(text) -> Column:
    """Read the stored form ``(a, b)`` into a struct."""
    t = _col(text)
    pattern = r"^\(\s*([^,\s]+)\s*,\s*([^,\s]+)\s*\)$"
    return F.struct(
        F.regexp_extract(t, pattern, 1).try_cast("double").alias("lo"),
        F.regexp_extract(t, pattern, 2).try_cast("double").alias("hi"),
    )


def heuristic_points(phase, enrollment, dropout_rate) -> Column:
    """Success estimate in percent points from phase, size and dropout."""
    size = _col(enrollment)
    return (
        pick(phase, V.PHASE_SUCCESS_POINTS, V.OTHER_SUCCESS_POINTS)
        + F.when(size < 100, -5).when(size > 500, 5).otherwise(0)
        + F.when(_col(dropout_rate) > 0.25, -10).otherwise(0)
    )


def risk_factors(dropout_rate, days, enrollment, area) -> Column:
    """Names of the risks that apply, or the one default name."""
    found = F.array_compact(
        F.array(
            F.when(_col(dropout_rate) > 0.2, V.RISK_NAMES["dropout"]),
            F.when(_col(days) > 730, V.RISK_NAMES["duration"]),
            F.when(_col(enrollment) > 1000, V.RISK_NAMES["enrollment"]),
            F.when(_col(area) == "Oncology", V.RISK_NAMES["area"]),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(V.RISK_NONE)))


def adverse_event_rate(phase, area, arm, control_arm="Placebo") -> Column:
    """Expected share of patients with an event; lower on the control arm."""
    control = F.lit(control_arm) if isinstance(control_arm, str) else control_arm
    base = F.lit(V.AE_BASE_RATE) * pick(phase, V.AE_PHASE_FACTOR, 1.0) * pick(area, V.AE_AREA_FACTOR, 1.0)
    return F.when(_col(arm) == control, base * F.lit(V.AE_CONTROL_FACTOR)).otherwise(base)


def dropout_risk(base_rate, age, comorbidities) -> Column:
    """Dropout probability of one patient from age and number of comorbidities."""
    a, n = _col(age), _col(comorbidities)
    return (
        _col(base_rate)
        * F.when(a > 65, 1.3).when(a < 25, 1.2).otherwise(1.0)
        * F.when(n > 2, 1.4).when(n > 0, 1.2).otherwise(1.0)
    )


def comorbidity_count(text) -> Column:
    """Number of comma-separated names; the text ``None`` means none."""
    t = F.trim(_col(text))
    return F.when(t.isNull() | t.isin("", "None"), 0).otherwise(F.size(F.split(t, r"\s*,\s*")))


def outcome_scores(completed, dropped, severe, expected_success) -> Column:
    """Safety, completion, efficacy and overall score with the two verdicts."""
    total = F.greatest(_col(completed) + _col(dropped), F.lit(1))
    safety = clip(F.lit(1.0) - _col(severe) / total * F.lit(0.5), 0.3, 1.0)
    completion = _col(completed) / total
    efficacy = clip(_col(expected_success) + (completion - F.lit(0.5)) * F.lit(0.3), 0.2, 1.0)
    overall = efficacy * F.lit(0.7) + safety * F.lit(0.3)
    met = overall >= V.ENDPOINT_THRESHOLD
    return F.struct(
        safety.alias("safety_score"),
        completion.alias("completion_rate"),
        efficacy.alias("efficacy_score"),
        overall.alias("overall_score"),
        met.alias("primary_endpoint_met"),
        (met & (safety >= 0.6) & (completion >= 0.65)).alias("success"),
    )


def result_metrics(enrolled="patients_enrolled", completed="patients_completed",
                   dropout="dropout_rate", days="actual_duration_days",
                   cost="estimated_cost", probability="success_probability") -> dict[str, Column]:
    """Per-result figures shown with a result; missing values count as zero."""
    zero = lambda c: F.coalesce(_col(c), F.lit(0))
    p, d = zero(probability).cast("double"), zero(dropout).cast("double")
    return {
        "completion_pct": F.try_divide(zero(completed), zero(enrolled)) * F.lit(100.0),
        "above_average_dropout": d > 0.2,
        "cost_per_patient": F.try_divide(zero(cost).cast("double"), zero(enrolled).cast("double")),
        "duration_years": zero(days) / F.lit(365),
        "dropout_count": F.floor(zero(enrolled) * d + F.lit(0.5)),
        "efficacy_score": p * F.lit(0.9),
        "safety_score": F.least(F.lit(1.0) - d, F.lit(0.95)),
        "success": p > 0.5,
    }


def completion_date(start, days) -> Column:
    return F.date_add(_col(start), _col(days))


def years(days) -> Column:
    return _col(days) / F.lit(365)
