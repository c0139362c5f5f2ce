"""Validation of rows and conversion of form text to stored types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake import fixed_values as V
from cohortlake.functions.text import strip


@dataclass(frozen=True)
class Rule:
    """A message and the condition under which a row is refused with it."""

    message: str
    broken: Column


def between(name: str, low: float | None = None, high: float | None = None) -> Rule:
    c = F.col(name)
    limits = " and ".join(
        ([f"at least {low}"] if low is not None else []) + ([f"at most {high}"] if high is not None else [])
    )
    outside = F.lit(False)
    if low is not None:
        outside = outside | (c < low)
    if high is not None:
        outside = outside | (c > high)
    return Rule(f"{name} must be {limits}", F.coalesce(outside, F.lit(True)) | F.isnan(c.cast("double")))


def text_length(name: str, low: int, high: int) -> Rule:
    size = F.length(name)
    return Rule(
        f"{name} must have {low} to {high} characters",
        F.coalesce((size < low) | (size > high), F.lit(True)),
    )


def one_of(name: str, allowed: list[str]) -> Rule:
    return Rule(f"{name} must be one of {', '.join(allowed)}", F.coalesce(~F.col(name).isin(allowed), F.lit(True)))


def required_text(name: str) -> Rule:
    return Rule(f"{name} is required", F.coalesce(strip(name) == "", F.lit(True)))


def smaller(low: str, high: str) -> Rule:
    return Rule(f"{low} must be less than {high}", F.coalesce(F.col(low) >= F.col(high), F.lit(True)))


def design_rules() -> list[Rule]:
    """Bounds of a trial design, flat columns."""
    return [
        required_text("trial_name"),
        text_length("trial_name", 3, 200),
        one_of("phase", V.PHASES),
        required_text("drug_name"),
        required_text("indication"),
        required_text("primary_endpoint"),
        between("target_enrollment", 10, 10000),
        between("duration_days", 30, 3650),
        between("min_age", 18),
        between("max_age", None, 100),
        smaller("min_age", "max_age"),
        between("arm_count", 1),
        between("expected_dropout_rate", 0, 1),
        between("expected_success_rate", 0, 1),
    ]


def flatten_design(df: DataFrame) -> DataFrame:
    """Nested design records as the flat columns the rules and scores read."""
    flat = [c for c in df.columns if c not in ("inclusion_criteria", "treatment_arms", "control_arm")]
    age = lambda name, default: F.coalesce(F.col(f"inclusion_criteria.{name}"), F.lit(default)).alias(name)
    return df.select(
        *flat, age("min_age", 18), age("max_age", 75),
        F.coalesce("control_arm", F.lit("Placebo")).alias("control_arm"),
        F.coalesce(F.size("treatment_arms"), F.lit(0)).alias("arm_count"), "treatment_arms",
    ).withColumns(
        {
            "expected_dropout_rate": F.coalesce("expected_dropout_rate", F.lit(0.15)),
            "expected_success_rate": F.coalesce("expected_success_rate", F.lit(0.7)),
        }
    )


def patient_rules() -> list[Rule]:
    """Bounds of patient demographics."""
    return [
        between("age", 18, 100),
        one_of("gender", V.GENDERS),
        between("weight_kg", 30, 300),
        between("height_cm", 100, 250),
    ]


def outcome_rules() -> list[Rule]:
    """Scores of an outcome lie in [0, 1]."""
    return [between(c, 0, 1) for c in ("efficacy_score", "safety_score", "overall_score")]


def request_rules() -> list[Rule]:
    """Adviser and simulation requests."""
    return [
        text_length("query", 10, 5000),
        one_of("agent_type", V.AGENT_TYPES),
        between("num_simulations", 1, 100),
    ]


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``errors``: all messages that apply to a row, in rule order."""
    found = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.message)) for r in rules]))
    return df.withColumn("errors", found)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their messages."""
    bad = F.size("errors") > 0
    return validated.where(~bad).drop("errors"), validated.where(bad)


def error_counts(validated: DataFrame) -> DataFrame:
    """How often each message applies."""
    return validated.select(F.explode("errors").alias("error")).groupBy("error").agg(
        F.count(F.lit(1)).alias("rows")
    )


def typed_form(df: DataFrame, ints: list[str] = (), doubles: list[str] = (),
               percents: list[str] = (), booleans: list[str] = ()) -> DataFrame:
    """Text fields to stored types; percents become fractions, unreadable text null."""
    changed = {c: _number(c, r"^[+-]?[0-9]+$", "int") for c in ints}
    decimal = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    changed |= {c: _number(c, decimal, "double") for c in doubles}
    changed |= {c: _number(c, decimal, "double") / F.lit(100.0) for c in percents}
    changed |= {c: F.lower(strip(c)) == "true" for c in booleans}
    return df.withColumns(changed)


def _number(name: str, pattern: str, kind: str) -> Column:
    text = strip(name)
    return F.when(text.rlike(pattern), text).try_cast(kind)
