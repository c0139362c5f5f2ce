"""Advice, portfolio summaries and trial reports as text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortlake import fixed_values as V
from cohortlake.functions.scoring import band_text, heuristic_points, pick, risk_band, risk_factors
from cohortlake.functions.text import any_word, fill, fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lines(lines: list[str], **parts: Column) -> Column:
    return fill("\n".join(lines), **parts)


def heuristic_answer(phase, area, enrollment, days, dropout_rate) -> Column:
    """The heuristic prediction as a tagged answer, in the form ``parse_answer`` reads."""
    return fill(
        V.ANSWER_TEXT,
        points=heuristic_points(phase, enrollment, dropout_rate).cast("string"),
        confidence=F.lit(str(V.PREDICTION_CONFIDENCE)),
        risks=F.array_join(risk_factors(dropout_rate, days, enrollment, area), ", "),
        phase=F.coalesce(_col(phase), F.lit("")), area=F.coalesce(_col(area), F.lit("")),
        enrollment=_col(enrollment).cast("string"), years=fixed(_col(days) / F.lit(365), 1),
    )


def prediction_text(answer: Column) -> Column:
    """A parsed answer as readable text with numbered risks and the band's assessment."""
    numbered = F.transform(
        answer["risk_factors"], lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r, F.lit("\n"))
    )
    band = risk_band(answer["success_probability"])
    return fill(
        V.PREDICTION_TEXT,
        probability=fixed(answer["success_probability"] * 100, 1), confidence=fixed(answer["confidence_score"] * 100, 1),
        risks=F.array_join(numbered, ""), explanation=answer["explanation"],
        mark=pick(band, V.BAND_MARK, None), band=band_text(band),
    )


def _advice_tests(enrollment, days, dropout_rate, simulated_dropout) -> dict[str, Column]:
    always = F.lit(True)
    return {
        "enrollment": _col(enrollment) > 500,
        "duration": _col(days) > 730,
        "dropout": _col(dropout_rate) > 0.2,
        "cost": always,
        "endpoint": always,
        "safety": always,
        "alert": _col(simulated_dropout) > 0.25,
    }


def advice_codes(enrollment, days, dropout_rate, simulated_dropout) -> Column:
    """Codes of the advice that applies, in fixed order."""
    tests = _advice_tests(enrollment, days, dropout_rate, simulated_dropout)
    return F.array_compact(F.array(*[F.when(tests[code], F.lit(code)) for code, _ in V.ADVICE]))


def advice_text(enrollment, days, dropout_rate, simulated_dropout, endpoint) -> Column:
    """All advice that applies as one text."""
    tests = _advice_tests(enrollment, days, dropout_rate, simulated_dropout)
    parts = {
        "years": fixed(_col(days) / F.lit(365), 1),
        "endpoint": F.coalesce(_col(endpoint), F.lit("")),
        "dropout": fixed(_col(simulated_dropout) * 100, 1),
    }
    sections = [F.when(tests[code], _lines(lines, **parts)) for code, lines in V.ADVICE]
    return F.concat_ws("\n", F.lit(V.ADVICE_TITLE), *sections)


def portfolio_summary(question, stats: Column, phase_lines: Column, area_lines: Column) -> Column:
    """Portfolio figures with the sections the question asks for.

    ``stats`` is the one-row statistics struct; the two line texts hold one
    ``- value: n trials`` line per distribution entry.
    """
    low = F.lower(_col(question))
    head = _lines(
        V.SUMMARY_HEAD,
        total=stats["total_trials"].cast("string"),
        success=fixed(stats["success_rate"] * 100, 1),
        years=fixed(stats["avg_duration_days"] / 365, 1),
        enrollment=fixed(stats["avg_enrollment"], 0),
        dropout=fixed(stats["avg_dropout_rate"] * 100, 1),
        cost=fixed(stats["avg_cost"] / 1e6, 1),
    )
    blank = F.lit("")
    return F.concat_ws(
        "\n",
        head,
        F.when(any_word(low, V.SUMMARY_PHASE_WORDS),
               F.concat_ws("\n", F.lit(V.SUMMARY_PHASE_TITLE), phase_lines, blank)),
        F.when(any_word(low, V.SUMMARY_AREA_WORDS),
               F.concat_ws("\n", F.lit(V.SUMMARY_AREA_TITLE), area_lines, blank)),
        F.when(any_word(low, ["success", "factor"]), _lines(V.SUMMARY_FACTORS)),
        F.when(any_word(low, ["recommend", "suggest"]), _lines(V.SUMMARY_RECOMMEND)),
    )


def trial_report(stats: Column, generated: Column, has_design: Column, has_result: Column,
                 design: dict[str, Column], result: dict[str, Column]) -> Column:
    """Report of one trial: design, results, benchmarks; parts left out when missing."""
    percent = lambda c: fixed(c * 100, 1)
    design_part = _lines(
        V.REPORT_DESIGN, name=design["trial_name"], phase=F.coalesce(design["phase"], F.lit("")),
        area=design["therapeutic_area"], enrollment=design["enrollment"].cast("string"),
        years=fixed(design["duration_days"] / F.lit(365), 1),
    )
    result_part = _lines(
        V.REPORT_RESULT, probability=percent(result["success_probability"]),
        completed=result["patients_completed"].cast("string"), enrolled=result["patients_enrolled"].cast("string"),
        dropout=percent(result["dropout_rate"]), cost=fixed(result["estimated_cost"] / 1e6, 2),
        efficacy=percent(result["efficacy_score"]), safety=percent(result["safety_score"]),
    )
    benchmark = _lines(
        V.REPORT_BENCHMARK, success=percent(stats["success_rate"]),
        avg_years=fixed(stats["avg_duration_days"] / 365, 1), avg_dropout=percent(stats["avg_dropout_rate"]),
    )
    return F.concat_ws(
        "\n", _lines(V.REPORT_HEAD, now=generated), F.when(has_design, design_part),
        F.when(has_result, result_part), benchmark, _lines(V.REPORT_END),
    )
