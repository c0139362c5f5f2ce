"""Answers, contexts, advice, summaries and reports."""

from pyspark.sql import functions as F

from cohortlake import fixed_values as V
from cohortlake.functions import reports as rp, scoring as sc, text as tx
from cohortlake.operators import portfolio as pf
from cohortlake.plans.registry import query
from cohortlake.sources.adapters import loader, view, with_views


def _sql_text(lines: list[str], **values: str) -> str:
    text = "'" + "\n".join(lines).replace("'", "''") + "'"
    for name, value in values.items():
        if "{" + name + "}" in "\n".join(lines):
            text = f"replace({text}, '{{{name}}}', coalesce({value}, ''))"
    return text


def _fixed(value: str, decimals: int) -> str:
    return f"printf('%.{decimals}f', {value})"


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _tagged(tag: str, default: str) -> str:
    word = f"trim(regexp_extract(answer, '{tag}:\\s*(\\S+)', 1), '%')"
    value = f"CASE WHEN regexp_matches({word}, '{NUMBER}') THEN CAST({word} AS DOUBLE) / 100e0 END"
    return f"greatest(0e0, least(1e0, coalesce({value}, {default})))"


@query(with_views(f"""
SELECT answer_id, {_tagged('SUCCESS_PROBABILITY', '65e-2')} AS probability,
       {_tagged('CONFIDENCE', '75e-2')} AS confidence,
       CASE WHEN contains(answer, 'RISK_FACTORS:') THEN array_to_string(list_slice(list_filter(list_transform(
         string_split(string_split(string_split(answer, 'RISK_FACTORS:')[2], 'EXPLANATION:')[1], ','),
         lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 1, 5), '; ') ELSE '' END AS factors,
       CASE WHEN contains(answer, 'EXPLANATION:')
         THEN regexp_replace(string_split(answer, 'EXPLANATION:')[2], '^\\s+|\\s+$', '', 'g')
         ELSE 'Prediction based on trial parameters and historical data' END AS explanation
FROM answers_v""", "answers_v"))
def parse_answers(spark, sf_dir):
    parsed = view(spark, sf_dir, "answers_v").select("answer_id", tx.parse_answer("answer").alias("a"))
    return parsed.select(
        "answer_id", F.col("a.success_probability").alias("probability"), F.col("a.confidence_score").alias("confidence"),
        F.array_join("a.risk_factors", "; ").alias("factors"), F.col("a.explanation").alias("explanation"),
    )


POINTS = """(CASE phase WHEN 'Phase I' THEN 70 WHEN 'Phase II' THEN 50 WHEN 'Phase III' THEN 60 WHEN 'Phase IV' THEN 75 ELSE 60 END
  + CASE WHEN enrollment < 100 THEN -5 WHEN enrollment > 500 THEN 5 ELSE 0 END + CASE WHEN dropout_rate > 25e-2 THEN -10 ELSE 0 END)"""
RISKS = """list_filter([CASE WHEN dropout_rate > 2e-1 THEN 'High expected dropout rate' END,
  CASE WHEN duration_days > 730 THEN 'Long trial duration' END, CASE WHEN enrollment > 1000 THEN 'Large enrollment target' END,
  CASE WHEN therapeutic_area = 'Oncology' THEN 'Complex therapeutic area' END], lambda x: x IS NOT NULL)"""
EXPLAINED = (f"concat('This ', phase, ' trial in ', therapeutic_area, ' has a moderate success probability based on historical data. "
             f"The trial design appears feasible with ', enrollment, ' patients over ', {_fixed('duration_days / 365', 1)}, ' years.')")


@query(with_views(f"""
SELECT trial_id, concat('SUCCESS_PROBABILITY: ', {POINTS}, '%\nCONFIDENCE: 75%\nRISK_FACTORS: ',
       CASE WHEN len({RISKS}) = 0 THEN 'Standard trial risks' ELSE array_to_string({RISKS}, ', ') END,
       '\nEXPLANATION: ', {EXPLAINED}) AS answer
FROM trials_v""", "trials_v"))
def heuristic_answers(spark, sf_dir):
    answer = rp.heuristic_answer("phase", "therapeutic_area", "enrollment", "duration_days", "dropout_rate")
    return view(spark, sf_dir, "trials_v").select("trial_id", answer.alias("answer"))


@query(with_views(f"""
SELECT trial_id, concat('**Clinical Trial Success Prediction**\n\n**Predicted Success Probability: ', {_fixed('p / 100e0 * 100', 1)},
       '%**\nConfidence Score: 75.0%\n\n**Identified Risk Factors:**\n',
       array_to_string(list_transform(risks, lambda r, i: concat(i, '. ', r, chr(10))), ''), '\n**Analysis:**\n', explained, '\n\n',
       CASE WHEN p >= 70 THEN '✓ **Assessment**: High probability of success. Trial design appears robust.'
            WHEN p >= 50 THEN '⚠ **Assessment**: Moderate probability. Consider risk mitigation strategies.'
            ELSE '✗ **Assessment**: Lower probability. Significant protocol optimization recommended.' END) AS prediction
FROM (SELECT trial_id, {POINTS} AS p, CASE WHEN len({RISKS}) = 0 THEN ['Standard trial risks'] ELSE {RISKS} END AS risks,
             {EXPLAINED} AS explained FROM trials_v)""", "trials_v"))
def prediction_texts(spark, sf_dir):
    answer = rp.heuristic_answer("phase", "therapeutic_area", "enrollment", "duration_days", "dropout_rate")
    parsed = view(spark, sf_dir, "trials_v").select("trial_id", tx.parse_answer(answer).alias("a"))
    return parsed.select("trial_id", rp.prediction_text(F.col("a")).alias("prediction"))


@query(with_views("""
SELECT event_id, CASE WHEN json_valid(context) THEN json_extract_string(context, '$.k') END AS k,
       CASE WHEN NOT json_valid(context) THEN context END AS raw_context
FROM contexts_v""", "contexts_v"))
def context_json(spark, sf_dir):
    parsed = view(spark, sf_dir, "contexts_v").select("event_id", tx.parse_context("context").alias("c"))
    return parsed.select(
        "event_id", F.try_element_at("c", F.lit("k")).alias("k"),
        F.try_element_at("c", F.lit("raw_context")).alias("raw_context"),
    )


def _advice_inputs(spark, sf_dir):
    load = loader(spark, sf_dir)
    simulated = load("results_v").select("trial_id", F.col("dropout_rate").alias("simulated"))
    trials = load("trials_v")
    # results on the left: a trial with very many is then on the side that can be split
    without = trials.join(simulated, "trial_id", "left_anti").withColumn("simulated", F.lit(None).cast("double"))
    return simulated.join(trials, "trial_id").unionByName(without)


ADVICE_TESTS = {
    "enrollment": "enrollment > 500", "duration": "duration_days > 730", "dropout": "t.dropout_rate > 2e-1",
    "cost": "TRUE", "endpoint": "TRUE", "safety": "TRUE", "alert": "r.dropout_rate > 25e-2",
}
ADVICE_FROM = "FROM trials_v t LEFT JOIN results_v r ON t.trial_id = r.trial_id"


@query(with_views(f"""
SELECT t.trial_id, concat_ws(',', {', '.join(f"CASE WHEN {ADVICE_TESTS[c]} THEN '{c}' END" for c, _ in V.ADVICE)}) AS codes
{ADVICE_FROM}""", "trials_v", "results_v"))
def advice_codes(spark, sf_dir):
    codes = rp.advice_codes("enrollment", "duration_days", "dropout_rate", "simulated")
    return _advice_inputs(spark, sf_dir).select("trial_id", F.array_join(codes, ",").alias("codes"))


@query(with_views(f"""
SELECT code, therapeutic_area, count(*) AS trials FROM (
  SELECT t.therapeutic_area, unnest(string_split(concat_ws(',',
    {', '.join(f"CASE WHEN {ADVICE_TESTS[c]} THEN '{c}' END" for c, _ in V.ADVICE)}), ',')) AS code {ADVICE_FROM})
GROUP BY code, therapeutic_area""", "trials_v", "results_v"))
def advice_by_area(spark, sf_dir):
    codes = rp.advice_codes("enrollment", "duration_days", "dropout_rate", "simulated")
    return (
        _advice_inputs(spark, sf_dir).select("therapeutic_area", F.explode(codes).alias("code"))
        .groupBy("code", "therapeutic_area").agg(F.count(F.lit(1)).alias("trials"))
    )


_ADVICE_SECTIONS = ",\n".join(
    f"CASE WHEN {ADVICE_TESTS[code]} THEN "
    + _sql_text(lines, years=_fixed("duration_days / 365", 1), endpoint="t.indication",
                dropout=_fixed("r.dropout_rate * 100e0", 1)) + " END"
    for code, lines in V.ADVICE
)


@query(with_views(f"""
SELECT t.trial_id, concat_ws('\n', {_sql_text([V.ADVICE_TITLE])}, {_ADVICE_SECTIONS}) AS advice
{ADVICE_FROM}""", "trials_v", "results_v"))
def advice_texts(spark, sf_dir):
    text = rp.advice_text("enrollment", "duration_days", "dropout_rate", "simulated", "indication")
    return _advice_inputs(spark, sf_dir).select("trial_id", text.alias("advice"))


STATS_SQL = """
stats AS (SELECT count(*) AS total, avg(CAST(success AS INT)) AS success_rate, avg(duration_days) AS days,
  avg(enrollment) AS enrollment, CAST(sum(CAST(dropout_rate AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS dropout,
  CAST(sum(CAST(cost_usd AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS cost FROM trials_v)"""


def _distribution_sql(column: str) -> str:
    return (f"(SELECT string_agg(concat('- ', {column}, ': ', n, ' trials'), '\n' ORDER BY n DESC, {column}) FROM "
            f"(SELECT {column}, count(*) AS n FROM trials_v WHERE {column} IS NOT NULL GROUP BY {column}))")


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(query), '{w}')" for w in words) + ")"


@query(with_views(f""", {STATS_SQL}
SELECT question_id, concat_ws('\n',
  {_sql_text(V.SUMMARY_HEAD, total='CAST(total AS VARCHAR)', success=_fixed('success_rate * 100', 1),
             years=_fixed('days / 365', 1), enrollment=_fixed('stats.enrollment', 0),
             dropout=_fixed('dropout * 100', 1), cost=_fixed('cost / 1e6', 1))},
  CASE WHEN {_has(*V.SUMMARY_PHASE_WORDS)} THEN concat('{V.SUMMARY_PHASE_TITLE}\n', {_distribution_sql('phase')}, '\n') END,
  CASE WHEN {_has(*V.SUMMARY_AREA_WORDS)} THEN concat('{V.SUMMARY_AREA_TITLE}\n', {_distribution_sql('therapeutic_area')}, '\n') END,
  CASE WHEN {_has('success', 'factor')} THEN {_sql_text(V.SUMMARY_FACTORS)} END,
  CASE WHEN {_has('recommend', 'suggest')} THEN {_sql_text(V.SUMMARY_RECOMMEND)} END) AS summary
FROM questions_v, stats""", "trials_v", "questions_v"))
def portfolio_summary(spark, sf_dir):
    load = loader(spark, sf_dir)
    trials = load("trials_v")

    def lines(entries):
        each = F.transform(entries, lambda e: F.concat(F.lit("- "), e["value"], F.lit(": "), e["n"].cast("string"), F.lit(" trials")))
        return F.array_join(each, "\n")

    # one row from one scan, as a subquery that is worked out once
    with_stats = load("questions_v").select("question_id", "query", pf.scalar(pf.portfolio_overview(trials, 2)).alias("s")).select(
        "question_id", "query", "s", lines(F.col("s.phases")).alias("phases"), lines(F.col("s.areas")).alias("areas"))
    text = rp.portfolio_summary("query", F.col("s"), F.col("phases"), F.col("areas"))
    return with_stats.select("question_id", text.alias("summary"))


@query(with_views(f""", {STATS_SQL}
SELECT r.simulation_id, concat_ws('\n', {_sql_text(V.REPORT_HEAD, now="'2025-01-01 00:00:00'")},
  CASE WHEN t.trial_id IS NOT NULL THEN {_sql_text(V.REPORT_DESIGN, name='t.trial_name', phase='t.phase',
      area='t.therapeutic_area', enrollment='CAST(t.enrollment AS VARCHAR)', years=_fixed('t.duration_days / 365', 1))} END,
  CASE WHEN r.success_probability IS NOT NULL AND r.patients_completed IS NOT NULL THEN {_sql_text(V.REPORT_RESULT,
      probability=_fixed('r.success_probability * 100', 1), completed='CAST(r.patients_completed AS VARCHAR)',
      enrolled='CAST(r.patients_enrolled AS VARCHAR)', dropout=_fixed('r.dropout_rate * 100', 1),
      cost=_fixed('r.estimated_cost / 1e6', 2), efficacy=_fixed('r.success_probability * 9e-1 * 100', 1),
      safety=_fixed('least(1e0 - r.dropout_rate, 95e-2) * 100', 1))} END,
  {_sql_text(V.REPORT_BENCHMARK, success=_fixed('success_rate * 100', 1), avg_years=_fixed('days / 365', 1),
             avg_dropout=_fixed('dropout * 100', 1))},
  {_sql_text(V.REPORT_END)}) AS report
FROM results_v r LEFT JOIN trials_v t ON r.trial_id = t.trial_id, stats""", "results_v", "trials_v"))
def trial_report(spark, sf_dir):
    load = loader(spark, sf_dir)
    trials = load("trials_v")
    joined = pf.results_with_trial(load("results_v"), trials).withColumn(
        "s", pf.scalar(pf.portfolio_stats(trials, scale=2))
    )
    metrics = sc.result_metrics()
    result = {c: F.col(c) for c in ("success_probability", "patients_completed", "patients_enrolled",
                                    "dropout_rate", "estimated_cost")}
    result |= {c: metrics[c] for c in ("efficacy_score", "safety_score")}
    design = {c: F.col(c) for c in ("trial_name", "phase", "therapeutic_area", "enrollment", "duration_days")}
    report = rp.trial_report(
        F.col("s"), F.lit("2025-01-01 00:00:00"), F.col("trial_name").isNotNull(),
        F.col("success_probability").isNotNull() & F.col("patients_completed").isNotNull(), design, result,
    )
    return joined.select("simulation_id", report.alias("report"))
