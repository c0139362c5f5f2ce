"""Design and outcome scoring over whole tables."""

from pyspark.sql import functions as F

from cohortlake import fixed_values as V
from cohortlake.functions import scoring as sc
from cohortlake.operators import outcomes as oc, portfolio as pf
from cohortlake.plans.registry import query
from cohortlake.sources.adapters import loader, view, with_views


def case(key: str, values: dict, otherwise: str) -> str:
    """A fixed table as a SQL CASE over doubles."""
    arms = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items())
    return f"CASE {key} {arms} ELSE {otherwise} END"


COST = (f"({case('phase', V.COST_BASE, '5000000e0')} + 15000e0 * enrollment + 50000e0 * (duration_days / 30))"
        f" * {case('therapeutic_area', V.COST_AREA_FACTOR, '1e0')}")
TRIAL_SCORES = """
people AS (SELECT trial_id, count(*) FILTER (NOT dropped_out) AS completed, count(*) FILTER (dropped_out) AS dropped
           FROM patients_v GROUP BY trial_id),
severe AS (SELECT trial_id, count(*) AS severe FROM adverse_events_v
           WHERE severity IN ('Severe', 'Life-threatening') GROUP BY trial_id),
base AS (SELECT p.trial_id, p.completed, p.dropped, coalesce(s.severe, 0) AS severe,
                greatest(p.completed + p.dropped, 1) AS total, t.expected_success_rate AS expected, t.phase
         FROM people p LEFT JOIN severe s ON p.trial_id = s.trial_id JOIN trials_v t ON p.trial_id = t.trial_id),
parts AS (SELECT *, greatest(3e-1, least(1e0, 1e0 - severe / total * 5e-1)) AS safety_score,
                 completed / total AS completion_rate FROM base),
eff AS (SELECT *, greatest(2e-1, least(1e0, expected + (completion_rate - 5e-1) * 3e-1)) AS efficacy_score FROM parts),
scored AS (SELECT *, efficacy_score * 7e-1 + safety_score * 3e-1 AS overall_score FROM eff)"""


@query(with_views(f"""SELECT trial_id, {COST} AS estimated_cost FROM trials_v""", "trials_v"))
def cost_estimate(spark, sf_dir):
    cost = sc.cost_estimate("phase", "therapeutic_area", "enrollment", "duration_days")
    return view(spark, sf_dir, "trials_v").select("trial_id", cost.alias("estimated_cost"))


@query(with_views(f"""SELECT trial_id, treatment_arm, round(3e-1 * {case('phase', V.AE_PHASE_FACTOR, '1e0')}
  * {case('therapeutic_area', V.AE_AREA_FACTOR, '1e0')} * CASE treatment_arm WHEN 'Placebo' THEN 7e-1 ELSE 1e0 END, 9)
  AS event_rate
FROM trials_v JOIN (SELECT DISTINCT trial_id, treatment_arm FROM patients_v) USING (trial_id)""",
                  "trials_v", "patients_v"))
def adverse_event_rate(spark, sf_dir):
    load = loader(spark, sf_dir)
    arms = load("patients_v").select("trial_id", "treatment_arm").distinct()
    rate = sc.adverse_event_rate("phase", "therapeutic_area", "treatment_arm")
    return load("trials_v").join(arms, "trial_id").select(
        "trial_id", "treatment_arm", F.round(rate, 9).alias("event_rate")
    )


@query(with_views("""
SELECT p.trial_id, p.age, p.comorbidity_count,
       t.dropout_rate * CASE WHEN age > 65 THEN 13e-1 WHEN age < 25 THEN 12e-1 ELSE 1e0 END
       * CASE WHEN comorbidity_count > 2 THEN 14e-1 WHEN comorbidity_count > 0 THEN 12e-1 ELSE 1e0 END AS risk
FROM patients_v p JOIN trials_v t ON p.trial_id = t.trial_id""", "patients_v", "trials_v"))
def patient_dropout_risk(spark, sf_dir):
    load = loader(spark, sf_dir)
    rates = load("trials_v").select("trial_id", "dropout_rate")
    return load("patients_v").join(rates, "trial_id").select(
        "trial_id", "age", "comorbidity_count",
        sc.dropout_risk("dropout_rate", "age", "comorbidity_count").alias("risk"),
    )


@query(with_views("""
SELECT p.trial_id, count(*) AS patients, round(max(t.dropout_rate) * CAST(sum(CAST(
       CASE WHEN age > 65 THEN 13e-1 WHEN age < 25 THEN 12e-1 ELSE 1e0 END
       * CASE WHEN comorbidity_count > 2 THEN 14e-1 WHEN comorbidity_count > 0 THEN 12e-1 ELSE 1e0 END
       AS DECIMAL(18,6))) AS DOUBLE), 6) AS expected_dropouts
FROM patients_v p JOIN trials_v t ON p.trial_id = t.trial_id GROUP BY p.trial_id""", "patients_v", "trials_v"))
def dropout_expected(spark, sf_dir):
    load = loader(spark, sf_dir)
    rows = oc.expected_dropouts(load("trials_v"), load("patients_v"))
    return rows.withColumn("expected_dropouts", F.round("expected_dropouts", 6))


@query(with_views(f""", {TRIAL_SCORES}
SELECT trial_id, completed, dropped, severe, safety_score, completion_rate, efficacy_score, overall_score,
       overall_score >= 7e-1 AS primary_endpoint_met,
       overall_score >= 7e-1 AND safety_score >= 6e-1 AND completion_rate >= 65e-2 AS success
FROM scored""", "trials_v", "patients_v", "adverse_events_v"))
def outcome_scores(spark, sf_dir):
    load = loader(spark, sf_dir)
    return oc.trial_outcomes(load("trials_v"), load("patients_v"), load("adverse_events_v"))


@query(with_views(f""", {TRIAL_SCORES}
SELECT trial_id, round({case('phase', V.PHASE_SUCCESS_RATE, "(SELECT avg(CAST(success AS INT)) FROM trials_v)")} * 4e-1
       + overall_score * 6e-1, 9) AS success_probability
FROM scored""", "trials_v", "patients_v", "adverse_events_v"))
def success_probability(spark, sf_dir):
    load = loader(spark, sf_dir)
    trials = load("trials_v")
    scored = oc.trial_outcomes(trials, load("patients_v"), load("adverse_events_v"), ("phase",))
    rate = pf.scalar(pf.portfolio_stats(trials, scale=2).select("success_rate"))["success_rate"]
    return scored.select(
        "trial_id",
        F.round(sc.success_probability("phase", "overall_score", rate), 9).alias("success_probability"),
    )


@query(with_views("""
SELECT trial_id, count(*) FILTER (severity = 'Mild') AS mild, count(*) FILTER (severity = 'Moderate') AS moderate,
       count(*) FILTER (severity = 'Severe') AS severe,
       count(*) FILTER (severity = 'Life-threatening') AS life_threatening
FROM adverse_events_v GROUP BY trial_id""", "adverse_events_v"))
def ae_by_severity(spark, sf_dir):
    return oc.events_by_severity(view(spark, sf_dir, "adverse_events_v"))


@query(with_views("""
SELECT trial_id, CASE phase WHEN 'Phase I' THEN 70 WHEN 'Phase II' THEN 50 WHEN 'Phase III' THEN 60
       WHEN 'Phase IV' THEN 75 ELSE 60 END
       + CASE WHEN enrollment < 100 THEN -5 WHEN enrollment > 500 THEN 5 ELSE 0 END
       + CASE WHEN dropout_rate > 25e-2 THEN -10 ELSE 0 END AS points,
       coalesce(nullif(concat_ws('; ', CASE WHEN dropout_rate > 2e-1 THEN 'High expected dropout rate' END,
         CASE WHEN duration_days > 730 THEN 'Long trial duration' END,
         CASE WHEN enrollment > 1000 THEN 'Large enrollment target' END,
         CASE WHEN therapeutic_area = 'Oncology' THEN 'Complex therapeutic area' END), ''),
         'Standard trial risks') AS risks
FROM trials_v""", "trials_v"))
def heuristic_prediction(spark, sf_dir):
    return view(spark, sf_dir, "trials_v").select(
        "trial_id",
        sc.heuristic_points("phase", "enrollment", "dropout_rate").alias("points"),
        F.array_join(sc.risk_factors("dropout_rate", "duration_days", "enrollment", "therapeutic_area"), "; ")
        .alias("risks"),
    )


@query(with_views("""
SELECT trial_id, phase, CAST(s AS INT) AS scenario FROM trials_v, range(0, 3) t(s)""", "trials_v"))
def scenario_grid(spark, sf_dir):
    designs = view(spark, sf_dir, "trials_v").select("trial_id", "phase")
    return oc.scenario_grid(designs, 3)


@query(with_views("""
SELECT p.trial_id, p.age, p.treatment_arm, t.min_age, t.max_age
FROM patients_v p JOIN trials_v t ON p.trial_id = t.trial_id AND p.age BETWEEN t.min_age AND t.max_age""",
                  "patients_v", "trials_v"))
def eligible_patients(spark, sf_dir):
    load = loader(spark, sf_dir)
    return oc.eligible_patients(load("trials_v"), load("patients_v")).select(
        "trial_id", "age", "treatment_arm", "min_age", "max_age"
    )


@query(with_views("""
SELECT t.trial_id, t.min_age, t.max_age, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS eligible
FROM trials_v t LEFT JOIN (SELECT age, count(*) AS n FROM patients_v GROUP BY age) a
  ON a.age BETWEEN t.min_age AND t.max_age
GROUP BY t.trial_id, t.min_age, t.max_age""", "patients_v", "trials_v"))
def eligible_pool_size(spark, sf_dir):
    load = loader(spark, sf_dir)
    return oc.eligible_pool_size(load("trials_v"), load("patients_v"))


@query(with_views("""
SELECT simulation_id,
       coalesce(patients_completed, 0) / nullif(patients_enrolled, 0) * 100e0 AS completion_pct,
       dropout_rate > 2e-1 AS above_average_dropout, estimated_cost / nullif(patients_enrolled, 0) AS cost_per_patient,
       actual_duration_days / 365 AS duration_years,
       CAST(floor(patients_enrolled * dropout_rate + 5e-1) AS BIGINT) AS dropout_count,
       coalesce(success_probability, 0e0) * 9e-1 AS efficacy_score, least(1e0 - dropout_rate, 95e-2) AS safety_score,
       coalesce(success_probability, 0e0) > 5e-1 AS success
FROM results_v""", "results_v"))
def result_metrics(spark, sf_dir):
    metrics = sc.result_metrics()
    return view(spark, sf_dir, "results_v").select(
        "simulation_id", *[c.alias(name) for name, c in metrics.items()]
    )


@query(with_views("""
SELECT simulation_id, CASE WHEN coalesce(success_probability, 0) >= 7e-1 THEN 'high'
         WHEN coalesce(success_probability, 0) >= 5e-1 THEN 'moderate' ELSE 'low' END AS band,
       CASE WHEN coalesce(success_probability, 0) >= 7e-1 THEN 'High probability of success. Trial design appears robust.'
         WHEN coalesce(success_probability, 0) >= 5e-1 THEN 'Moderate probability. Consider risk mitigation strategies.'
         ELSE 'Lower probability. Significant protocol optimization recommended.' END AS band_text,
       greatest(0e0, success_probability - 15e-2) + 0 * success_probability AS interval_lo,
       least(1e0, success_probability + 15e-2) + 0 * success_probability AS interval_hi,
       CAST(regexp_extract(confidence_interval, '\\(([0-9.]+), ([0-9.]+)\\)', 1) AS DOUBLE) AS stored_lo,
       CAST(regexp_extract(confidence_interval, '\\(([0-9.]+), ([0-9.]+)\\)', 2) AS DOUBLE) AS stored_hi
FROM results_v""", "results_v"))
def probability_bands(spark, sf_dir):
    rows = view(spark, sf_dir, "results_v").select(
        "simulation_id", sc.risk_band("success_probability").alias("band"),
        sc.probability_interval("success_probability").alias("i"),
        sc.stored_interval("confidence_interval").alias("s"),
    )
    return rows.select(
        "simulation_id", "band", sc.band_text("band").alias("band_text"),
        F.col("i.lo").alias("interval_lo"), F.col("i.hi").alias("interval_hi"),
        F.col("s.lo").alias("stored_lo"), F.col("s.hi").alias("stored_hi"),
    )


@query(with_views("""
SELECT trial_id, CAST(start_date + duration_days AS VARCHAR) AS completion_date, duration_days / 365 AS years
FROM trials_v""", "trials_v"))
def trial_timeline(spark, sf_dir):
    return view(spark, sf_dir, "trials_v").select(
        "trial_id", sc.completion_date("start_date", "duration_days").cast("string").alias("completion_date"),
        sc.years("duration_days").alias("years"),
    )


@query(with_views("""
SELECT trial_id, age, CAST(CASE WHEN dropped_out THEN enrollment_date + dropout_day END AS VARCHAR) AS dropout_date
FROM patients_v""", "patients_v"))
def patient_dropout_dates(spark, sf_dir):
    day = F.when(F.col("dropped_out"), sc.completion_date("enrollment_date", "dropout_day"))
    return view(spark, sf_dir, "patients_v").select("trial_id", "age", day.cast("string").alias("dropout_date"))


@query(with_views("""
SELECT trial_id, 'completed' AS patient_group, age FROM patients_v WHERE NOT dropped_out
UNION ALL SELECT trial_id, 'dropped', age FROM patients_v WHERE dropped_out""", "patients_v"))
def patient_groups_union(spark, sf_dir):
    # both groups in one pass over the patients
    return view(spark, sf_dir, "patients_v").select(
        "trial_id", F.when(F.col("dropped_out"), "dropped").otherwise("completed").alias("patient_group"), "age"
    )
