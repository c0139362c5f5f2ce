"""Results analytics, validation, cleaning and form conversion."""

import uuid

from pyspark.sql import functions as F

from cohortlake.functions import text as tx
from cohortlake.operators import portfolio as pf, quality as q, results as rs
from cohortlake.plans.registry import ORACLES, query
from cohortlake.session import shared_folder
from cohortlake.sources import rank_index as ri, search_index as si
from cohortlake.sources.adapters import loader, view, with_views
from cohortlake.sources.tables import to_json_records


@query(with_views("""
SELECT count(*) AS total,
       round(CAST(sum(CAST(coalesce(success_probability, 0) AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS avg_success,
       round(CAST(sum(coalesce(patients_enrolled, 0)) AS DOUBLE) / count(*), 6) AS avg_patients,
       count(*) FILTER (patients_completed > 0) AS completed
FROM results_v""", "results_v"))
def dashboard_stats(spark, sf_dir):
    stats = rs.dashboard_stats(view(spark, sf_dir, "results_v"), scale=2)
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_success", "avg_patients")})


@query(with_views("""
SELECT r.simulation_id, t.trial_name, t.drug_name, t.phase
FROM results_v r LEFT JOIN trials_v t ON r.trial_id = t.trial_id
WHERE contains(lower(concat(r.simulation_id, ' ', coalesce(t.trial_name, ''), ' ', coalesce(t.drug_name, ''), ' ',
      coalesce(t.indication, ''), ' ', coalesce(t.phase, ''))), 'drug-42 cond')""", "results_v", "trials_v"))
def search_results(spark, sf_dir):
    load = loader(spark, sf_dir)
    rows = pf.results_with_trial(load("results_v"), load("trials_v"))
    return rs.search(rows, "DRUG-42 Cond").select("simulation_id", "trial_name", "drug_name", "phase")


@query(ORACLES["search_results"])
def indexed_search(spark, sf_dir):
    """The same search by way of postings."""
    load = loader(spark, sf_dir)
    rows = pf.results_with_trial(load("results_v"), load("trials_v"))
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    si.build_search_index(rows, path)
    return si.indexed_search(rows, path, "DRUG-42 Cond").select("simulation_id", "trial_name", "drug_name", "phase")


@query(with_views("""
SELECT simulation_id, patients_enrolled, success_probability, row_number() OVER () + 1200 AS position
FROM (SELECT * FROM results_v ORDER BY coalesce(patients_enrolled, 0) DESC, simulation_id LIMIT 12 OFFSET 1200)""", "results_v"))
def indexed_page(spark, sf_dir):
    """Page 101 from the index of positions."""
    rows = view(spark, sf_dir, "results_v").select("simulation_id", "patients_enrolled", "success_probability")
    path = f"{shared_folder(spark)}/ranks-{uuid.uuid4().hex}"
    ri.build_rank_index(rows, rs.sort_columns("patients_desc"), path)
    return ri.indexed_page(rows, path, 101)


@query(with_views("""
SELECT simulation_id, success_probability, patients_enrolled, position,
       CAST(floor((position - 1) / 12) AS BIGINT) + 1 AS page
FROM (SELECT *, row_number() OVER (ORDER BY coalesce(success_probability, 0) DESC, simulation_id) AS position
      FROM results_v)""", "results_v"))
def result_pages(spark, sf_dir):
    return rs.all_pages(view(spark, sf_dir, "results_v"), "success_desc").select(
        "simulation_id", "success_probability", "patients_enrolled", "position", "page"
    )


def _sorted_page_sql(order: str) -> str:
    return with_views(
        f"SELECT simulation_id, patients_enrolled, success_probability, CAST(CAST(created_at AS DATE) AS VARCHAR) AS created "
        f"FROM results_v ORDER BY {order}, simulation_id LIMIT 12 OFFSET 24", "results_v")


def _sorted_page(spark, sf_dir, by):
    return rs.page(view(spark, sf_dir, "results_v"), by, 3).select(
        "simulation_id", "patients_enrolled", "success_probability",
        F.col("created_at").cast("date").cast("string").alias("created"),
    )


@query(_sorted_page_sql("coalesce(created_at, TIMESTAMP '1970-01-01') DESC"))
def page_newest_first(spark, sf_dir):
    return _sorted_page(spark, sf_dir, "date_desc")


@query(_sorted_page_sql("coalesce(created_at, TIMESTAMP '1970-01-01')"))
def page_oldest_first(spark, sf_dir):
    return _sorted_page(spark, sf_dir, "date_asc")


@query(_sorted_page_sql("coalesce(success_probability, 0) DESC"))
def page_highest_success(spark, sf_dir):
    return _sorted_page(spark, sf_dir, "success_desc")


@query(_sorted_page_sql("coalesce(success_probability, 0)"))
def page_lowest_success(spark, sf_dir):
    return _sorted_page(spark, sf_dir, "success_asc")


@query(_sorted_page_sql("coalesce(patients_enrolled, 0) DESC"))
def page_most_patients(spark, sf_dir):
    return _sorted_page(spark, sf_dir, "patients_desc")


@query(_sorted_page_sql("coalesce(patients_enrolled, 0)"))
def page_least_patients(spark, sf_dir):
    return _sorted_page(spark, sf_dir, "patients_asc")


@query(with_views("""
SELECT count(*) AS "rows", CAST(ceil(count(*) / 12) AS BIGINT) AS pages FROM results_v""", "results_v"))
def page_count(spark, sf_dir):
    return rs.page_count(view(spark, sf_dir, "results_v"))


@query(with_views("""
SELECT user_id, simulation_id, concat('- ID: ', simulation_id, ', Patients Enrolled: ', patients_enrolled,
       ', Patients Completed: ', coalesce(CAST(patients_completed AS VARCHAR), 'N/A'),
       ', Success Probability: ', coalesce(CAST(success_probability AS VARCHAR), 'N/A'),
       ', Cost: $', estimated_cost) AS line
FROM results_v""", "results_v"))
def result_lines(spark, sf_dir):
    return rs.result_lines(view(spark, sf_dir, "results_v"))


@query(with_views("""
SELECT 'trials' AS table_name, count(*) AS "rows" FROM trials_v
UNION ALL SELECT 'results', count(*) FROM results_v UNION ALL SELECT 'patients', count(*) FROM patients_v
UNION ALL SELECT 'chat', count(*) FROM chat_v""", "trials_v", "results_v", "patients_v", "chat_v"))
def row_counts(spark, sf_dir):
    load = loader(spark, sf_dir)
    return rs.row_counts(
        trials=load("trials_v"), results=load("results_v"), patients=load("patients_v"), chat=load("chat_v")
    )


RULES_SQL = """
concat_ws(' | ',
  CASE WHEN trim(trial_name) = '' THEN 'trial_name is required' END,
  CASE WHEN length(trial_name) NOT BETWEEN 3 AND 200 THEN 'trial_name must have 3 to 200 characters' END,
  CASE WHEN phase NOT IN ('Phase I', 'Phase II', 'Phase III', 'Phase IV')
       THEN 'phase must be one of Phase I, Phase II, Phase III, Phase IV' END,
  CASE WHEN drug_name IS NULL THEN 'drug_name is required' END,
  CASE WHEN primary_endpoint = '' THEN 'primary_endpoint is required' END,
  CASE WHEN target_enrollment NOT BETWEEN 10 AND 10000 THEN 'target_enrollment must be at least 10 and at most 10000' END,
  CASE WHEN duration_days NOT BETWEEN 30 AND 3650 THEN 'duration_days must be at least 30 and at most 3650' END,
  CASE WHEN min_age < 18 THEN 'min_age must be at least 18' END,
  CASE WHEN max_age > 100 THEN 'max_age must be at most 100' END,
  CASE WHEN min_age >= max_age THEN 'min_age must be less than max_age' END,
  CASE WHEN arm_count < 1 THEN 'arm_count must be at least 1' END,
  CASE WHEN expected_dropout_rate NOT BETWEEN 0 AND 1 THEN 'expected_dropout_rate must be at least 0 and at most 1' END,
  CASE WHEN expected_success_rate NOT BETWEEN 0 AND 1 THEN 'expected_success_rate must be at least 0 and at most 1' END
)"""


@query(with_views(f"SELECT design_id, {RULES_SQL} AS errors FROM designs_v", "designs_v"))
def validation_report(spark, sf_dir):
    checked = q.validate(view(spark, sf_dir, "designs_v"), q.design_rules())
    return checked.select("design_id", F.array_join("errors", " | ").alias("errors"))


# some designs without inclusion criteria, and some without expectations
NESTED = """
SELECT * REPLACE (
  CASE WHEN design_id % 5 = 0 THEN 18 ELSE min_age END AS min_age, CASE WHEN design_id % 5 = 0 THEN 75 ELSE max_age END AS max_age,
  CASE WHEN design_id % 3 = 0 THEN 15e-2 ELSE expected_dropout_rate END AS expected_dropout_rate) FROM designs_v"""


@query(with_views(f"SELECT design_id, {RULES_SQL} AS errors, 'Placebo' AS control_arm FROM ({NESTED})", "designs_v"))
def nested_design(spark, sf_dir):
    """Design records with nested criteria and arms, made flat and validated."""
    designs = view(spark, sf_dir, "designs_v")
    nested = designs.select(
        *[c for c in designs.columns if c not in ("min_age", "max_age", "arm_count", "expected_dropout_rate")],
        F.when(F.col("design_id") % 5 != 0, F.struct("min_age", "max_age")).alias("inclusion_criteria"),
        F.array_repeat(F.lit("Drug"), F.col("arm_count")).alias("treatment_arms"), F.lit(None).cast("string").alias("control_arm"),
        F.when(F.col("design_id") % 3 != 0, F.col("expected_dropout_rate")).alias("expected_dropout_rate"),
    )
    checked = q.validate(q.flatten_design(nested), q.design_rules())
    return checked.select("design_id", F.array_join("errors", " | ").alias("errors"), "control_arm")


SCORES_SQL = """
SELECT trial_id, expected_success_rate * 125e-2 AS efficacy_score, dropout_rate - 1e-1 AS safety_score,
       CASE WHEN adverse_events % 13 <> 0 THEN CAST(adverse_events AS DOUBLE) / 40 END AS overall_score FROM trials_v"""


@query(with_views(f"""
SELECT trial_id, concat_ws(' | ', {", ".join(
    f"CASE WHEN {c} IS NULL OR {c} NOT BETWEEN 0 AND 1 THEN '{c} must be at least 0 and at most 1' END"
    for c in ("efficacy_score", "safety_score", "overall_score"))}) AS errors FROM ({SCORES_SQL})""", "trials_v"))
def outcome_validation(spark, sf_dir):
    """Outcome scores outside [0, 1], or missing."""
    scores = view(spark, sf_dir, "trials_v").select(
        "trial_id", (F.col("expected_success_rate") * 1.25).alias("efficacy_score"), (F.col("dropout_rate") - 0.1).alias("safety_score"),
        F.when(F.col("adverse_events") % 13 != 0, F.col("adverse_events").cast("double") / 40).alias("overall_score"))
    return q.validate(scores, q.outcome_rules()).select("trial_id", F.array_join("errors", " | ").alias("errors"))


@query(with_views(f"""
SELECT design_id, trial_name, phase, target_enrollment FROM designs_v WHERE {RULES_SQL} = ''""", "designs_v"))
def valid_designs(spark, sf_dir):
    good, _ = q.split_valid(q.validate(view(spark, sf_dir, "designs_v"), q.design_rules()))
    return good.select("design_id", "trial_name", "phase", "target_enrollment")


@query(with_views(f"""
SELECT error, count(*) AS "rows" FROM (SELECT unnest(string_split({RULES_SQL}, ' | ')) AS error FROM designs_v)
WHERE error <> '' GROUP BY error""", "designs_v"))
def error_counts(spark, sf_dir):
    return q.error_counts(q.validate(view(spark, sf_dir, "designs_v"), q.design_rules()))


@query(with_views("""
SELECT form_id, CAST(patients_enrolled AS INT) AS patients_enrolled,
       TRY_CAST(dropout_percent AS DOUBLE) / 100e0 AS dropout_percent,
       lower(primary_endpoint_met) = 'true' AS primary_endpoint_met, TRY_CAST(estimated_cost AS DOUBLE) AS estimated_cost
FROM forms_v""", "forms_v"))
def typed_form(spark, sf_dir):
    return q.typed_form(
        view(spark, sf_dir, "forms_v"), ints=["patients_enrolled"], doubles=["estimated_cost"],
        percents=["dropout_percent"], booleans=["primary_endpoint_met"],
    )


@query(with_views("""
SELECT trial_id, array_to_string(list_slice(string_split(trim(regexp_replace(lower(trial_name), '[^a-z0-9]+', '_', 'g'),
       '_'), '_'), 1, 4), '_') AS slug,
       concat('PAT-', substr(trial_id, 1, 8), '-', lpad(CAST(enrollment AS VARCHAR), 4, '0')) AS patient
FROM trials_v""", "trials_v"))
def slug(spark, sf_dir):
    return view(spark, sf_dir, "trials_v").select(
        "trial_id", tx.name_slug("trial_name").alias("slug"), tx.patient_id("trial_id", "enrollment").alias("patient")
    )


@query(with_views("""
SELECT concat('{"simulation_id":"', simulation_id, '","trial_id":',
       coalesce('"' || trial_id || '"', 'null'), ',"patients_enrolled":', patients_enrolled,
       ',"patients_completed":', coalesce(CAST(patients_completed AS VARCHAR), 'null'), '}') AS record
FROM results_v""", "results_v"))
def json_records(spark, sf_dir):
    return to_json_records(
        view(spark, sf_dir, "results_v").select("simulation_id", "trial_id", "patients_enrolled", "patients_completed")
    )


PATIENT_RULES_SQL = """concat_ws(' | ',
  CASE WHEN age NOT BETWEEN 18 AND 100 THEN 'age must be at least 18 and at most 100' END,
  CASE WHEN coalesce(gender NOT IN ('Male', 'Female', 'Other'), TRUE) THEN 'gender must be one of Male, Female, Other' END,
  CASE WHEN weight_kg NOT BETWEEN 30 AND 300 THEN 'weight_kg must be at least 30 and at most 300' END,
  CASE WHEN height_cm NOT BETWEEN 100 AND 250 THEN 'height_cm must be at least 100 and at most 250' END)"""


@query(with_views(f"SELECT form_id, {PATIENT_RULES_SQL} AS errors FROM patient_forms_v", "patient_forms_v"))
def patient_validation(spark, sf_dir):
    checked = q.validate(view(spark, sf_dir, "patient_forms_v"), q.patient_rules())
    return checked.select("form_id", F.array_join("errors", " | ").alias("errors"))


@query(with_views("""
SELECT request_id, concat_ws(' | ',
  CASE WHEN length(query) NOT BETWEEN 10 AND 5000 THEN 'query must have 10 to 5000 characters' END,
  CASE WHEN coalesce(agent_type NOT IN ('research', 'prediction', 'optimization', 'report'), TRUE)
       THEN 'agent_type must be one of research, prediction, optimization, report' END,
  CASE WHEN num_simulations NOT BETWEEN 1 AND 100 THEN 'num_simulations must be at least 1 and at most 100' END) AS errors
FROM requests_v""", "requests_v"))
def request_validation(spark, sf_dir):
    checked = q.validate(view(spark, sf_dir, "requests_v"), q.request_rules())
    return checked.select("request_id", F.array_join("errors", " | ").alias("errors"))


@query(with_views("""
SELECT trial_id,
  array_to_string(string_split(trim(regexp_replace(lower(trial_name), '[^a-z0-9]+', '_', 'g'), '_'), '_')[1:4], '_') AS slug,
  TRUE AS four_digits, TRUE AS stable FROM trials_v""", "trials_v"))
def readable_ids(spark, sf_dir):
    """The id of each trial taken apart: its slug, the shape of its number, and the same id when made again."""
    from cohortlake.functions import text as tx

    made = view(spark, sf_dir, "trials_v").select(
        "trial_id", tx.readable_id("trial_name", "trial_id").alias("a"),
        tx.readable_id("trial_name", F.concat("trial_id", F.lit(""))).alias("b"))
    return made.select(
        "trial_id", F.regexp_replace("a", "_[0-9]{4}$", "").alias("slug"),
        F.col("a").rlike("_[1-9][0-9]{3}$").alias("four_digits"), (F.col("a") == F.col("b")).alias("stable"))
