"""Trials, drugs, patients and outcomes: filters, lookups, statistics, benchmarks."""

from pyspark.sql import functions as F

from cohortlake.operators import filters as flt, portfolio as pf
from cohortlake.plans.registry import query
from cohortlake.sources.adapters import loader, view, with_views
from cohortlake.functions.scoring import mean

# null-skipping mean of a fixed-point column, exact in both engines
AVG = "CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) / count({c})"


@query(with_views(f"""
SELECT count(*) AS total_trials, round({AVG.format(c='CAST(success AS INT)')}, 6) AS success_rate,
       round({AVG.format(c='duration_days')}, 6) AS avg_duration_days,
       round({AVG.format(c='enrollment')}, 6) AS avg_enrollment,
       round({AVG.format(c='dropout_rate')}, 6) AS avg_dropout_rate,
       round({AVG.format(c='cost_usd')}, 6) AS avg_cost
FROM trials_v""", "trials_v"))
def portfolio_stats(spark, sf_dir):
    stats = pf.portfolio_stats(view(spark, sf_dir, "trials_v"), scale=2)
    return stats.select("total_trials", *[F.round(c, 6).alias(c) for c in stats.columns[1:]])


@query(with_views("""
SELECT phase, count(*) AS trials FROM trials_v WHERE phase IS NOT NULL GROUP BY phase""", "trials_v"))
def phase_distribution(spark, sf_dir):
    return pf.distribution(view(spark, sf_dir, "trials_v"), "phase")


@query(with_views("""
SELECT therapeutic_area, count(*) AS trials FROM trials_v GROUP BY therapeutic_area""", "trials_v"))
def area_distribution(spark, sf_dir):
    return pf.distribution(view(spark, sf_dir, "trials_v"), "therapeutic_area")


@query(with_views("""
SELECT string_agg(concat(phase, '=', n), ';' ORDER BY n DESC, phase) AS phase_counts
FROM (SELECT phase, count(*) AS n FROM trials_v WHERE phase IS NOT NULL GROUP BY phase)""", "trials_v"))
def phase_distribution_map(spark, sf_dir):
    m = pf.distribution_map(view(spark, sf_dir, "trials_v"), "phase")
    entries = F.transform(
        F.map_entries("phase_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return m.select(F.array_join(entries, ";").alias("phase_counts"))


@query(with_views(f"""
SELECT therapeutic_area, count(*) AS trials, round({AVG.format(c='dropout_rate')}, 6) AS avg_dropout
FROM trials_v WHERE phase IN ('Phase II', 'Phase III') AND status = 'Completed'
GROUP BY therapeutic_area""", "trials_v"))
def filtered_portfolio(spark, sf_dir):
    rows, _ = flt.filter_by(
        view(spark, sf_dir, "trials_v"),
        {"phase": ["Phase II", "Phase III"], "status": "Completed", "sponsor": "unknown key"},
    )
    return rows.groupBy("therapeutic_area").agg(
        F.count(F.lit(1)).alias("trials"), F.round(mean("dropout_rate", 2), 6).alias("avg_dropout")
    )


@query(with_views("""
SELECT trial_id, trial_name, phase, enrollment, status, CAST(start_date AS VARCHAR) AS start_date
FROM trials_v WHERE phase IN ('Phase I', 'Phase IV') AND status = 'Active'""", "trials_v"))
def trials_filtered(spark, sf_dir):
    rows, _ = flt.filter_by(
        view(spark, sf_dir, "trials_v"), {"phase": ["Phase I", "Phase IV"], "status": "Active"}
    )
    return rows.select(
        "trial_id", "trial_name", "phase", "enrollment", "status",
        F.col("start_date").cast("string").alias("start_date"),
    )


@query(with_views("""
SELECT drug_id, drug_name, manufacturer, molecular_weight,
       CASE WHEN isfinite(bioavailability) THEN bioavailability END AS bioavailability
FROM drugs_v WHERE mechanism = 'ECONOMY'""", "drugs_v"))
def drugs_by_mechanism(spark, sf_dir):
    rows, _ = flt.filter_by(view(spark, sf_dir, "drugs_v"), {"mechanism": "ECONOMY"})
    return flt.clean_floats(rows).drop("mechanism")


@query(with_views("""
SELECT count(*) AS drugs, count(CASE WHEN isfinite(bioavailability) THEN 1 END) AS finite_values,
       round(CAST(sum(CAST(CASE WHEN isfinite(bioavailability) THEN bioavailability END AS DECIMAL(18,2))) AS DOUBLE)
             / count(CASE WHEN isfinite(bioavailability) THEN 1 END), 6) AS avg_bioavailability
FROM drugs_v""", "drugs_v"))
def clean_floats(spark, sf_dir):
    return flt.clean_floats(view(spark, sf_dir, "drugs_v")).agg(
        F.count(F.lit(1)).alias("drugs"),
        F.count("bioavailability").alias("finite_values"),
        F.round(mean("bioavailability", 2), 6).alias("avg_bioavailability"),
    )


@query(with_views("""
SELECT p.trial_id, p.age, p.comorbidity_count, p.treatment_arm
FROM patients_v p WHERE p.trial_id IN (SELECT trial_id FROM trials_v WHERE therapeutic_area = 'Oncology')""",
                  "patients_v", "trials_v"))
def trial_children(spark, sf_dir):
    load = loader(spark, sf_dir)
    parents = load("trials_v").where(F.col("therapeutic_area") == "Oncology")
    return flt.children_of_any(load("patients_v"), parents).select(
        "trial_id", "age", "comorbidity_count", "treatment_arm"
    )


@query(with_views("""
SELECT age, dropped_out, treatment_arm, count(*) AS patients
FROM patients_v WHERE trial_id = 'NCT00000007' GROUP BY ALL""", "patients_v"))
def one_trial_children(spark, sf_dir):
    rows = flt.children_of(view(spark, sf_dir, "patients_v"), "NCT00000007")
    return rows.groupBy("age", "dropped_out", "treatment_arm").agg(F.count(F.lit(1)).alias("patients"))


@query(with_views("""
SELECT c.claim_id, c.simulation_id, r.trial_id, r.patients_enrolled, r.success_probability,
       r.simulation_id IS NOT NULL AS found
FROM claims_v c LEFT JOIN results_v r ON r.simulation_id = c.simulation_id""", "claims_v", "results_v"))
def key_lookup(spark, sf_dir):
    load = loader(spark, sf_dir)
    results = load("results_v").select("simulation_id", "trial_id", "patients_enrolled", "success_probability")
    return flt.lookup(load("claims_v").select("claim_id", "simulation_id"), results, "simulation_id")


@query(with_views("""
SELECT c.claim_id, r.simulation_id IS NOT NULL AS known, coalesce(r.user_id = c.user_id, FALSE) AS allowed
FROM claims_v c LEFT JOIN results_v r ON r.simulation_id = c.simulation_id""", "claims_v", "results_v"))
def owner_claims(spark, sf_dir):
    load = loader(spark, sf_dir)
    return flt.check_claims(load("claims_v"), load("results_v")).select("claim_id", "known", "allowed")


@query(with_views("""
SELECT simulation_id, trial_id, patients_enrolled, success_probability
FROM results_v WHERE user_id = '42'""", "results_v"))
def owned_results(spark, sf_dir):
    return flt.owned_by(view(spark, sf_dir, "results_v"), "42").select(
        "simulation_id", "trial_id", "patients_enrolled", "success_probability"
    )


@query(with_views("""
SELECT trial_id, trial_name, phase, enrollment, CAST(start_date AS VARCHAR) AS start_date
FROM trials_v WHERE therapeutic_area = 'Oncology' AND phase = 'Phase II'
ORDER BY trials_v.start_date DESC, trial_id LIMIT 20""", "trials_v"))
def similar_trials(spark, sf_dir):
    rows = pf.similar_trials(view(spark, sf_dir, "trials_v"), "Oncology", "Phase II", 20)
    return rows.select(
        "trial_id", "trial_name", "phase", "enrollment", F.col("start_date").cast("string").alias("start_date")
    )


SIMILAR_REQUESTS = """
SELECT therapeutic_area, phase, CAST((min(enrollment) * 7 + max(enrollment)) % 25 AS INT) AS "limit" FROM trials_v
WHERE phase IS NOT NULL GROUP BY therapeutic_area, phase"""


def _similar_requests(trials):
    """One request per area and phase; some ask for more than is allowed."""
    named = trials.where(F.col("phase").isNotNull())
    return named.groupBy("therapeutic_area", "phase").agg(((F.min("enrollment") * 7 + F.max("enrollment")) % 25).alias("limit"))


@query(with_views(f"""
SELECT therapeutic_area, phase, "limit", 'limit must be 1 to 20' AS reason
FROM ({SIMILAR_REQUESTS}) WHERE "limit" < 1 OR "limit" > 20""", "trials_v"))
def similar_trials_refused(spark, sf_dir):
    return pf.refused_requests(_similar_requests(view(spark, sf_dir, "trials_v")))


@query(with_views(f"""
SELECT q.therapeutic_area, q.phase, q."limit", t.trial_id, CAST(t.rank AS INT) AS rank
FROM ({SIMILAR_REQUESTS}) q JOIN (
  SELECT *, row_number() OVER (PARTITION BY therapeutic_area, phase ORDER BY start_date DESC, trial_id) AS rank
  FROM trials_v WHERE phase IS NOT NULL) t
ON q.therapeutic_area = t.therapeutic_area AND q.phase = t.phase
WHERE q."limit" BETWEEN 1 AND 20 AND t.rank <= q."limit" """, "trials_v"))
def similar_trials_by_request(spark, sf_dir):
    trials = view(spark, sf_dir, "trials_v")
    return pf.similar_trials_for(_similar_requests(trials), trials).select(
        "therapeutic_area", "phase", "limit", "trial_id", "rank"
    )


@query(with_views("""
SELECT trial_id, phase, therapeutic_area, dropout_rate, CAST(start_date AS VARCHAR) AS start_date
FROM trials_v WHERE phase = 'Phase III' ORDER BY trials_v.start_date DESC, trial_id LIMIT 50""", "trials_v"))
def trial_history(spark, sf_dir):
    return pf.trial_history(view(spark, sf_dir, "trials_v"), phase="Phase III").select(
        "trial_id", "phase", "therapeutic_area", "dropout_rate",
        F.col("start_date").cast("string").alias("start_date"),
    )


@query(with_views("""
SELECT r.simulation_id, r.trial_id, r.success_probability, t.trial_name, t.phase, t.therapeutic_area, t.success
FROM results_v r LEFT JOIN trials_v t ON r.trial_id = t.trial_id""", "results_v", "trials_v"))
def results_with_trial(spark, sf_dir):
    load = loader(spark, sf_dir)
    return pf.results_with_trial(load("results_v"), load("trials_v")).select(
        "simulation_id", "trial_id", "success_probability", "trial_name", "phase", "therapeutic_area", "success"
    )


@query(with_views(f"""
SELECT trial_id, round(b.rate, 6) AS benchmark_success, round(b.days, 6) AS benchmark_duration_days,
       round(duration_days - b.days, 6) AS gap_duration_days, round(dropout_rate - b.dropout, 6) AS gap_dropout_rate,
       round(cost_usd - b.cost, 4) AS gap_cost_usd
FROM trials_v, (SELECT {AVG.format(c='CAST(success AS INT)')} AS rate, {AVG.format(c='duration_days')} AS days,
       {AVG.format(c='dropout_rate')} AS dropout, {AVG.format(c='cost_usd')} AS cost FROM trials_v) b""", "trials_v"))
def benchmark_gap(spark, sf_dir):
    trials = view(spark, sf_dir, "trials_v")
    rows = pf.with_benchmarks(trials, pf.portfolio_stats(trials, scale=2))
    return rows.select(
        "trial_id", F.round("benchmark_success", 6).alias("benchmark_success"),
        F.round("benchmark_duration_days", 6).alias("benchmark_duration_days"),
        F.round("gap_duration_days", 6).alias("gap_duration_days"),
        F.round("gap_dropout_rate", 6).alias("gap_dropout_rate"),
        F.round("gap_cost_usd", 4).alias("gap_cost_usd"),
    )
