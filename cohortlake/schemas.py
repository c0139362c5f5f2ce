"""Declared schemas of the stored tables and of the nested design record."""

from pyspark.sql import types as T


KINDS = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(),
    "TEXTS": T.ArrayType(T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """Nullable fields from ``name KIND`` pairs; needs no running session."""
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in pairs])


TRIALS = _struct(
    "trial_id STRING, trial_name STRING, phase STRING, therapeutic_area STRING, drug_name STRING, "
    "indication STRING, enrollment INT, duration_days INT, status STRING, success BOOLEAN, "
    "dropout_rate DOUBLE, adverse_events INT, cost_usd BIGINT, start_date DATE, completion_date DATE"
)
DRUGS = _struct(
    "drug_id STRING, drug_name STRING, mechanism STRING, molecular_weight DOUBLE, "
    "bioavailability DOUBLE, half_life_hours DOUBLE, target_indication STRING, "
    "development_stage STRING, manufacturer STRING"
)
PATIENTS = _struct(
    "patient_id STRING, age INT, gender STRING, ethnicity STRING, weight_kg DOUBLE, "
    "height_cm DOUBLE, bmi DOUBLE, comorbidities STRING, enrollment_date DATE, trial_id STRING"
)
OUTCOMES = _struct(
    "outcome_id STRING, trial_id STRING, primary_endpoint_met BOOLEAN, efficacy_score DOUBLE, "
    "safety_score DOUBLE, overall_score DOUBLE, dropout_count INT, adverse_events_count INT, "
    "serious_adverse_events INT, completion_rate DOUBLE, statistical_significance BOOLEAN"
)
RESULTS = _struct(
    "simulation_id STRING, trial_id STRING, user_id STRING, patients_enrolled INT, "
    "patients_completed INT, dropout_rate DOUBLE, actual_duration_days INT, completion_date DATE, "
    "estimated_cost DOUBLE, success_probability DOUBLE, confidence_interval STRING, "
    "research_insights STRING, optimization_suggestions STRING, created_at TIMESTAMP, "
    "updated_at TIMESTAMP"
)
CHAT = _struct(
    "chat_id STRING, user_id STRING, simulation_id STRING, timestamp TIMESTAMP, message STRING, "
    "response STRING, language STRING, action_type STRING"
)
USERS = _struct(
    "index INT, first_name STRING, last_name STRING, username STRING, email STRING, password STRING"
)
LOGINS = _struct(
    "timestamp TIMESTAMP, user_id STRING, username STRING, ip_address STRING, country STRING, "
    "region STRING, city STRING, latitude DOUBLE, longitude DOUBLE, isp STRING, timezone STRING"
)
ADVERSE_EVENTS = _struct(
    "trial_id STRING, event_type STRING, severity STRING, patient_id STRING, "
    "occurrence_day INT, resolved BOOLEAN"
)
CRITERIA = _struct("min_age INT, max_age INT, required_biomarkers TEXTS, excluded_conditions TEXTS")
DESIGN = T.StructType(
    _struct(
        "trial_id STRING, trial_name STRING, phase STRING, therapeutic_area STRING, drug_name STRING, "
        "indication STRING, target_enrollment INT"
    ).fields
    + [T.StructField("inclusion_criteria", CRITERIA)]
    + _struct(
        "duration_days INT, primary_endpoint STRING, secondary_endpoints TEXTS, treatment_arms TEXTS, "
        "control_arm STRING, expected_dropout_rate DOUBLE, expected_success_rate DOUBLE"
    ).fields
)
INTERVAL = _struct("lo DOUBLE, hi DOUBLE")

TABLES = {
    "trials": TRIALS,
    "drugs": DRUGS,
    "patients": PATIENTS,
    "outcomes": OUTCOMES,
    "simulation_results": RESULTS,
    "chat_history": CHAT,
    "users": USERS,
    "login_history": LOGINS,
    "adverse_events": ADVERSE_EVENTS,
}
