"""Writing and reading back: appends, exports, versions and the login history."""

import uuid

from pyspark.sql import functions as F, types as T

from cohortlake.operators import logins as lg
from cohortlake.plans.registry import query
from cohortlake.schemas import CHAT, LOGINS, RESULTS
from cohortlake.session import shared_folder
from cohortlake.sources import tables as tb
from cohortlake.sources.adapters import loader, view, with_views
from cohortlake.sources.split_csv import read_split_csv
from cohortlake.sources.versions import read_current, replace_table

COLUMNS = ["simulation_id", "trial_id", "user_id", "patients_enrolled", "patients_completed", "dropout_rate",
           "estimated_cost", "success_probability"]
STORED = "SELECT " + ", ".join(COLUMNS) + " FROM results_v"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


@query(with_views(f"""
{STORED} UNION ALL
SELECT concat('new_', trial_id), trial_id, NULL, enrollment, NULL, dropout_rate, cost_usd, NULL FROM trials_v""",
                  "results_v", "trials_v"))
def append_results(spark, sf_dir):
    """New results, with a nested field to drop, appended by name to a created table."""
    load = loader(spark, sf_dir)
    new = load("trials_v").select(
        F.concat(F.lit("new_"), "trial_id").alias("simulation_id"), "trial_id",
        F.col("enrollment").alias("patients_enrolled"), "dropout_rate", F.col("cost_usd").alias("estimated_cost"),
        F.array("drug_name").alias("optimization_suggestions"),
    )
    path = _folder(spark)
    tb.create_if_absent(spark, path, RESULTS)
    tb.append(tb.append_by_name(spark.createDataFrame([], RESULTS), load("results_v")), path)
    tb.append(tb.results_to_append(new, RESULTS), path)
    return tb.read_table(spark, path, RESULTS).select(*COLUMNS)


def _round_trip(spark, sf_dir, fmt):
    path = _folder(spark)
    rows = view(spark, sf_dir, "results_v").select(*COLUMNS)
    tb.export(rows, path, fmt)
    if fmt == "csv":
        return tb.read_csv_table(spark, path, rows.schema)
    return spark.read.schema(rows.schema).format(fmt).load(path)


@query(with_views(STORED, "results_v"))
def csv_export(spark, sf_dir):
    return _round_trip(spark, sf_dir, "csv")


@query(with_views(STORED, "results_v"))
def json_export(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json")


@query(with_views(STORED, "results_v"))
def parquet_export(spark, sf_dir):
    return _round_trip(spark, sf_dir, "parquet")


@query(with_views(STORED + " WHERE patients_completed IS NOT NULL", "results_v"))
def replaced_table(spark, sf_dir):
    """A table replaced by a part of itself while it is read."""
    path = _folder(spark)
    replace_table(view(spark, sf_dir, "results_v").select(*COLUMNS), path)
    replace_table(read_current(spark, path).where(F.col("patients_completed").isNotNull()), path)
    return read_current(spark, path)


@query(with_views("""
SELECT user_id, ip_address, coalesce(country, 'Unknown') AS country, coalesce(city, 'Unknown') AS city,
       CAST(l.timestamp AS VARCHAR) AS logged_at
FROM (SELECT user_id, timestamp, coalesce(trim(string_split(x_forwarded_for, ',')[1]), x_real_ip, peer, 'unknown') AS ip_address
      FROM logins_v) l LEFT JOIN (SELECT * FROM address_places_v UNION ALL
      SELECT DISTINCT x_real_ip, 'Localhost', NULL, 'Local Machine', NULL, NULL, NULL, NULL FROM logins_v
      WHERE starts_with(x_real_ip, '192.168.') UNION ALL
      SELECT 'unknown', 'Localhost', NULL, 'Local Machine', NULL, NULL, NULL, NULL) p USING (ip_address)""",
                  "logins_v", "address_places_v"))
def login_history(spark, sf_dir):
    """Logins placed and appended to the login history."""
    load = loader(spark, sf_dir)
    placed = lg.place_by_address(lg.with_address(load("logins_v")), load("address_places_v"))
    path = _folder(spark)
    tb.create_if_absent(spark, path, LOGINS)
    tb.append(lg.audit_rows(placed), path)
    return tb.read_table(spark, path, LOGINS).select(
        "user_id", "ip_address", "country", "city", F.col("timestamp").cast("string").alias("logged_at")
    )


@query(with_views("""
SELECT CAST(user_id AS VARCHAR) AS user_id, message, 'en' AS language, 'chat' AS action_type, '' AS simulation_id,
  count(*) AS rows, count(*) AS ids FROM chat_v GROUP BY user_id, message""", "chat_v"))
def chat_append(spark, sf_dir):
    """Messages appended with an id and a time of their own, counted by what was said."""
    rows = view(spark, sf_dir, "chat_v").select(
        F.col("user_id").cast("string").alias("user_id"), F.lit(None).cast("string").alias("simulation_id"), "message",
        F.lit("").alias("response"), F.lit("en").alias("language"), F.lit("chat").alias("action_type"),
    )
    path = _folder(spark)
    tb.create_if_absent(spark, path, CHAT)
    tb.append(tb.chat_to_append(rows), path)
    stored = tb.read_table(spark, path, CHAT).where(F.col("timestamp").isNotNull())
    return stored.groupBy("user_id", "message", "language", "action_type", "simulation_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("chat_id").alias("ids"))


@query(with_views("""
SELECT form_id, patients_enrolled, dropout_percent FROM forms_v WHERE dropout_percent = 'n/a'""", "forms_v"))
def csv_rejects(spark, sf_dir):
    """Rows of a CSV file whose values do not fit their declared types."""
    path = _folder(spark)
    forms = view(spark, sf_dir, "forms_v").select("form_id", "patients_enrolled", "dropout_percent")
    tb.export(forms, path, "csv")
    declared = T.StructType([T.StructField("form_id", T.LongType()), T.StructField("patients_enrolled", T.IntegerType()),
                             T.StructField("dropout_percent", T.DoubleType())])
    return tb.csv_rejects(spark, path, declared).withColumn("form_id", F.col("form_id").cast("long"))


@query(with_views("""
SELECT chat_id, concat('"', message, '"', chr(10), 'said by ', user_id, ', or not') AS message, chat_id / 4 AS quarter
FROM chat_v""", "chat_v"))
def csv_split_scan(spark, sf_dir):
    """Messages with quotes and line breaks, written as CSV and read back in splits."""
    path = _folder(spark)
    text = F.concat(F.lit('"'), "message", F.lit('"\n'), F.lit("said by "), "user_id", F.lit(", or not"))
    rows = view(spark, sf_dir, "chat_v").select("chat_id", text.alias("message"), (F.col("chat_id") / 4).alias("quarter"))
    tb.export(rows, path, "csv")
    return read_split_csv(spark, path, rows.schema)
