"""The streaming jobs run over everything available, then read back."""

import uuid

from pyspark.sql import functions as F

from cohortlake.plans import chat_queries  # noqa: F401  (fills ORACLES)
from cohortlake.plans.registry import ORACLES, query
from cohortlake.session import shared_folder
from cohortlake.sources.adapters import VIEWS, table, view, with_views
from cohortlake.sources.versions import replace_table
from cohortlake.streaming.changes import apply_change_stream, read_changed
from cohortlake.streaming.ingest import append_stream, chat_events, file_stream, login_events
from cohortlake.streaming.sessions import route_stream, routed


def _events_view(spark, sf_dir, name, files_per_trigger=None):
    """A view over ``events`` as a stream."""
    # a glob, because the table may be one file or a folder of files
    stream = file_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema, files_per_trigger)
    return spark.sql(VIEWS[name], events=stream)


def _run_folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(ORACLES["message_intents"])
def chat_ingest_stream(spark, sf_dir):
    root = _run_folder(spark)
    messages = chat_events(_events_view(spark, sf_dir, "chat_v"))
    append_stream(messages, f"{root}/chat", f"{root}/progress", "chat_id").awaitTermination()
    return spark.read.parquet(f"{root}/chat").select(
        "chat_id", "word", "named_id", "field", "new_value", "asks_translation", "translation_target"
    )


@query(with_views("""
SELECT login_id, ip_address, ip_address IN ('127.0.0.1', 'localhost', 'unknown') OR starts_with(ip_address, '192.168.')
       AS private
FROM (SELECT login_id, coalesce(trim(string_split(x_forwarded_for, ',')[1]), x_real_ip, peer, 'unknown') AS ip_address
      FROM logins_v)""", "logins_v"))
def login_ingest_stream(spark, sf_dir):
    root = _run_folder(spark)
    logins = login_events(_events_view(spark, sf_dir, "logins_v"))
    append_stream(logins, f"{root}/logins", f"{root}/progress", "login_id").awaitTermination()
    return spark.read.parquet(f"{root}/logins").select("login_id", "ip_address", "private")


@query(ORACLES["apply_updates"])
def change_stream(spark, sf_dir):
    root = _run_folder(spark)
    start = view(spark, sf_dir, "results_v").withColumn("updated_at", F.lit(None).cast("timestamp"))
    replace_table(start, f"{root}/results")
    apply_change_stream(_events_view(spark, sf_dir, "changes_v"), f"{root}/results", f"{root}/progress").awaitTermination()
    return read_changed(spark, f"{root}/results").select(
        "simulation_id", "trial_id", "patients_enrolled", "patients_completed", "dropout_rate", "estimated_cost",
        F.col("updated_at").cast("string").alias("updated_at"),
    )


@query(ORACLES["update_resolution"])
def session_stream(spark, sf_dir):
    root = _run_folder(spark)
    messages = _events_view(spark, sf_dir, "chat_v", files_per_trigger=8)
    route_stream(messages, view(spark, sf_dir, "results_v"), f"{root}/sessions", f"{root}/progress").awaitTermination()
    return routed(spark, f"{root}/sessions").where(F.col("resolves").isNotNull()).select(
        "chat_id", "user_id", "action_type", "resolves", "simulation_id", "field", "new_value"
    )
