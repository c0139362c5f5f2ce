"""Chat sessions from a stream, with the rows of :func:`cohortlake.operators.chat.route`.

Each micro-batch puts one state row per user in front of the user's new
messages and runs the batch form's scans over both, so a user with any share
of the log is cut into ranges like there, and no user has to fit a task. Rows
may come in any order: a message that is older than what its user's state
already holds sets the user back to the last state before it, and the later
messages are walked again. Below ``root`` stand

* ``log``: what each message says, without its text, by micro-batch;
* ``steps``: the outcome of each message walked in a micro-batch; a message
  that was walked again has several, of which the last counts;
* ``states``: what each user's session held after a micro-batch.

A micro-batch that Spark repeats after a failure overwrites its own folders
and reads only earlier ones.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlake.operators.changes import changeable, last_per_key
from cohortlake.operators.chat import ORDER, OUTCOME, REQUEST, message_features, outcome_columns, request_steps, session_scan
from cohortlake.operators.ordered import HOT_ROWS, OrderedRows, find_hot_keys

FEATURES = ("chat_id long, user_id string, timestamp timestamp, detected_language string, forced_language string, "
            "word string, named_id string, field string, new_value string, asks_translation boolean, "
            "translation_target string, mention string, named_owner string, only_id string")
PLACE = "struct<timestamp:timestamp,chat_id:bigint>"
#: ``first`` and ``last``: places of the user's earliest new message in the micro-batch and of the latest one walked.
STATES = (f"user_id string, first {PLACE}, last {PLACE}, detected_language string, forced_language string, "
          f"mention string, event {REQUEST}, closing {REQUEST}")


def place():
    return F.struct(*ORDER).cast(PLACE)


def earlier_batches(spark: SparkSession, path: str, columns: str, batch_id: int) -> DataFrame:
    """Rows of the micro-batches before this one, with their number as ``batch``."""
    try:
        stored = spark.read.schema(f"{columns}, batch long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{columns}, batch long")
    return stored.where(F.col("batch") < batch_id)


def with_user(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows with the columns of another table that has one row per user, null being a user too."""
    renamed = other.withColumnRenamed("user_id", "_user")
    return rows.join(renamed, F.col("user_id").eqNullSafe(F.col("_user"))).drop("_user")


def states_before(states: DataFrame, starts: DataFrame) -> DataFrame:
    """Per user of ``starts`` the last state that holds all messages up to it and none after the user's start.

    A state no longer holds all of them once a later micro-batch brought a
    message from before it. ``again`` tells whether messages were walked that
    come after the start, or are sent once more. There is one state per user
    and micro-batch; messages without a user are one user's.
    """
    since = Window.partitionBy("user_id").orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1)
    own = with_user(states, starts).withColumn("_since", F.min("first").over(since))
    whole = (F.col("last") < F.col("start")) & (F.col("_since").isNull() | (F.col("_since") > F.col("last")))
    kept = [c for c in states.columns if c not in ("user_id", "batch")]
    return own.groupBy("user_id").agg(
        F.max_by(F.struct(*kept), F.when(whole, F.col("last"))).alias("state"),
        (F.max("last") >= F.first("start")).alias("again"),
    )


def state_rows(chosen: DataFrame) -> DataFrame:
    """States as rows that stand before the messages they precede."""
    s = lambda name: F.col(f"state.{name}")
    given = {
        "chat_id": s("last.chat_id"), "user_id": F.col("user_id"), "timestamp": s("last.timestamp"),
        "detected_language": s("detected_language"), "forced_language": s("forced_language"), "mention": s("mention"),
    }
    names = [c.split()[:2] for c in FEATURES.split(", ")]
    return chosen.where("state IS NOT NULL").select(
        *[given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names],
        s("event").alias("_carried_event"), s("closing").alias("_carried_closing"), F.lit(True).alias("_state"),
    )


def message_rows(features: DataFrame) -> DataFrame:
    none = F.lit(None).cast(REQUEST)
    return features.select(*[c.split()[0] for c in FEATURES.split(", ")], none.alias("_carried_event"),
                           none.alias("_carried_closing"), F.lit(False).alias("_state"))


def new_states(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """What each user's session holds after its last message; tasks combine rows before the shuffle."""
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), place()))
    ends = steps.groupBy("user_id").agg(
        F.max(place()).alias("last"),
        F.min_by(F.struct("detected_language"), place()).getField("detected_language").alias("detected_language"),
        last("forced_language").alias("forced_language"), last("mention").alias("mention"),
        last("_event").alias("event"), last("_closing").alias("closing"),
    )
    return with_user(ends, starts.withColumnRenamed("start", "first")).select(
        *[c.split()[0] for c in STATES.replace(PLACE, "p").replace(REQUEST, "r").split(", ")])


def walk_batch(batch: DataFrame, batch_id: int, results: DataFrame, root: str, pending_seconds: float | None,
               hot_rows: int) -> None:
    """One micro-batch: log, steps and states, each written whole or again."""
    spark = batch.sparkSession
    here = lambda kind: f"{root}/{kind}/batch={batch_id}"
    features = message_features(batch, results)
    timed = features.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("chat_id", F.col("chat_id").cast("long"))
    timed.select(*[c.split()[0] for c in FEATURES.split(", ")]).write.mode("overwrite").parquet(here("log"))
    new = spark.read.schema(FEATURES).parquet(here("log"))
    starts = new.groupBy("user_id").agg(F.min(place()).alias("start"))
    chosen = states_before(earlier_batches(spark, f"{root}/states", STATES, batch_id), starts).persist()
    try:
        rows = message_rows(new).unionByName(state_rows(chosen))
        late_users, without, back = chosen.where("again").agg(
            F.count(F.lit(1)), F.count_if(F.col("state.last.timestamp").isNull()), F.min(F.unix_micros("state.last.timestamp"))).first()
        if late_users:
            log = earlier_batches(spark, f"{root}/log", FEATURES, batch_id)
            if not without:  # one value bounds what is read of the log
                log = log.where(F.col("timestamp") >= F.timestamp_micros(F.lit(back)))
            late = chosen.where("again").select("user_id", F.col("state.last").alias("_last"))
            after = F.col("_last").isNull() | (place() > F.col("_last"))
            rows = rows.unionByName(message_rows(with_user(log, late).where(after))).dropDuplicates(["user_id", *ORDER])
        ordered = OrderedRows.of(rows, ["user_id"], ORDER, find_hot_keys(rows, ["user_id"], hot_rows))
        walked = request_steps(session_scan(ordered), changeable(results.schema, "simulation_id"), pending_seconds, True).rows()
        walked.select(*outcome_columns(), "detected_language", "forced_language", "mention", "_event", "_closing",
                      "_state").write.mode("overwrite").parquet(here("steps"))
    finally:
        chosen.unpersist()
    new_states(spark.read.parquet(here("steps")), starts).write.mode("overwrite").parquet(here("states"))


def route_stream(messages: DataFrame, results: DataFrame, root: str, checkpoint: str, pending_seconds: float | None = None,
                 hot_rows: int = HOT_ROWS) -> StreamingQuery:
    """Walk all available messages in micro-batches, then stop; :func:`routed` reads the outcome.

    ``results`` is a table. The source's trigger limit bounds a micro-batch;
    users of any size are cut as in the batch form.
    """
    return (
        messages.writeStream.foreachBatch(
            lambda batch, batch_id: walk_batch(batch, batch_id, results, root, pending_seconds, hot_rows))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def routed(spark: SparkSession, root: str) -> DataFrame:
    """The outcome of every message so far, as :func:`cohortlake.operators.chat.route` gives it."""
    steps = spark.read.parquet(f"{root}/steps").where("NOT _state").select(*OUTCOME, "batch")
    return last_per_key(steps, ["user_id", *ORDER], ["batch"]).select(*OUTCOME)
