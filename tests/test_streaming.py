"""Streaming jobs against their batch forms."""

import time

import pytest
from pyspark.sql import Window, functions as F

from cohortlake.operators import chat
from cohortlake.operators.changes import apply_changes
from cohortlake.sources.adapters import view
from cohortlake.sources.versions import current_version, read_current, replace_table
from cohortlake.streaming import changes as sc, ingest, sessions


def in_time_order(df, path, parts=3):
    """Write a log as files that arrive one after the other."""
    seconds = F.col("timestamp").cast("double")
    cuts = df.select(F.percentile_approx(seconds, [i / parts for i in range(1, parts)])).first()[0]
    edges = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(edges, edges[1:]):
        df.where((seconds > low) & (seconds <= high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chat") / "in")
    messages = view(spark, sf_dir, "chat_v")
    in_time_order(messages, path)
    return messages, path


COLUMNS = ["chat_id", "user_id", "language", "reply_language", "action_type", "simulation_id", "field", "new_value", "resolves"]


def same_rows(got, want):
    assert sorted(map(str, got.select(*COLUMNS).collect())) == sorted(map(str, want.select(*COLUMNS).collect()))


def test_session_stream_equals_batch(spark, sf_dir, log, tmp_path):
    messages, path = log
    results = view(spark, sf_dir, "results_v")
    stream = ingest.file_stream(spark, path, messages.schema, 1)
    query = sessions.route_stream(stream, results, f"{tmp_path}/out", f"{tmp_path}/progress")
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress}) == 3
    same_rows(sessions.routed(spark, f"{tmp_path}/out"), chat.route(messages, results))


def newest_first(df, path, parts=4):
    """Write a log as files of which the newest rows come first."""
    at = F.ntile(parts).over(Window.orderBy(F.desc("timestamp")))
    for part in range(1, parts + 1):
        df.withColumn("_part", at).where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


CHAT = "chat_id long, user_id string, timestamp string, message string"


def hand_log(spark):
    """One user with most messages: requests, confirms, cancels, named ids and languages, over two minutes."""
    says = ["hello", "update simulation sim_1 dropout rate to 0.5", "yes", "change patients enrolled to 70", "no",
            "update dropout rate to many", "yes", "what about sim_2", "update dropout rate to 0.25", "thanks", "confirm", "হ্যালো"]
    rows = [(i, "u" if i % 5 else f"v{i % 10}", f"2025-01-01 00:{i // 30:02d}:{i % 30 * 2:02d}", says[i * 7 % 12]) for i in range(120)]
    df = spark.createDataFrame(rows, CHAT).withColumn("timestamp", F.to_timestamp("timestamp"))
    results = spark.createDataFrame([(f"sim_{i}", "u" if i < 3 else f"v{i}", 0.1, 5, None) for i in range(9)],
                                    "simulation_id string, user_id string, dropout_rate double, patients_enrolled int, created_at timestamp")
    return df, results


@pytest.mark.parametrize("hot_rows,seconds", [(10, None), (1000, 5)])
def test_sessions_from_files_in_any_order(spark, tmp_path, hot_rows, seconds):
    """Newest files first, then shuffled ones; a user with most of the log is cut into ranges."""
    messages, results = hand_log(spark)
    want = chat.route(messages, results, pending_seconds=seconds)
    assert want.where("action_type = 'update_executed'").count() > 2
    newest_first(messages, f"{tmp_path}/in", 3)
    for part in range(2):
        messages.where(F.pmod(F.xxhash64("chat_id"), F.lit(2)) == part).coalesce(1).write.parquet(f"{tmp_path}/mixed{part}")
    stream = ingest.file_stream(spark, f"{tmp_path}/in", messages.schema, 1)
    sessions.route_stream(stream, results, f"{tmp_path}/a", f"{tmp_path}/pa", seconds, hot_rows).awaitTermination()
    same_rows(sessions.routed(spark, f"{tmp_path}/a"), want)
    for part in range(2):
        batch = spark.read.parquet(f"{tmp_path}/mixed{part}")
        for _ in range(2):  # a micro-batch that is repeated changes nothing
            sessions.walk_batch(batch, part, results, f"{tmp_path}/b", seconds, hot_rows)
    same_rows(sessions.routed(spark, f"{tmp_path}/b"), want)


def test_late_messages_walk_only_what_follows(spark, tmp_path):
    messages, results = hand_log(spark)
    parts = [messages.where("chat_id < 60"), messages.where("chat_id between 60 and 99"), messages.where("chat_id between 101 and 119"),
             messages.where("chat_id = 100")]
    for i, part in enumerate(parts):
        sessions.walk_batch(part, i, results, f"{tmp_path}/s", None, 1000)
    same_rows(sessions.routed(spark, f"{tmp_path}/s"), chat.route(messages, results))
    again = spark.read.parquet(f"{tmp_path}/s/steps/batch=3").where("NOT _state")
    assert again.agg(F.min("chat_id")).first()[0] >= 100  # the state before the late message is kept
    assert {r.user_id for r in again.collect()} == {r.user_id for r in parts[3].collect()}


def test_messages_sent_again_and_messages_without_a_user(spark, tmp_path):
    messages, results = hand_log(spark)
    messages = messages.withColumn("user_id", F.when(F.col("user_id") != "u", F.col("user_id")))
    sent = [messages.where("chat_id < 70"), messages.where("chat_id >= 50 AND chat_id < 90"), messages.where("chat_id >= 89")]
    for i, part in enumerate(sent):
        sessions.walk_batch(part, i, results, f"{tmp_path}/s", None, 1000)
    same_rows(sessions.routed(spark, f"{tmp_path}/s"), chat.route(messages, results))


def test_sessions_run_without_python(spark, tmp_path):
    messages, results = hand_log(spark)
    sessions.walk_batch(messages, 0, results, f"{tmp_path}/s", None, 1000)
    for df in (chat.route(messages.where("chat_id > 0"), results), sessions.routed(spark, f"{tmp_path}/s")):
        text = df._jdf.queryExecution().executedPlan().toString()
        for word in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
            assert word not in text


def test_open_requests_can_time_out(spark, tmp_path):
    rows = [(0, "u", "2025-01-01 00:00:00", "update simulation sim_1 dropout rate to 0.5"),
            (1, "u", "2025-01-01 00:00:30", "hello"), (2, "u", "2025-01-01 00:02:00", "yes")]
    df = spark.createDataFrame(rows, CHAT).withColumn("timestamp", F.to_timestamp("timestamp"))
    results = spark.createDataFrame([("sim_1", "u", 0.1, None)], "simulation_id string, user_id string, dropout_rate double, created_at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = ingest.file_stream(spark, f"{tmp_path}/in", df.schema)
    for seconds, action in ((None, "update_executed"), (60, "chat")):
        root = f"{tmp_path}/{action}"
        sessions.route_stream(stream, results, root, f"{root}-progress", seconds).awaitTermination()
        for found in (sessions.routed(spark, root), chat.route(df, results, pending_seconds=seconds)):
            assert {r.chat_id: r.action_type for r in found.collect()} == {0: "update_request", 1: "chat", 2: action}


def test_ingest_keeps_late_rows_and_drops_repeats(spark, sf_dir, tmp_path):
    messages = view(spark, sf_dir, "chat_v")
    path, root = f"{tmp_path}/in", f"{tmp_path}/out"
    newest_first(messages, path)
    messages.limit(50).coalesce(1).write.mode("append").parquet(path)  # repeats, late
    for attempt in ("a", "b"):  # the second stream sends everything again
        stream = ingest.file_stream(spark, path, messages.schema, 1)
        query = ingest.append_stream(ingest.chat_events(stream), root, f"{tmp_path}/{attempt}", "chat_id")
        query.awaitTermination()
        assert len({p["batchId"] for p in query.recentProgress}) >= 5
    got = spark.read.parquet(root)
    assert got.count() == messages.count() == got.select("chat_id").distinct().count()
    assert {"detected_language", "word", "field", "day"} <= set(got.columns)


def test_repeats_are_looked_for_in_their_own_parts(spark, tmp_path):
    """A small micro-batch opens a few files of a table of many days."""
    rows = spark.range(4000).select(F.col("id").alias("chat_id"), F.expr("DATE'2025-01-01' + CAST(id % 20 AS INT)").alias("day"), F.lit("x").alias("t"))
    stored = rows.withColumn("bucket", ingest.bucket("chat_id", 16))
    stored.repartition("day", "bucket").write.partitionBy("day", "bucket").parquet(f"{tmp_path}/t")
    batch = stored.where("chat_id IN (3, 1777)").unionByName(stored.where("chat_id = 5").withColumn("chat_id", F.lit(10_000).cast("long"))).select("chat_id", "t", "day", "bucket")
    held = ingest.stored_ids(batch, f"{tmp_path}/t", "chat_id")
    held.collect()
    leaves = held._jdf.queryExecution().executedPlan().collectLeaves()
    assert sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())) <= 3
    assert [r.chat_id for r in ingest.not_stored(batch, f"{tmp_path}/t", "chat_id").collect()] == [10_000]
    assert ingest.stored_ids(batch, f"{tmp_path}/none", "chat_id") is None


def test_login_ingest_keeps_rows_without_id(spark, tmp_path):
    rows = [(None, "2025-01-02 00:00:00"), (None, "2025-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, None)]
    logins = spark.createDataFrame(rows, "login_id long, timestamp string").selectExpr(
        "login_id", "CAST(timestamp AS TIMESTAMP) AS timestamp", "'1.2.3.4' AS peer", "CAST(NULL AS STRING) AS x_real_ip",
        "CAST(NULL AS STRING) AS x_forwarded_for")
    logins.write.parquet(f"{tmp_path}/in")
    for attempt in ("a", "b"):
        stream = ingest.file_stream(spark, f"{tmp_path}/in", logins.schema)
        ingest.append_stream(ingest.login_events(stream), f"{tmp_path}/out", f"{tmp_path}/{attempt}", "login_id").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("login_id").count().collect()
    assert {r.login_id: r["count"] for r in got} == {None: 4, 1: 1, 2: 1}


@pytest.mark.parametrize("fold_rows", [1, 100_000])
def test_change_stream_takes_late_changes_by_their_time(spark, sf_dir, tmp_path, fold_rows):
    changes = view(spark, sf_dir, "changes_v").withColumnRenamed("changed_at", "timestamp")
    newest_first(changes, f"{tmp_path}/in", 3)
    start = view(spark, sf_dir, "results_v").withColumn("updated_at", F.lit(None).cast("timestamp"))
    path = f"{tmp_path}/results"
    replace_table(start, path)
    want = sorted(map(str, apply_changes(start, changes.withColumnRenamed("timestamp", "changed_at")).collect()))
    for attempt in ("a", "b"):  # another stream repeats all changes and changes nothing
        stream = ingest.file_stream(spark, f"{tmp_path}/in", changes.schema, 1).withColumnRenamed("timestamp", "changed_at")
        sc.apply_change_stream(stream, path, f"{tmp_path}/{attempt}", fold_rows=fold_rows).awaitTermination()
        assert sorted(map(str, sc.read_changed(spark, path).collect())) == want
    assert current_version(spark, path) == 1
    folds = current_version(spark, f"{path}-changes/folded")
    assert folds >= 2 if fold_rows == 1 else folds == 0
    sc.fold_changes(spark, path)
    assert sorted(map(str, sc.read_changed(spark, path).collect())) == want


CHANGES = "change_id long, simulation_id string, field string, value string, at string"


def change_rows(spark, rows):
    return spark.createDataFrame(rows, CHANGES).selectExpr(
        "change_id", "simulation_id", "field", "value", "CAST(at AS TIMESTAMP) AS changed_at")


def test_a_second_stream_applies_its_changes(spark, tmp_path):
    start = spark.createDataFrame([("s1", 1), ("s2", 1)], "simulation_id string, patients_enrolled int")
    replace_table(start, f"{tmp_path}/results")
    for i, value in enumerate(("20", "30")):
        batch = change_rows(spark, [(i, "s1", "patients_enrolled", value, f"2025-01-0{i + 1} 00:00:00")])
        batch.write.parquet(f"{tmp_path}/in{i}")
        for _ in range(2):  # the same stream started again has nothing left to do
            stream = ingest.file_stream(spark, f"{tmp_path}/in{i}", batch.schema)
            sc.apply_change_stream(stream, f"{tmp_path}/results", f"{tmp_path}/progress{i}").awaitTermination()
    assert {tuple(r) for r in sc.read_changed(spark, f"{tmp_path}/results").collect()} == {("s1", 30), ("s2", 1)}


def bytes_below(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_micro_batch_writes_in_proportion_to_its_changes(spark, tmp_path):
    """Bytes written follow the changes, not the table; bad changes and older ones of a field are not kept."""
    start = spark.range(200_000).selectExpr("concat('s', id) AS simulation_id", "CAST(id AS INT) AS patients_enrolled", "rand(1) AS dropout_rate")
    path = f"{tmp_path}/results"
    replace_table(start, path)
    table = bytes_below(tmp_path / "results")
    rows = [(i, f"s{i % 10}", "patients_enrolled", str(i), f"2025-01-01 00:00:{i % 60:02d}") for i in range(60)]
    sc.write_changes(change_rows(spark, [*rows, (99, "s1", "patients_enrolled", "many", "2026-01-01 00:00:00")]), path, "a", 0, "simulation_id", 1000)
    written = bytes_below(tmp_path / "results-changes")
    assert bytes_below(tmp_path / "results") == table and written < table / 50
    assert sc.all_changes(spark, path, "simulation_id").count() == 10
    sc.write_changes(change_rows(spark, rows), path, "a", 0, "simulation_id", 1000)  # repeated
    assert bytes_below(tmp_path / "results-changes") == written
    got = {r.simulation_id: r.patients_enrolled for r in sc.read_changed(spark, path).where("length(simulation_id) = 2").collect()}
    assert got == {f"s{i}": 50 + i for i in range(10)}


def test_a_writer_behind_a_fold_is_read(spark, tmp_path):
    """A micro-batch that began before a fold and ended after it still counts, also after the next fold."""
    path = f"{tmp_path}/results"
    replace_table(spark.createDataFrame([("s1", 1), ("s2", 1)], "simulation_id string, patients_enrolled int"), path)
    write = lambda i, value, n: sc.write_changes(
        change_rows(spark, [(i, "s1" if i < 5 else "s2", "patients_enrolled", value, f"2025-01-0{i + 1} 00:00:00")]), path, "a", n, "simulation_id", 1000)
    write(0, "10", 0)
    sc.fold_changes(spark, path)
    late = change_rows(spark, [(7, "s2", "patients_enrolled", "70", "2025-02-01 00:00:00")]).select("simulation_id", "field", "value", "changed_at", "change_id")
    late.write.parquet(f"{path}-changes/log/gen=0/source=b/batch=0")
    for _ in range(2):
        assert {tuple(r) for r in sc.read_changed(spark, path).collect()} == {("s1", 10), ("s2", 70)}
        sc.fold_changes(spark, path)
    write(1, "11", 1)
    sc.fold_changes(spark, path)
    assert {tuple(r) for r in sc.read_changed(spark, path).collect()} == {("s1", 11), ("s2", 70)}


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = f"{tmp_path}/t"
    replace_table(spark.range(1), path)
    version = current_version(spark, path)
    replace_table(spark.range(2), path, after=version)
    with pytest.raises(RuntimeError):
        replace_table(spark.range(3), path, after=version)
    assert read_current(spark, path).count() == 2
