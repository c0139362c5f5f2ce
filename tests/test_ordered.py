"""Scans over large keys give what windows give, and chat rules hold on hand-made logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import chat
from cohortlake.operators.ordered import (
    OrderedRows, find_hot_keys, first_per_group, first_value, last_value, number_all_rows, position,
)
from cohortlake.sources.adapters import view


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    """Events of which one user holds a third; some have no user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.when(F.col("event_id") % 3 == 0, F.lit(7)).when(F.col("event_id") % 50 == 1, F.lit(None)).otherwise(F.col("user_id"))
    return events.select("event_id", "ts", user.alias("user_id"), "event_type", "value")


@pytest.mark.parametrize("hot_rows", [60, 12])
def test_cut_keys_equal_whole_keys(spark, skewed, hot_rows):
    value = F.when(F.col("event_type") == "click", F.col("event_id"))

    def scan(limit):
        rows = OrderedRows.of(skewed, ["user_id"], ["ts", "event_id"], hot_rows=limit)
        rows = rows.scan(seen=last_value(value), before=last_value(value, with_current=False),
                         start=first_value(value), n=position())
        rows = rows.last_values("tail", F.col("event_id"), 5)
        return rows, sorted((tuple(r) for r in rows.rows().collect()), key=lambda r: r[0])

    whole, want = scan(10**9)
    cut, got = scan(hot_rows)
    assert whole.ranged is None and cut.ranged is not None
    assert got == want


def test_hot_keys_are_the_large_ones(skewed):
    hot = find_hot_keys(skewed, ["user_id"], 100)
    assert [r.user_id for r in hot.keys.collect()] == [7]
    assert find_hot_keys(skewed, ["user_id"], 10**6).keys is None


def test_numbers_over_the_whole_table(skewed):
    got = number_all_rows(skewed, [F.desc("value"), F.asc("event_id")], "n").select("n", "value", "event_id").collect()
    want = sorted(((r.value, r.event_id) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.value, r.event_id) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(1, len(got) + 1))


def test_first_rows_are_limited_before_the_shuffle(skewed):
    df = first_per_group(skewed, ["user_id"], [F.desc("ts"), F.asc("event_id")], 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_routing_does_not_depend_on_the_cut(spark, sf_dir):
    messages, results = view(spark, sf_dir, "chat_v"), view(spark, sf_dir, "results_v")
    crowded = messages.withColumn("user_id", F.when(F.col("chat_id") % 3 == 0, "8").otherwise(F.col("user_id")))
    whole = chat.route(crowded, results)
    cut = chat.route(crowded, results, find_hot_keys(crowded, ["user_id"], 25))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


# ---------------------------------------------------------------- chat rules

REQUEST = "update simulation {1} dropout rate to 0.5"
# name: (messages of one user, what happens to each); {1} {2} {9} {only} are ids:
# 1 and 2 belong to the user, 9 to somebody else
LOGS = {
    "a confirm runs the open request once": (
        [REQUEST, "yes", "yes"], ["update_request", "update_executed", "chat"]),
    "words without an open request are chat": (["yes", "no", REQUEST], ["chat", "chat", "update_request"]),
    "a cancel closes": ([REQUEST, "नहीं", "yes"], ["update_request", "cancelled", "chat"]),
    "a newer request replaces an older one": (
        [REQUEST, "update simulation {2} dropout rate to 0.7", "ok"],
        ["update_request", "update_request", "update_executed"]),
    "a refused request leaves the older one open": (
        [REQUEST, "update simulation {9} dropout rate to 0.7", "confirm"],
        ["update_request", "error", "update_executed"]),
    "a failing update stays open until cancelled": (
        ["update simulation {1} dropout rate to 1.2.3", "yes", "yes", "no", "yes"],
        ["update_request", "error", "error", "cancelled", "chat"]),
    "an unknown field, then a good request": (
        ["update simulation {1} colour: 3", "yes", REQUEST, "yes"],
        ["update_request", "error", "update_request", "update_executed"]),
    "the short form uses the carried simulation": (
        ["How is {2}?", "set it to 250", "yes"], ["chat", "update_request", "update_executed"]),
    "without a target the user is asked": (["set it to 5"], ["clarification"]),
    "an id that does not exist gives way to the carried one": (
        ["{1} please", "update simulation dropout rate to 0.2"], ["chat", "update_request"]),
    "a mention is a whole token and the oldest wins": (["{1}2 and x{1}", "{2} or {1}"], ["chat", "chat"]),
    "an update comes before a translation": (
        ["{1}", "translate and set it to 5", "translate this to bengali", "translate"],
        ["chat", "update_request", "translation", "clarification"]),
    "the first message sets the language": (["नमस्ते", "hello", "হ্যালো"], ["chat", "chat", "chat"]),
}


@pytest.fixture(scope="module")
def routed(spark):
    """All logs in one job, one user each, and a user who owns a single simulation."""
    start = dt.datetime(2025, 1, 1)
    results, messages, number = [("lone_1", "lone", 1, 0.1, start)], [("lone", "set it to 5")], {}
    for i, (name, (log, _)) in enumerate(LOGS.items()):
        ids = {k: f"u{i}_{k}" for k in ("1", "2", "9")}
        results += [(ids[k], f"u{i}" if k != "9" else "other", 100, 0.1, start + dt.timedelta(days=int(k))) for k in ids]
        for text in log:
            for k, value in ids.items():
                text = text.replace("{" + k + "}", value)
            messages.append((f"u{i}", text))
        number[name] = i
    df = spark.createDataFrame(
        [(i, u, start + dt.timedelta(minutes=i), m) for i, (u, m) in enumerate(messages)],
        "chat_id long, user_id string, timestamp timestamp, message string",
    )
    table = spark.createDataFrame(
        results, "simulation_id string, user_id string, patients_enrolled int, dropout_rate double, created_at timestamp")
    out = {}
    for row in chat.route(df, table).orderBy("chat_id").collect():
        out.setdefault(row.user_id, []).append(row)
    return lambda name: out["lone" if name == "lone" else f"u{number[name]}"]


@pytest.mark.parametrize("name", LOGS)
def test_log(routed, name):
    assert [r.action_type for r in routed(name)] == LOGS[name][1]


def test_what_a_confirm_resolves(routed):
    got = routed("a confirm runs the open request once")
    assert got[1].resolves == got[0].chat_id
    assert (got[1].simulation_id[-2:], got[1].field, got[1].new_value) == ("_1", "dropout_rate", "0.5")
    got = routed("a newer request replaces an older one")
    assert got[2].resolves == got[1].chat_id and got[2].simulation_id.endswith("_2")
    got = routed("a refused request leaves the older one open")
    assert got[2].resolves == got[0].chat_id
    got = routed("an unknown field, then a good request")
    assert got[3].resolves == got[2].chat_id


def test_targets(routed):
    got = routed("the short form uses the carried simulation")
    assert (got[1].simulation_id[-2:], got[1].field, got[2].new_value) == ("_2", "patients_enrolled", "250")
    assert routed("an id that does not exist gives way to the carried one")[1].simulation_id.endswith("_1")
    got = routed("a mention is a whole token and the oldest wins")
    assert got[0].simulation_id is None and got[1].simulation_id.endswith("_1")
    assert (routed("lone")[0].action_type, routed("lone")[0].simulation_id) == ("update_request", "lone_1")


def test_languages(routed):
    assert routed("an update comes before a translation")[2].reply_language == "bn"
    assert {r.language for r in routed("the first message sets the language")} == {"hi"}


def test_context_holds_the_five_exchanges_before(spark):
    df = spark.createDataFrame(
        [(i, "u", dt.datetime(2025, 1, 1, 0, i), f"m{i}") for i in range(8)],
        "chat_id long, user_id string, timestamp timestamp, message string",
    )
    got = {r.chat_id: r.context for r in chat.context_window(df, F.col("message")).collect()}
    assert got[0] == [] and got[2] == ["m0", "m1"] and got[7] == ["m2", "m3", "m4", "m5", "m6"]
