"""Filters, quality, portfolio, results, changes, users and logins on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import changes as chg, filters as flt, logins as lg, portfolio as pf, quality as q
from cohortlake.operators import results as rs, users as us


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ------------------------------------------------------------------ filters

@pytest.fixture(scope="module")
def trials(spark):
    return spark.createDataFrame(
        [("a", "Phase I", "X", True, 100, 0.1, 10.0, dt.date(2024, 1, 2)),
         ("b", "Phase I", "Y", False, 200, 0.3, 20.0, dt.date(2024, 1, 2)),
         ("c", "Phase II", "X", None, 300, None, None, dt.date(2024, 1, 3)),
         ("d", None, "X", True, None, 0.2, 30.0, dt.date(2024, 1, 1))],
        "trial_id string, phase string, therapeutic_area string, success boolean, enrollment int, "
        "dropout_rate double, cost_usd double, start_date date",
    )


def test_filter_lists_scalars_and_unknown_keys(trials):
    got, ignored = flt.filter_by(trials, {"phase": ["Phase I", "Phase II"], "therapeutic_area": "X", "sponsor": 1})
    assert rows(got.select("trial_id"), "trial_id") == [("a",), ("c",)]
    assert ignored == ["sponsor"]
    assert flt.filter_by(trials, None)[0].count() == 4


def test_clean_floats(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (float("-inf"), 3), (1.5, 4), (None, 5)], "x double, k int")
    assert [r[0] for r in rows(flt.clean_floats(df), "k")] == [None, None, None, 1.5, None]


def test_lookup_keeps_missing_keys(spark, trials):
    asked = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "n int, trial_id string")
    got = flt.lookup(asked, trials.select("trial_id", "phase"), "trial_id")
    assert rows(got.select("n", "phase", "found"), "n") == [(1, "Phase I", True), (2, None, False), (3, None, False)]


def test_lookup_ignoring_case(spark):
    users = spark.createDataFrame([("Ann", 1)], "username string, index int")
    asked = spark.createDataFrame([("ANN",), ("bob",)], "username string")
    got = flt.lookup(asked, users, "username", ignore_case=True)
    assert rows(got.select("username", "stored_username", "index"), "username") == [("ANN", "Ann", 1), ("bob", None, None)]


def test_login_matches_either_form_and_the_lowest_index_wins(spark):
    users = spark.createDataFrame([(2, "ann", "x@y.z"), (1, "bob", "ANN"), (3, "c", "c")], "index int, username string, email string")
    logins = spark.createDataFrame([("Ann",), ("X@Y.Z",), ("c",), ("nobody",)], "login string")
    got = flt.by_username_or_email(logins, users)
    assert rows(got.select("login", "index"), "login") == [("Ann", 1), ("X@Y.Z", 2), ("c", 3), ("nobody", None)]


def test_owner_column_missing(spark):
    df = spark.createDataFrame([("s",)], "simulation_id string")
    assert flt.owned_by(df, "1", on_missing_owner="all").count() == 1
    with pytest.raises(ValueError):
        flt.owned_by(df, "1")


def test_numeric_looking_owner_is_compared_as_text(spark):
    df = spark.createDataFrame([("s", "2"), ("t", "u2")], "simulation_id string, user_id string")
    assert rows(flt.owned_by(df, 2), "simulation_id") == [("s", "2")]


# ---------------------------------------------------------------- portfolio

def test_stats_skip_nulls(trials):
    s = pf.portfolio_stats(trials).first()
    assert s.total_trials == 4
    assert s.success_rate == pytest.approx(2 / 3)
    assert s.avg_enrollment == pytest.approx(200)
    assert s.avg_dropout_rate == pytest.approx(0.2)
    assert s.avg_cost == pytest.approx(20)
    assert s.avg_duration_days == 365.0  # no such column


def test_stats_of_an_empty_table(trials):
    s = pf.portfolio_stats(trials.where(F.lit(False))).first()
    assert s.total_trials == 0 and s.success_rate is None


def test_distribution_order_and_nulls(trials):
    got = [tuple(r) for r in pf.distribution(trials, "phase").collect()]
    assert got == [("Phase I", 2), ("Phase II", 1)]
    entries = pf.distribution_map(trials, "phase").select(F.map_entries("phase_distribution")).first()[0]
    assert [tuple(e) for e in entries] == [("Phase I", 2), ("Phase II", 1)]


def test_similar_and_history_limits(trials):
    assert [r.trial_id for r in pf.similar_trials(trials, "X", "Phase II").collect()] == ["c"]
    assert [r.trial_id for r in pf.trial_history(trials).collect()] == ["c", "a", "b", "d"]
    for bad in (0, 21):
        with pytest.raises(ValueError):
            pf.similar_trials(trials, "X", "Phase I", bad)
    with pytest.raises(ValueError):
        pf.trial_history(trials, limit=201)


def test_results_without_a_trial_are_kept(spark, trials):
    results = spark.createDataFrame([("s1", "a"), ("s2", None), ("s3", "gone")], "simulation_id string, trial_id string")
    got = pf.results_with_trial(results, trials.select("trial_id", "phase"))
    assert rows(got.select("simulation_id", "trial_id", "phase"), "simulation_id") == [
        ("s1", "a", "Phase I"), ("s2", None, None), ("s3", "gone", None)]


# ------------------------------------------------------------------ results

def test_null_as_zero_is_not_the_null_skipping_mean(spark):
    df = spark.createDataFrame([(0.5, 10, 5), (None, None, None), (1.0, 20, 0)],
                               "success_probability double, patients_enrolled int, patients_completed int")
    s = rs.dashboard_stats(df).first()
    assert (s.total, s.completed) == (3, 1)
    assert s.avg_success == pytest.approx(0.5) and s.avg_patients == pytest.approx(10)


def test_sorting_takes_null_as_zero_with_a_tie_break(spark):
    df = spark.createDataFrame([("b", None), ("a", 0.0), ("c", -1.0), ("d", 2.0)], "simulation_id string, success_probability double")
    assert [r.simulation_id for r in df.orderBy(*rs.sort_columns("success_asc")).collect()] == ["c", "a", "b", "d"]
    assert [r.simulation_id for r in df.orderBy(*rs.sort_columns("success_desc")).collect()] == ["d", "a", "b", "c"]


def test_pages(spark):
    df = spark.range(30).select(F.format_string("s%02d", "id").alias("simulation_id"), F.lit(1.0).alias("success_probability"))
    got = rs.all_pages(df, "success_asc").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 31))
    assert [r.page for r in got] == [1] * 12 + [2] * 12 + [3] * 6
    assert [r.simulation_id for r in rs.page(df, "success_asc", 3).collect()] == [f"s{i:02d}" for i in range(24, 30)]
    assert tuple(rs.page_count(df).first()) == (30, 3)


# ------------------------------------------------------------------ quality

def test_all_messages_of_a_row(spark):
    df = spark.createDataFrame(
        [(17, "Male", 80.0, 180.0), (30, "x", float("nan"), None), (18, "Other", 30.0, 250.0)],
        "age int, gender string, weight_kg double, height_cm double",
    )
    good, bad = q.split_valid(q.validate(df, q.patient_rules()))
    assert [r.age for r in good.collect()] == [18]
    errors = {r.age: r.errors for r in bad.collect()}
    assert errors[17] == ["age must be at least 18 and at most 100"]
    assert errors[30] == ["gender must be one of Male, Female, Other", "weight_kg must be at least 30 and at most 300",
                          "height_cm must be at least 100 and at most 250"]


def test_request_and_outcome_rules(spark):
    df = spark.createDataFrame([("short", "research", 1), ("long enough text", "other", 101)],
                               "query string, agent_type string, num_simulations int")
    got = [r.errors for r in q.validate(df, q.request_rules()).collect()]
    assert [len(e) for e in got] == [1, 2]
    scores = spark.createDataFrame([(1.1, 0.5, -0.1)], "efficacy_score double, safety_score double, overall_score double")
    assert len(q.validate(scores, q.outcome_rules()).first().errors) == 2


def test_nested_design(spark):
    from cohortlake.schemas import DESIGN

    row = dict.fromkeys(DESIGN.names)
    row |= {"trial_name": "Trial", "phase": "Phase II", "drug_name": "D", "indication": "I", "target_enrollment": 200,
            "inclusion_criteria": {"min_age": 18, "max_age": None, "required_biomarkers": ["x"], "excluded_conditions": []},
            "duration_days": 730, "primary_endpoint": "P", "treatment_arms": ["a", "b"]}
    flat = q.flatten_design(spark.createDataFrame([row], DESIGN))
    got = flat.first()
    assert (got.min_age, got.max_age, got.arm_count, got.control_arm) == (18, 75, 2, "Placebo")
    assert (got.expected_dropout_rate, got.expected_success_rate) == (0.15, 0.7)
    assert q.validate(flat, q.design_rules()).first().errors == []


# ------------------------------------------------------------------ changes

@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(
        [("s1", 10, 0.1, "t1", None), ("s2", 20, 0.2, "t2", None), ("s3", 30, 0.3, "t3", None)],
        "simulation_id string, patients_enrolled int, dropout_rate double, trial_id string, updated_at timestamp",
    )


@pytest.fixture(scope="module")
def requests(spark):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    return spark.createDataFrame(
        [(1, "s1", "patients_enrolled", "11", t(1)), (2, "s1", "patients_enrolled", "12", t(3)),
         (3, "s1", "patients_enrolled", "1.5", t(4)), (4, "s1", "dropout_rate", "0.9", t(2)),
         (5, "s2", "sponsor", "x", t(5)), (6, "s2", "dropout_rate", "1.2.3", t(6)), (7, "s9", "trial_id", "t9", t(7)),
         (8, "s3", "trial_id", "text is fine", t(8)), (9, "s3", "simulation_id", "s4", t(9)),
         (10, "s3", None, "1", t(9)), (11, "s3", "dropout_rate", None, t(9))],
        "change_id int, simulation_id string, field string, value string, changed_at timestamp",
    )


def test_last_good_change_wins(stored, requests):
    got = chg.apply_changes(stored, requests)
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    assert rows(got, "simulation_id") == [
        ("s1", 12, 0.9, "t1", t(3)), ("s2", 20, 0.2, "t2", None), ("s3", 30, 0.3, "text is fine", t(8))]


def test_report_of_changes(stored, requests):
    report = chg.change_report(stored, requests)
    assert {r.change_id: r.status for r in report.collect()} == {
        1: "applied", 2: "applied", 3: "bad value", 4: "applied", 5: "unknown field", 6: "bad value", 7: "not found",
        8: "applied", 9: "unknown field", 10: "unknown field", 11: "bad value"}
    assert rows(chg.updated_fields(report), "simulation_id") == [
        ("s1", ["dropout_rate", "patients_enrolled"]), ("s3", ["trial_id"])]


def test_delete(spark, stored):
    keys = spark.createDataFrame([("s2",), ("s2",), ("zz",)], "simulation_id string")
    assert [r.simulation_id for r in chg.delete_keys(stored, keys).orderBy("simulation_id").collect()] == ["s1", "s3"]


# -------------------------------------------------------------------- users

def test_highest_index_ignores_other_text(spark):
    df = spark.createDataFrame([("3",), ("x9",), ("11",), (None,)], "index string")
    assert us.highest_index(df).first()[0] == 11
    assert us.highest_index(df.where(F.lit(False))).first()[0] == 0


def one_by_one(requests, users):
    """Registration taken request by request."""
    names, mails = {u[1].lower() for u in users}, {u[2].lower() for u in users}
    index, out = max((u[0] for u in users), default=0), {}
    for rid, first, name, mail in sorted(requests):
        if not (first and name and mail):
            out[rid] = ("All fields are required", None)
        elif name.lower() in names:
            out[rid] = ("Username already exists", None)
        elif mail.lower() in mails:
            out[rid] = ("Email already exists", None)
        else:
            index += 1
            names.add(name.lower())
            mails.add(mail.lower())
            out[rid] = (None, index)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_registration_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    users = [(i, f"user{i}", f"mail{i}@x.y") for i in range(1, 6)]
    requests = [
        (i, rng.choice(["A", "A", "A", ""]), rng.choice(["User", "user"]) + str(rng.randint(1, 25)),
         rng.choice(["MAIL", "mail"]) + str(rng.randint(1, 25)) + "@x.y") for i in range(80)
    ]
    # a third of all requests are copies of one name
    requests += [(100 + i, "A", "Copy", f"copy{i}@x.y") for i in range(40)]
    batch = spark.createDataFrame(
        [(r, f, "L", n, m, "pw") for r, f, n, m in requests],
        "request_id int, first_name string, last_name string, username string, email string, password string",
    )
    known = spark.createDataFrame(users, "index int, username string, email string")
    done = us.register(batch, known)
    assert {r.request_id: (r.problem, r.new_index) for r in done.collect()} == one_by_one(requests, users)
    added = us.new_users(done)
    assert added.columns == ["index", "first_name", "last_name", "username", "email", "password"]
    assert all(len(r.password) == 64 for r in added.collect())


def registrations(spark, requests):
    return spark.createDataFrame(
        [(r, "A", "L", n, m, "pw") for r, n, m in requests],
        "request_id int, first_name string, last_name string, username string, email string, password string").repartition(4)


@pytest.mark.parametrize("component_rows", [3, 20_000])
def test_registration_of_dense_clashes(spark, component_rows):
    """Few keys: most requests fall into one group, also when it is too large for one task."""
    rng = random.Random(9)
    requests = [(i, f"user{rng.randint(1, 60)}", f"mail{rng.randint(1, 60)}") for i in range(150)]
    known = spark.createDataFrame([(1, "user1", "mail1")], "index int, username string, email string")
    got = {r.request_id: (r.problem, r.new_index) for r in us.register(registrations(spark, requests), known, component_rows=component_rows).collect()}
    assert got == one_by_one([(r, "A", n, m) for r, n, m in requests], [(1, "user1", "mail1")])


def test_registration_of_a_long_chain(spark, monkeypatch):
    """Each request clashes with the one before: the rounds do not follow the length."""
    rounds = []
    plain = us.checkpointed
    monkeypatch.setattr(us, "checkpointed", lambda df: rounds.append(1) or plain(df))
    known = spark.createDataFrame([], "index int, username string, email string")
    length = 3000
    requests = [(i, f"user{(i + 1) // 2}", f"mail{i // 2}") for i in range(length)]
    got = {r.request_id: r.new_index for r in us.register(registrations(spark, requests), known).collect()}
    assert sorted(i for i, new in got.items() if new is not None) == list(range(0, length, 2))
    assert len(rounds) < 40


def test_profile_and_password_changes_ignore_case(spark):
    users = spark.createDataFrame([(1, "Ann", "A", "x", "Ann@X", "old"), (2, "Bob", "B", "y", "b@x", "old")],
                                  "index int, username string, first_name string, last_name string, email string, password string")
    changes = spark.createDataFrame([(1, "ANN", "A1", "L1", "e1"), (2, "ann", "A2", "L2", "e2")],
                                    "seq int, username string, first_name string, last_name string, email string")
    got = us.update_profiles(users, changes, "seq")
    assert rows(got.select("index", "first_name", "email"), "index") == [(1, "A2", "e2"), (2, "B", "b@x")]
    resets = spark.createDataFrame([(1, "ann@x", "secret")], "seq int, email string, password string")
    hashes = [r[1] for r in rows(us.reset_passwords(users, resets, "seq").select("index", "password"), "index")]
    assert hashes[0].startswith("2bb80d537b1da3e38bd30361aa855686") and hashes[1] == "old"


# ------------------------------------------------------------------- logins

def test_gps_place_fallbacks(spark):
    places = spark.createDataFrame(
        [(1.0, 1.0, "C", "S", "R", "city", None, None), (2.0, 2.0, "C", None, "R", None, "town", "village"),
         (3.0, 3.0, "C", None, None, None, None, "village"), (4.0, 4.0, None, None, None, None, None, None)],
        "latitude double, longitude double, country string, state string, region string, city string, town string, village string",
    )
    logins = spark.createDataFrame(
        [(1, 1.001, 1.0, 5.0), (2, 2.0, 2.0, None), (3, 3.0, 3.0, 0.0), (4, 4.0, 4.0, 1.0), (5, None, 1.0, 1.0), (6, 9.0, 9.0, 1.0)],
        "login_id int, latitude double, longitude double, accuracy double",
    )
    got = rows(lg.place_by_gps(logins, places).select("login_id", "country", "region", "city", "isp"), "login_id")
    assert got == [
        (1, "C", "S", "city", "GPS Location (±5m)"), (2, "C", "R", "town", "GPS Location"),
        (3, "C", "Unknown", "village", "GPS Location"), (4, "Unknown", "Unknown", "Unknown", "GPS Location (±1m)"),
        (5, "Unknown", "Unknown", "GPS Denied or Unavailable", "No GPS Data"),
        (6, "Unknown", "Unknown", "Unknown", "GPS Location (±1m)")]
