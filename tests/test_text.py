"""Text expressions on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlake import fixed_values as V
from cohortlake.functions import access as ac, reports as rp, text as tx


def values(spark, rows, expression, schema="t string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_every_confirmation_word(spark):
    words = [(w, "confirm") for ws in V.CONFIRM_WORDS.values() for w in ws]
    words += [(w, "cancel") for ws in V.CANCEL_WORDS.values() for w in ws]
    got = values(spark, [f"  {w.upper()} \n" for w, _ in words], tx.confirmation("t"))
    assert got == [c for _, c in words]


def test_words_inside_a_sentence_do_not_count(spark):
    assert values(spark, ["yes please", "not", "", None, "confirmed"], tx.confirmation("t")) == [None] * 5


def test_language(spark):
    got = values(spark, ["hello", "नमस्ते", "হ্যালো", "হ্যালো नमस्ते", "été", ""], tx.message_language("t"))
    assert got == ["en", "hi", "bn", "hi", "en", "en"]


INTENTS = [
    ("Set it to 40", (None, "patients_enrolled", "40")),
    ("please CHANGE to 7 now", (None, "patients_enrolled", "7")),
    ("make it 12", (None, "patients_enrolled", "12")),
    ("update it to 5", (None, "patients_enrolled", "5")),
    ("Update simulation abc_12 Patients Enrolled to 202", ("abc_12", "patients_enrolled", "202")),
    ("modify patient count to 9 for trial_x_1", ("trial_x_1", "patients_enrolled", "9")),
    ("change dropout rate to 0.25", (None, "dropout_rate", "0.25")),
    ("update cost: 500", (None, "cost", "500")),
    ("edit Phase = 2", (None, "Phase", "2")),
    ("update simulation dropout rate to 0.2", ("dropout", "dropout_rate", "0.2")),
    ("अपडेट rate to 3", (None, "rate", "3")),
    ("সেট x: 1.5", (None, "x", "1.5")),
    ("dropout rate to 0.25", None),
    ("update everything", None),
    ("Show my simulations", None),
]


def test_update_intents(spark):
    got = values(spark, [m for m, _ in INTENTS], tx.update_intent("t"))
    assert [tuple(g) if g else None for g in got] == [want for _, want in INTENTS]


def test_whole_word_patterns_find_what_the_plain_ones_find(spark):
    rng = random.Random(5)
    parts = ["a", "rate", "x_1", " to ", ":", " = ", "12", "0.5", " ", "é", "to", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    for pattern in V.ANY_FIELD_PATTERNS:
        plain = values(spark, texts, F.regexp_extract("t", "(?i)" + pattern, 1))
        fast = values(spark, texts, F.regexp_extract("t", tx._whole_word(pattern), 1))
        assert plain == fast


def test_translation(spark):
    texts = ["translate to Hindi", "অনুবাদ বাংলা", "convert to english or hindi", "translate this", "hindi"]
    assert values(spark, texts, tx.asks_translation("t")) == [True, True, True, True, False]
    assert values(spark, texts, tx.translation_target("t")) == ["hi", "bn", "hi", None, "hi"]


def test_ids_are_whole_tokens(spark):
    got = values(spark, ["see SIM_12, and sim_123.", "no ids", "sim_1 sim_1"], tx.id_tokens("t"))
    assert got == [["sim_12", "sim_123"], [], ["sim_1"]]


def test_slugs(spark):
    names = ["Study of ImmunoX-101 in Advanced Melanoma", "  NeuroRegen: Phase I! ", "Ünïcode name"]
    got = values(spark, names, tx.name_slug("t"))
    assert got == ["study_of_immunox_101", "neuroregen_phase_i", "n_code_name"]
    ids = values(spark, names, tx.readable_id("t", "t"))
    assert all(i.startswith(s + "_") and 1000 <= int(i.rsplit("_", 1)[1]) <= 9999 for i, s in zip(ids, got))
    assert ids == values(spark, names, tx.readable_id("t", "t"))


def test_patient_ids(spark):
    got = values(spark, [("study_of_x_1234", 7), ("ab", 12345)], tx.patient_id("s", "n"), "s string, n int")
    assert got == ["PAT-study_of-0007", "PAT-ab-12345"]


def test_search_keeps_the_place_of_missing_fields(spark):
    df = spark.createDataFrame([("a", None, "c"), ("a", "B", "c")], "x string, y string, z string")
    assert [r[0] for r in df.select(tx.search_text("x", "y", "z")).collect()] == ["a  c", "a b c"]
    assert [r[0] for r in df.select(tx.matches_search("B C", "x", "y", "z")).collect()] == [False, True]
    assert df.where(tx.matches_search("", "x")).count() == 2


def test_fixed_decimals_round_like_binary_formatting(spark):
    rng = random.Random(1)
    numbers = [0.25, 0.35, 2.5, 0.125, 1e6 + 0.05, 0.0, -0.25, 99.95] + [rng.uniform(-1000, 1e7) for _ in range(300)]
    for decimals in (0, 1, 2):
        got = values(spark, numbers, tx.fixed("t", decimals), "t double")
        assert [g if g not in ("-0", "-0.0") else g for g in got] == [f"{n:.{decimals}f}" for n in numbers]


ANSWERS = [
    ("SUCCESS_PROBABILITY: 72%\nCONFIDENCE: 80%\nRISK_FACTORS: a, b ,,c\nEXPLANATION: fine\nand more ",
     (0.72, 0.8, ["a", "b", "c"], "fine\nand more")),
    ("nothing", (0.65, 0.75, [], V.ANSWER_DEFAULT_EXPLANATION)),
    ("SUCCESS_PROBABILITY: 140% CONFIDENCE: -3%", (1.0, 0.0, [], V.ANSWER_DEFAULT_EXPLANATION)),
    ("SUCCESS_PROBABILITY: high CONFIDENCE: 5%x RISK_FACTORS: 1,2,3,4,5,6,7 EXPLANATION:",
     (0.65, 0.75, ["1", "2", "3", "4", "5"], "")),
    ("CONFIDENCE: none CONFIDENCE: 90%", (0.65, 0.75, [], V.ANSWER_DEFAULT_EXPLANATION)),
    ("SUCCESS_PROBABILITY:", (0.65, 0.75, [], V.ANSWER_DEFAULT_EXPLANATION)),
]


def test_tagged_answers(spark):
    got = values(spark, [a for a, _ in ANSWERS], tx.parse_answer("t"))
    for row, (_, want) in zip(got, ANSWERS):
        assert row.success_probability == pytest.approx(want[0])
        assert row.confidence_score == pytest.approx(want[1])
        assert (row.risk_factors, row.explanation) == want[2:]


def test_contexts(spark):
    got = values(spark, ['{"k": 1, "s": "x"}', "plain", "", None], tx.parse_context("t"))
    assert got == [{"k": "1", "s": "x"}, {"raw_context": "plain"}, None, None]


def test_replies_in_three_languages(spark):
    df = spark.createDataFrame([("hi",), ("bn",), ("en",), ("fr",)], "lang string")
    row = [r[0] for r in df.select(
        tx.request_text("lang", F.lit("s_1"), F.lit("dropout_rate"), F.lit(None), F.lit("0.2"))).collect()]
    assert "वर्तमान मान: N/A" in row[0] and "নতুন মান: 0.2" in row[1]
    assert row[2] == row[3] and "- Simulation ID: s_1\n- Field: dropout_rate\n- Current Value: N/A" in row[2]


def test_client_address(spark):
    rows = [("1.2.3.4, 5.6.7.8", "9.9.9.9", "p"), ("", "9.9.9.9", "p"), (None, None, "p"), (None, "", None)]
    got = values(spark, rows, ac.client_ip("f", "r", "p"), "f string, r string, p string")
    assert got == ["1.2.3.4", "9.9.9.9", "p", "unknown"]
    flags = values(spark, ["127.0.0.1", "localhost", "unknown", "192.168.0.9", "10.0.0.1"], ac.is_private("t"))
    assert flags == [True, True, True, True, False]


def test_location_labels(spark):
    rows = [(1.0, 2.0, 12.9), (1.0, 2.0, 0.0), (1.0, 2.0, None), (None, 2.0, 5.0)]
    got = values(spark, rows, ac.location_source("a", "b", "c"), "a double, b double, c double")
    assert got == ["GPS Location (±12m)", "GPS Location", "GPS Location", "No GPS Data"]


def test_advice(spark):
    df = spark.createDataFrame(
        [(501, 731, 0.21, 0.26, "OS"), (500, 730, 0.2, None, None)], "n int, d int, r double, s double, e string"
    )
    rows = df.select(rp.advice_codes("n", "d", "r", "s"), rp.advice_text("n", "d", "r", "s", "e")).collect()
    assert rows[0][0] == ["enrollment", "duration", "dropout", "cost", "endpoint", "safety", "alert"]
    assert rows[1][0] == ["cost", "endpoint", "safety"]
    assert "Current duration: 2.0 years" in rows[0][1] and "(26.0%)" in rows[0][1] and "- Primary: OS" in rows[0][1]
    assert rows[1][1].startswith("**Trial Protocol Optimization Recommendations**\n\n\n**4. Cost")


def test_heuristic_answer_is_read_back(spark):
    df = spark.createDataFrame([("Phase III", "Oncology", 600, 731, 0.26)], "p string, a string, n int, d int, r double")
    parsed = tx.parse_answer(rp.heuristic_answer("p", "a", "n", "d", "r"))
    row = df.select(parsed.alias("a"), rp.prediction_text(parsed)).first()
    assert (row.a.success_probability, row.a.confidence_score) == (0.55, 0.75)
    assert row.a.risk_factors == ["High expected dropout rate", "Long trial duration", "Complex therapeutic area"]
    assert row.a.explanation.endswith("feasible with 600 patients over 2.0 years.")
    assert "Probability: 55.0%**" in row[1] and "3. Complex therapeutic area\n\n**Analysis:**" in row[1]
    assert row[1].endswith("⚠ **Assessment**: Moderate probability. Consider risk mitigation strategies.")
