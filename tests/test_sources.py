"""Reading, creating, appending, exporting and replacing tables."""

import datetime as dt

from pyspark.sql import functions as F

from cohortlake import schemas as S
from cohortlake.sources import tables as tb, versions as vs

CHAT = (
    "chat_id,user_id,simulation_id,timestamp,message,response,language,action_type\n"
    'c1,1,,2031-02-03T04:05:06.070809,"Hello, you","Line one\n\nLine ""two""",en,chat\n'
    "c2,2,s_1,2031-02-03T05:06:07,yes,done,hi,update_executed\n"
)


def test_multi_line_csv(spark, tmp_path):
    (tmp_path / "chat.csv").write_text(CHAT, encoding="utf-8")
    got = tb.read_csv_table(spark, str(tmp_path / "chat.csv"), S.CHAT).orderBy("chat_id").collect()
    assert len(got) == 2
    assert got[0].message == "Hello, you" and got[0].response == 'Line one\n\nLine "two"'
    assert got[0].timestamp == dt.datetime(2031, 2, 3, 4, 5, 6, 70809) and got[0].simulation_id is None


def test_typed_csv_and_parquet(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "trial_id,trial_name,phase,therapeutic_area,drug_name,indication,enrollment,duration_days,status,success,"
        "dropout_rate,adverse_events,cost_usd,start_date,completion_date\n"
        "N1,Name,Phase II,Oncology,D,I,90,400,Completed,TRUE,0.25,7,1234500,2031-01-02,2032-02-03\n"
        "N2,Name,Phase I,Oncology,D,I,many,400,Completed,FALSE,0.25,7,1234500,2031-01-02,\n"
    )
    got = tb.load_csv_as_parquet(spark, str(tmp_path / "t.csv"), str(tmp_path / "p"), S.TRIALS).orderBy("trial_id").collect()
    assert got[0].success is True and got[0].start_date == dt.date(2031, 1, 2) and got[0].cost_usd == 1234500
    assert got[1].enrollment is None and got[1].completion_date is None


def test_create_only_when_absent(spark, tmp_path):
    path = str(tmp_path / "users")
    tb.create_if_absent(spark, path, S.USERS)
    tb.append(spark.createDataFrame([(1, "a", "b", "c", "d", "e")], S.USERS), path)
    tb.create_if_absent(spark, path, S.USERS)
    assert tb.read_table(spark, path, S.USERS).count() == 1
    tb.create_all(spark, str(tmp_path / "all"))
    assert tb.read_table(spark, str(tmp_path / "all" / "login_history")).schema.names == S.LOGINS.names


def test_append_results_by_name(spark, tmp_path):
    new = spark.createDataFrame([(0.5, "mine_1", ["x"], 7)],
                                "success_probability double, simulation_id string, optimization_suggestions array<string>, patients_enrolled int")
    row = tb.results_to_append(new, S.RESULTS, "2025-01-01 10:00:00")
    assert row.schema.names == S.RESULTS.names
    got = row.first()
    assert got.simulation_id == "mine_1" and got.patients_enrolled == 7 and got.optimization_suggestions is None
    assert got.created_at == dt.datetime(2025, 1, 1, 10) and got.updated_at is None
    tb.append(row, str(tmp_path / "r"))
    tb.append(row, str(tmp_path / "r"))
    assert tb.read_table(spark, str(tmp_path / "r"), S.RESULTS).count() == 2


def test_chat_rows_get_ids_and_an_empty_target(spark):
    df = spark.createDataFrame([("u", None, "m", "r", "en", "chat")] * 2,
                               "user_id string, simulation_id string, message string, response string, language string, action_type string")
    got = tb.chat_to_append(df).collect()
    assert len({r.chat_id for r in got}) == 2 and all(r.simulation_id == "" and r.timestamp for r in got)


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, k int")
    assert sorted(map(tuple, tb.append_by_name(a, b).collect()), key=str) == [(1, "x", None), (2, None, "y")]


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert tb.to_json_records(df).first().record == '{"a":1,"b":null}'


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nline')], "k int, t string")
    for fmt in ("csv", "json", "parquet"):
        path = str(tmp_path / fmt)
        tb.export(df, path, fmt)
        back = tb.read_csv_table(spark, path, df.schema) if fmt == "csv" else spark.read.schema(df.schema).format(fmt).load(path)
        assert [tuple(r) for r in back.collect()] == [(1, 'a "quoted", text\nline')]


def test_replacing_a_table_that_is_being_read(spark, tmp_path):
    path = str(tmp_path / "v")
    assert vs.current_version(spark, path) == 0
    vs.replace_table(spark.range(3).toDF("k"), path)
    before = vs.read_current(spark, path)
    vs.replace_table(before.where("k > 0"), path, "b1")
    assert before.count() == 3
    assert sorted(r.k for r in vs.read_current(spark, path).collect()) == [1, 2]
    assert vs.is_committed(spark, path, "b1") and not vs.is_committed(spark, path, "b2")


def test_an_attempt_without_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "v")
    vs.replace_table(spark.range(1).toDF("k"), path)
    spark.range(9).toDF("k").write.parquet(f"{path}/version=2")
    assert vs.read_current(spark, path).count() == 1
    vs.replace_table(spark.range(5).toDF("k"), path)
    assert vs.read_current(spark, path).count() == 5
    assert vs.read_current(spark, path).select(F.max("k")).first()[0] == 4
