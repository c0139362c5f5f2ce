"""Page index, search postings and split CSV against the plain ways."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from cohortlake.operators import results as rs
from cohortlake.sources import rank_index as ri, search_index as si, split_csv as sc, tables as tb


def files_read(df):
    """Files that the scans of a plan without shuffles have opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def results(spark):
    r = random.Random(3)
    rows = [(f"sim_{i}", r.choice([None, 0.1, 0.5, 0.9]), r.choice([None, 5, 7]), f"Study of Drug-{i % 97} in Onco{'ß' * (i % 2)}logy",
             f"Drug-{i % 97}", f"Condition {i % 31}", "Phase I") for i in range(2000)]
    df = spark.createDataFrame(rows, "simulation_id string, success_probability double, patients_enrolled int, trial_name string, "
                                     "drug_name string, indication string, phase string")
    return df.repartition(6).cache()


def test_every_page_is_the_page_of_the_sort(spark, results, tmp_path):
    order = rs.sort_columns("success_desc")
    ri.build_rank_index(results, order, str(tmp_path))
    for number in (1, 2, 80, 167):
        want = [r.simulation_id for r in rs.page(results, "success_desc", number).collect()]
        got = ri.indexed_page(results, str(tmp_path), number).collect()
        assert [r.simulation_id for r in got] == want and [r.position for r in got] == [12 * (number - 1) + i + 1 for i in range(len(want))]
    assert ri.indexed_page(results, str(tmp_path), 168).count() == 0
    every = ri.ranked_keys(spark, str(tmp_path), 1, 2000)
    assert sorted(r.position for r in every.collect()) == list(range(1, 2001))


def test_a_deep_page_reads_one_range(spark, tmp_path):
    rows = spark.range(1_000_000).select(F.concat(F.lit("s"), "id").alias("simulation_id"), (F.col("id") % 1000).cast("int").alias("patients_enrolled"))
    ri.build_rank_index(rows, rs.sort_columns("patients_asc"), str(tmp_path))
    ranges = spark.read.parquet(f"{tmp_path}/ranks").select("part").distinct().count()
    page = ri.ranked_keys(spark, str(tmp_path), 900_001, 12)
    assert ranges > 3 and files_read(page) == 1
    assert page.count() == 12 and set(page.columns) == {"simulation_id", "position"}


def test_an_empty_table_has_no_pages(spark, results, tmp_path):
    ri.build_rank_index(results.limit(0), rs.sort_columns("success_desc"), str(tmp_path))
    assert ri.indexed_page(results.limit(0), str(tmp_path), 1).count() == 0
    si.build_search_index(results.limit(0), f"{tmp_path}/s")
    assert si.indexed_search(results.limit(0), f"{tmp_path}/s", "drug-1").count() == 0


@pytest.mark.parametrize("term", ["DRUG-42 Cond", "sim_1999", "ßlogy drug-5", "a", "", "drug", "no such words", "Phase I", "in Onco", "96 condition 3"])
def test_search_by_postings_equals_the_scan(spark, results, tmp_path_factory, term):
    path = str(tmp_path_factory.getbasetemp() / "search-index")
    try:
        spark.read.parquet(f"{path}/size")
    except Exception:
        si.build_search_index(results, path)
    key = lambda df: sorted(r.simulation_id for r in df.select("simulation_id").collect())
    assert key(si.indexed_search(results, path, term)) == key(rs.search(results, term))


def test_rare_terms_read_few_postings(spark, results, tmp_path):
    path = str(tmp_path / "i")
    si.build_search_index(results, path)
    every = spark.read.parquet(f"{path}/postings").inputFiles()
    rare = si.rarest_parts(spark, path, "sim_1234")
    assert len(rare) == si.PARTS_READ and si.rarest_parts(spark, path, "condition") is None and si.rarest_parts(spark, path, "zzz") == []
    assert 0 < files_read(si.read_postings(spark, path, rare)) < len(every) / 10
    assert si.candidates(spark, path, rare).count() < 50


def test_postings_are_whole_and_not_shuffled(spark, results, tmp_path, monkeypatch):
    """Rows are dealt to tasks before they are taken apart; a part of all rows is in several files."""
    dealt, frame = [], type(results)
    for name in ("repartition", "repartitionByRange"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name): dealt.append(self) or f(self, *a))
    si.build_search_index(results, str(tmp_path))
    plans = [df._jdf.queryExecution().analyzed().toString() for df in dealt]
    assert plans and not [p for p in plans if "Generate" in p]
    postings = spark.read.parquet(f"{tmp_path}/postings")
    texts = {r.simulation_id: " ".join([r.simulation_id, r.trial_name, r.drug_name, r.indication, r.phase]).lower() for r in results.collect()}
    want = sorted((p, k) for k, text in texts.items() for p in si.parts_of(text))
    assert sorted((r.part, r.simulation_id) for r in postings.collect()) == want
    assert postings.where("part = 'sim'").select(F.input_file_name()).distinct().count() > 1
    counts = {r.part: r.n for r in spark.read.parquet(f"{tmp_path}/counts").collect()}
    assert counts["sim"] == 2000 and sum(counts.values()) == len(want)


SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])


@pytest.mark.parametrize("block", [64, 1000, 10**8])
def test_split_csv_equals_multi_line(spark, tmp_path, block):
    """Line breaks, doubled quotes and commas inside quotes; blocks that begin anywhere, also inside a record."""
    r = random.Random(7)
    pieces = ["x", "line\nbreak", 'say ""hi""', "\n\n", "a,b", "é𝔘", " ", '""""', "word " * 30]
    lines = ["a,b,c"]
    for i in range(300):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 4)))
        field = f'"{text}"' if r.random() < 0.7 or any(ch in text for ch in '",\n') else text
        lines.append(f"{i if i % 11 else 'bad'},{field},{r.choice(['1.5', '', 'x', '-2e3'])}")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "in" / "two.csv").write_text('a,b,c\n7,"end\nwithout feed",1', encoding="utf-8")
    (tmp_path / "in" / "three.csv").write_text("a,b,c\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        lines = sc.numbered_lines(spark, str(tmp_path / "in"))
        assert block > 1000 or lines.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] > 3
        got = sc.read_split_csv(spark, str(tmp_path / "in"), SCHEMA).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = tb.read_csv_table(spark, str(tmp_path / "in"), SCHEMA).collect()
    assert len(got) == 301 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_split_csv_refuses_another_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,z,c\n1,2,3\n")
    with pytest.raises(ValueError):
        sc.read_split_csv(spark, str(tmp_path / "x.csv"), SCHEMA)
