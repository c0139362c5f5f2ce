from collections import Counter

import corpus_pipeline
from cohortlake.llm import decontamination, jaccard_join, mixing, quality
from cohortlake.llm.common import stored
from cohortlake.llm.registry import ORACLES
from tests.llm import test_decontamination, test_jaccard_join, test_line_dedup, test_quality
from tests.oracle import connect


def test_stages_equal_their_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, sf_dir), "test")
        after = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality rules":
            for r in before:
                n, _, _, _, repeated = test_quality.by_hand(r.text)
                if n < 50 or 100 * repeated > 50 * n:
                    assert r not in after
            assert set(after) <= set(before)
            con = connect(sf_dir)  # the fences by the query's own SQL
            kept_ids = con.execute(f"SELECT doc_id FROM ({ORACLES['op1_quality_rules']}) WHERE kept").fetchall()
            assert sorted(r.doc_id for r in after) == sorted(i for i, in kept_ids)
        elif name == "line dedup":
            want = test_line_dedup.by_hand([(r.source, r.text) for r in before], wide=(5, 20))
            assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, t) for r, t in zip(before, want, strict=True))
        elif name == "n-gram Jaccard join":
            found = test_jaccard_join.by_hand([(r.doc_id, r.text) for r in before], 5, 80)
            assert {r.doc_id for r in after} == {k for k, _, c in found if k == c}
        elif name == "benchmark decontamination":
            assert len(after) == len(before)
            assert all(test_decontamination.by_hand(r.text, bench)[1] == 0 or r.n_chars == len(r.text) for r in after)
            changed = {r.doc_id for r in before} - {r.doc_id for r in set(before) & set(after)}
            assert changed == {r.doc_id for r in before if test_decontamination.by_hand(r.text, bench)[1]}
        else:
            plan = {r.doc_id: r.copies for r in mixing.mixture_plan(spark.createDataFrame(before)).collect()}
            assert Counter(after) == Counter({r: plan[r.doc_id] for r in before if plan[r.doc_id]})
        kept.append(len(after))
    assert kept[0] > kept[2] > 0 and kept[0] == kept[1]


def test_run_gives_the_mixture_of_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_stages_take_edge_rows_and_empty_tables(spark, sf_dir, make_docs, edges):
    for docs in (make_docs(edges), make_docs([]).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count()


def test_line_stage_drops_a_line_of_a_tenth_of_a_source(spark, sf_dir, make_docs):
    def text(i):
        lines = [f"first {i}", f"natural {i % 25}", f"last {i}"]  # a natural line stands on 4 % of the texts
        return "\n".join(lines[:1] + ["All of it is licensed"] * (i % 10 == 0) + lines[1:])

    rows = [(i, text(i), "en", "many") for i in range(500)]
    copies = [(1000 + i, "a copied text\nof two lines", "en", "many") for i in range(100)]
    few = [(2000 + i, text(i), "en", "few") for i in range(50)]  # five texts hold the line: too few for a share of a tenth
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    got = {r.doc_id: r.text for r in stage(spark, make_docs(rows + copies + few), sf_dir).collect()}
    want = {r[0]: r[1].replace("All of it is licensed\n", "") for r in rows} | {r[0]: r[1] for r in copies + few}
    assert got == want


def test_parameters_of_the_stages():
    assert quality.MIN_WORDS == 50 and decontamination.WINDOW == 10 and jaccard_join.SHINGLE_WORDS == 3
