from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from cohortlake.llm import mixing


def targets_by_hand(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_targets_and_copies(spark, make_docs, edges):
    rows = [(100 + i, "w " * (1 + i % 7), "en", s) for i, s in enumerate(["a", "b", "c", "d", "é", "z", "𝔘", None, ""] * 60)] + edges
    got = mixing.mixture_plan(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = targets_by_hand(sizes)
    drawn = {r.k: r.d for r in spark.createDataFrame([(k,) for k in {r[0] for r in rows}], "k long").select(
        "k", F.pmod(F.xxhash64(F.lit(mixing.SEED), "k"), F.lit(1 << 53)).alias("d")).collect()}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 2
        if abs(drawn[r.doc_id] / 2**53 - float(rate % 1)) > 1e-9:
            assert r.copies == int(rate) + (drawn[r.doc_id] / 2**53 < rate % 1)
    again = mixing.mixture_plan(make_docs(rows).repartition(13)).collect()
    assert Counter(got) == Counter(again)


def test_taken_words_come_near_the_target(spark, make_docs):
    rows = [(i, "w " * (20 + i % 9), "en", f"s{i % 6}") for i in range(6000)]
    out = mixing.mixture_plan(make_docs(rows)).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()
    assert all(abs(r.t - r.target) < 0.06 * r.target for r in out)


def test_documents_are_repeated_whole(make_docs, edges):
    docs = make_docs([(100 + i, "a b c", "en", "s") for i in range(50)] + edges)
    plan = mixing.mixture_plan(docs).select("doc_id", "copies").distinct().collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = Counter(r.doc_id for r in docs.collect())
    want = {r.doc_id: r.copies * rows[r.doc_id] for r in plan if r.doc_id is not None and r.copies}
    got = Counter(r.doc_id for r in out.collect())
    assert {k: v for k, v in got.items() if k is not None} == want


def test_empty_table(make_docs):
    assert mixing.mixture_plan(make_docs([]).limit(0)).count() == 0
    assert mixing.mixed_documents(make_docs([]).limit(0)).count() == 0


def test_no_python_in_the_plans(spark, sf_dir, make_docs):
    for df in (mixing.op9_mixing(spark, sf_dir), mixing.mixed_documents(make_docs([(1, "a")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
