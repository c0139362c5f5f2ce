import math
import re

import numpy as np
import pytest

from cohortlake.llm import toxicity as tx


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=1500):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(n):
        w = [f"w{j}" for j in rng.integers(0, 300, 60)]
        bad = i % 7 == 0
        if bad:
            w[5], w[20] = f"awful{rng.integers(0, 3)}", f"Nasty{rng.integers(0, 3)}!"
        rows.append((i, " ".join(w)))
        if i % 2:
            marks.append((i, 1, int(bad)))
    return rows, marks


def test_held_out_documents_are_told_apart(spark, make_docs, edges):
    rows, marks = corpus()
    docs = make_docs(rows + [(e[0] and 10_000 + e[0], *e[1:]) for e in edges])
    marks = marks + [(None, 1, 1), (3, 1, None), (7, 0, 0), (7, 1, 1), (99_999, 1, 1)]
    out = tx.toxicity_scores(docs, tx.learned(docs, labels(spark, marks))).collect()
    assert len(out) == len(rows) + len(edges)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and tx.held_out(r.doc_id)) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 10_000]
    right = [(r.doc_id % 7 == 0) == bool(r.predicted) for r in held]
    assert len(held) > 200 and np.mean(right) > 0.97


def test_held_out_labels_do_not_count(spark, make_docs):
    rows, marks = corpus(600)
    docs = make_docs(rows)
    flipped = [(i, q, 1 - t if tx.held_out(i) else t) for i, q, t in marks]
    a, b = (sorted(tx.toxicity_scores(docs, tx.learned(docs, labels(spark, m))).collect()) for m in (marks, flipped))
    assert a == b


def test_without_examples_or_documents(spark, make_docs):
    docs = make_docs([(1, "a"), (2, None)])
    out = tx.toxicity_scores(docs, tx.learned(docs, labels(spark, []))).collect()
    assert all(r.score < 0.01 for r in out)
    empty = make_docs([]).limit(0)
    assert tx.toxicity_scores(empty, tx.learned(empty, labels(spark, [(1, 1, 1)]))).count() == 0


def test_the_correction_bounds_the_risk():
    rows = [np.array([0], np.int32)] * 20 + [np.array([1], np.int32)] * 80
    model = tx.fitted(rows, np.arange(100) < 20, [b"bad", b"good"], 0.2)
    assert model.scores([b"bad", b"good"])[0] > 0.5 > model.scores([b"bad", b"good"])[1]


def plain_risk(z, is_p, prior):
    """The two parts of the risk, text by text."""
    up = [math.log1p(math.exp(-x)) for x in z]
    down = [math.log1p(math.exp(x)) for x in z]
    p = [i for i in range(len(z)) if is_p[i]]
    u = [i for i in range(len(z)) if not is_p[i]]
    return prior * sum(up[i] for i in p) / len(p), sum(down[i] for i in u) / len(u) - prior * sum(down[i] for i in p) / len(p)


@pytest.mark.parametrize("lift,shift,corrects", [(0.5, 0.0, False), (4.0, -6.0, True)])
def test_slopes_equal_finite_differences(lift, shift, corrects):
    """The risk falls along the slopes; where its second part is below 0, that part rises along them."""
    rng = np.random.default_rng(8)
    is_p = np.arange(40) < 15
    z = rng.normal(size=40) + np.where(is_p, lift, shift)
    slopes, corrected = tx.risk_slopes(z, is_p, 0.4)
    assert corrected == corrects == (plain_risk(z, is_p, 0.4)[1] < 0)
    for i in range(40):
        parts = []
        for d in (1e-5, -1e-5):
            moved = z.copy()
            moved[i] += d
            first, second = plain_risk(moved, is_p, 0.4)
            parts.append(-second if corrects else first + second)
        assert abs((parts[0] - parts[1]) / 2e-5 - slopes[i]) < 1e-6


def test_scores_equal_plain_sums():
    model = tx.Model({b"bad": 2.0, b"worse": 3.5, "\u00fcbel".encode(): -1.0}, -1.5)
    texts = ["Bad bad, WORSE!", "nothing", "", None, "\u00dcbel \u00fcbel bad", "x" * 10_000 + " worse"]
    for text, score in zip(texts, model.scores([t if t is None else t.encode() for t in texts]), strict=True):
        words = set(re.findall("[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        total = -1.5 + sum(v for w, v in (("bad", 2.0), ("worse", 3.5), ("\u00fcbel", -1.0)) if w in words)
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12


def test_query_finds_labelled_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = tx.op7_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert len(out) == 399
    assert ((out.predicted == 1) == (out.toxic == 1)).mean() > 0.9
    assert out[(out.toxic == 0)].predicted.mean() < 0.05
