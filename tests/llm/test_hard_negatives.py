import math

import numpy as np
import pytest

from cohortlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id long, q string, score long"


def frame(spark, rows):
    """Rows (vec_id, embedding, label) with further columns whose names the operator uses."""
    floats = [(k, v and [None if x is None else float(x) for x in v], label) for k, v, label in rows]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in floats], SCHEMA)


def plain(rows, every, positives=5, negatives=5, percent=80):
    """All scores of all anchors, without index, bounds or blocks; big whole numbers of Python."""
    seen = {}
    for k, v, label in rows:
        if None in (k, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256.0 * float(np.float32(x))) for x in v)
        if sum(x * x for x in q) < 2**55:
            seen[k, label, q] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, label, q in seen:
        if k % every:
            continue
        scored = sorted((-dot(q, r), j, other) for j, other, r in seen if j != k)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s]
            out += [(k, p, i + 1, x[1], -s, -x[0]) for i, x in enumerate(fits[:negatives])]
    return sorted(out)


def got(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.select(*cols).collect()))


def clustered(n, seed, width=6, centres=7, spread=0.2):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, width))
    return [(i, [float(np.float32(x)) for x in middle[i % centres] + spread * r.normal(size=width)], int(r.integers(4)))
            for i in range(n)]


@pytest.mark.parametrize("leaf,block", [(16, 4096), (64, 10)])
def test_equals_plain_search(spark, monkeypatch, leaf, block):
    """Several levels, leaves of several blocks, several rounds of anchors."""
    monkeypatch.setattr(hn, "LEAF_ROWS", leaf)
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "SET_BYTES", 8 * 14 * 20)
    rows = clustered(600, 3)
    want = plain(rows, 10)
    assert len(want) > 300
    assert got(hn.mined(frame(spark, rows).repartition(5), lambda k: k % 10 == 0)) == want


def test_copies_ties_and_a_hot_vector(spark, monkeypatch):
    """A third of all rows is one vector under several keys and labels, many rows are repeated whole."""
    monkeypatch.setattr(hn, "LEAF_ROWS", 20)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    rows = clustered(150, 4, centres=3) + [(1000 + i, [1.0, 0.5, 0, 0, 0, 0.25], i % 3) for i in range(150)]
    rows += rows[::3] + [rows[0]] * 100
    assert got(hn.mined(frame(spark, rows), lambda k: k % 10 == 0)) == plain(rows, 10)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.1], 2), (3, [0.9, None], 2), (4, [nan, 1.0], 2), (5, None, 2),
            (6, [1.0, 0.0], None), (None, [0.9, 0.0], 2), (7, [-inf, 1.0], 2), (8, [3e38, 1.0], 2), (9, [], 2), (10, [0.95], 2),
            (11, [0.85, 0.0, 7.0], 3), (20, [-1.0, 0.0], 1), (30, [0.0, 0.0], 3), (40, [1e6, -1e6], 1), (41, [1e6, 2e6], 1),
            (42, [9e5, -9e5], 2), (20, [5.0, 5.0], 2)]
    want = plain(rows, 10)
    assert {w[0] for w in want} >= {0} and want
    assert got(hn.mined(frame(spark, rows), lambda k: k % 10 == 0)) == want


def test_large_scores_are_exact(spark):
    """Above 2**53 the products are multiplied as whole numbers."""
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in (200_000 + 1000 * r.normal(size=6))], i % 2) for i in range(60)]
    want = plain(rows, 5)
    assert max(w[4] for w in want) > 2**53
    assert got(hn.mined(frame(spark, rows), lambda k: k % 5 == 0)) == want


def test_no_rows_and_no_anchors(spark):
    assert hn.mined(frame(spark, []), lambda k: k % 100 == 0).collect() == []
    out = hn.mined(frame(spark, [(1, [1.0], 1)]), lambda k: k % 100 == 0)
    assert out.collect() == [] and len(out.columns) == 6
    assert got(hn.mined(frame(spark, [(0, [1.0], 1)]), lambda k: k % 100 == 0)) == []
    assert got(hn.mined(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)]), lambda k: k % 100 == 0)) == []


def test_ranges_drop_leaves_and_no_row(spark):
    """On clustered rows most leaves are out of reach of a window; those dropped hold no row of it."""
    rows = clustered(2000, 5, width=4, centres=12, spread=0.02)
    q = np.floor(256 * np.array([v for _, v, _ in rows]))
    top = float((q * q).sum(1).max())
    tree = hn.grown(q[::4], top, 40)
    lifted, leaf = tree.lifted(q), tree.leaf_of(tree.lifted(q))
    tree.low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
    tree.high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
    for number in range(tree.leaves):
        for node, child in tree.path(number):
            if (leaf == number).any():
                d = tree.distances(node, lifted[leaf == number])
                tree.low[node][:, child] = np.minimum(tree.low[node][:, child], d.min(0))
                tree.high[node][:, child] = np.maximum(tree.high[node][:, child], d.max(0))
    scores = q[:50] @ q.T
    most = np.sort(scores, 1)[:, -20:-19]
    anchors = hn.Anchors(np.arange(50), np.zeros(50), q[:50], leaf[:50], hn.percent_of(most, 97), most)
    search = hn.Search(tree, anchors, False, 5, True)
    dropped = 0
    for number in range(tree.leaves):
        alive = search.alive(number, False)
        fits = ((scores >= anchors.least) & (scores <= anchors.most))[:, leaf == number].any(1)
        assert set(np.flatnonzero(fits)) <= set(alive)
        dropped += 50 - len(alive)
    assert tree.leaves > 20 and dropped > 0.4 * 50 * tree.leaves
