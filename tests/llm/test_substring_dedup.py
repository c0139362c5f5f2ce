import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import substring_dedup as sd
from cohortlake.llm.common import words_of_many


def by_hand(rows, least=13):
    """(key, words, removed, digest) of each row."""
    first = {}
    words = [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in words:
        for j in range(len(w) - least + 1):
            if k is not None:
                first[tuple(w[j:j + least])] = min(k, first.get(tuple(w[j:j + least]), k))
    out = []
    for k, w in words:
        gone = {x for j in range(len(w) - least + 1) if k is not None and first[tuple(w[j:j + least])] < k for x in range(j, j + least)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def compare(make_docs, rows, **settings):
    out = sd.without_repeats(make_docs(rows), **settings).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out)
    assert got == Counter(by_hand([(r[0], r[1]) for r in rows], settings.get("least", 13)))
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 4))
@settings(max_examples=200, deadline=None)
def test_runs_cover_every_window_once(ids, anchor):
    hashes, begin = words_of_many([b" ".join(b"%d" % i for i in ids), b"1 2 3 1 2 3 1 2"])
    _, content, text, start, windows = sd.anchored_runs(hashes, begin, 6, anchor)
    covered = sorted((t, s + j) for t, s, n in zip(text.tolist(), start.tolist(), windows.tolist(), strict=True) for j in range(n))
    assert covered == [(t, j) for t, n in enumerate(np.diff(begin)) for j in range(n - 5)]


def test_copies_passages_and_edges(make_docs, edges):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 9, 4000)]  # few words: many chance repeats of anchors
    rows = [(10 + i, " ".join(base[s:s + n])) for i, (s, n) in enumerate(zip(rng.integers(0, 3800, 80), rng.integers(0, 120, 80), strict=True))]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(400, rows[5][1]), (400, rows[6][1])]  # copies, one key twice
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(600 + i, f"a{i} b{i} " + passage + f"  \tc{i}") for i in range(12)]
    rows += [(700, "spam " * 500), (701, "spam " * 12), (702, "spam " * 13), (703, "egg " * 40)]
    compare(make_docs, [*rows, *[(e[0], e[1]) for e in edges]])


def test_small_windows(make_docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("abc"[j] for j in rng.integers(0, 3, rng.integers(0, 30)))) for i in range(60)]
    compare(make_docs, rows, least=6, anchor=3)


def test_empty_table(make_docs):
    assert sd.without_repeats(make_docs([]).limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = sd.op2_substring_dedup(spark, sf_dir).collect()
    assert Counter(map(tuple, out)) == Counter(by_hand(rows))


def test_query_equals_sql(spark, sf_dir):
    from cohortlake.llm.registry import ORACLES
    from tests.oracle import connect, differences

    assert differences(sd.op2_substring_dedup(spark, sf_dir), connect(sf_dir), ORACLES["op2_substring_dedup"]) == []
