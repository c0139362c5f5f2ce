import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import decontamination as dc

ITEM = "the quick brown fox jumps over the lazy dog while another one sleeps"


def fold(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(text, items):
    w, hit, found = fold(text), set(), set()
    for i, t in items:
        v = fold(t)
        n = min(10, len(v))
        windows = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if v else set()
        for j in range(len(w) - n + 1) if n else ():
            if tuple(w[j:j + n]) in windows:
                hit.update(range(j, j + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


WORDS = st.lists(st.sampled_from(["a", "b", "C", "é", "d1"]), max_size=30).map(" ".join)


@given(st.lists(WORDS, min_size=1, max_size=4), st.lists(WORDS, max_size=4))
@settings(max_examples=200, deadline=None)
def test_scan_equals_the_plain_rule(texts, items):
    named = [(str(i), t) for i, t in enumerate(items)]
    windows = dc.ItemWindows([(i, t.encode()) for i, t in named])
    out = dc.slice_hits([t.encode() for t in texts], windows)
    for i, t in enumerate(texts):
        at = out["_at"][i].as_py()
        got = out["n_words"][i].as_py(), sum(at[1::2]) - sum(at[::2]), out["_items"][i].as_py()
        assert got == by_hand(t, named)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_rows_and_edges(spark, make_docs, edges):
    items = [(1, ITEM), (2, None), (3, ""), (4, "Short item!"), (5, ITEM.upper()), (None, "never named item")]
    docs = edges + [(20, "so THE quick, brown fox jumps over the lazy dog while another! yes", "en", "s"),
                    (21, "a short item here", "en", "s"), (22, ITEM[4:40], "en", "s"), (23, ITEM, "en", "s")]
    out = dc.contamination(make_docs(docs), bench(spark, items)).collect()
    usable = [(i, t) for i, t in items if i is not None and t is not None]
    want = Counter((d[0], *map(str, by_hand(d[1], usable))) for d in docs)
    assert Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(list(r["items"]))) for r in out) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in out)


def test_several_sets_give_the_same(spark, make_docs):
    items = bench(spark, [(i, ITEM + f" {i} " + " ".join(f"k{i}x{j}" for j in range(12))) for i in range(20)])
    docs = make_docs([(1, ITEM), (2, " ".join(f"k3x{j}" for j in range(12)) + " k4x0 " + ITEM), (3, "nothing"), (4, None)])
    one = dc.contamination(docs, items).orderBy("doc_id").collect()
    many = dc.contamination(docs, items, most_words=60).orderBy("doc_id").collect()
    assert one == many and one[1].n_hit > 12


def test_a_window_of_very_many_items_stands_once(spark, make_docs):
    """Boilerplate that all items share is one window with a list of items, not a row per item and occurrence."""
    items = [(str(i), f"{ITEM} number {i}".encode()) for i in range(3000)]
    windows = dc.ItemWindows(items)
    assert sum(len(s[2]) for s in windows.sets) < 4 * 3000
    text = ((ITEM + " . ") * 400).encode()
    at, width, window = windows.found(np.array([windows.number.get(w, 0) for w in dc.folded_words(text)]))
    assert len(at) <= 400 * 13
    hits = dc.slice_hits([text], windows)
    assert len(hits["_items"][0]) == 3000


def test_memory_of_a_full_set(spark):
    """At the bound a set stays far below what a driver and a worker of the check tool hold."""
    import pickle
    import tracemalloc

    text = " ".join(f"w{i}x" for i in range(dc.MOST_ITEM_WORDS))
    tracemalloc.start()
    windows = dc.ItemWindows([("1", text.encode())])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and len(pickle.dumps(windows)) < 60e6


def test_spans_are_cut_and_emptied_documents_go(spark, make_docs):
    docs = make_docs([(1, "Intro words. " + ITEM + ", and the end."), (2, ITEM + "!"), (3, "clean text"), (4, None), (5, "")])
    out = dc.decontaminated(docs, bench(spark, [(1, ITEM)]))
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("Intro words. , and the end.", 27), 3: ("clean text", 10), 4: (None, None), 5: ("", 0)}
    several = dc.decontaminated(docs, bench(spark, [(i, ITEM if i == 7 else f"only item {i}") for i in range(20)]), most_words=30)
    assert {r.doc_id: (r.text, r.n_chars) for r in several.collect()} == got


def test_empty_tables(spark, make_docs):
    none = bench(spark, []).limit(0)
    assert dc.contamination(make_docs([]).limit(0), none).count() == 0
    assert dc.contamination(make_docs([(1, "a b")]), none).collect()[0].contaminated is False


def test_query_equals_sql(spark, sf_dir):
    from cohortlake.llm.registry import ORACLES
    from tests.oracle import connect, differences

    assert differences(dc.op10_decontamination(spark, sf_dir), connect(sf_dir), ORACLES["op10_decontamination"]) == []
