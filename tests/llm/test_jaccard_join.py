import re

import numpy as np
import pytest

from cohortlake.llm import jaccard_join as jj


def sets_of(rows, width):
    out = []
    for _, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        out.append(frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def by_hand(rows, width=3, percent=90):
    sets = sets_of(rows, width)
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            alike = a and b and 100 * both >= percent * (len(a) + len(b) - both)
            if None not in (rows[i][0], rows[j][0]) and (alike or rows[i][0] == rows[j][0] and a and b):
                label[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted(((k, len(s), None if k is None else low[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def compare(make_docs, rows, **settings):
    out = jj.similar_components(make_docs(rows), **settings).collect()
    assert sorted(map(tuple, out), key=str) == by_hand([(r[0], r[1]) for r in rows], **settings)


def near_copies(rng, count, words, edits):
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(0, len(w))] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("settings", [{}, {"width": 5, "percent": 80}])
def test_groups_chains_and_edges(make_docs, edges, settings):
    rng = np.random.default_rng(11)
    texts = [t for n, w, e in ((60, 100, 4), (25, 300, 12), (20, 40, 1), (5, 5, 1)) for t in near_copies(rng, n, w, e)]
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[8 * i:8 * i + 200]) for i in range(20)]  # each like the next, ends unlike
    texts += [t.upper() for t in texts[:5]] + texts[:10] + ["one two", "ONE two", "two one", "solo", "solo"]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)) + 10, texts, strict=True)]
    rows += [(9, rows[0][1]), (9, "another text of the very same key " * 3)]
    compare(make_docs, [*rows, *[(e[0], e[1]) for e in edges]], **settings)


def test_long_lists_are_searched_in_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 7)
    monkeypatch.setattr(jj, "LEADERS", 1)
    rng = np.random.default_rng(2)
    texts = near_copies(rng, 70, 64, 5)  # sizes on both sides of a power of two
    texts += [t + " tail" * (i % 3) for i, t in enumerate(near_copies(rng, 40, 66, 4))]
    compare(make_docs, [(i, t) for i, t in enumerate(texts)])


def links_by_hand(rows, width=3, percent=90):
    """Pairs of documents with different sets that link, and links per document."""
    keyed = [(k, s) for (k, _), s in zip(rows, sets_of(rows, width), strict=True) if k is not None and s]
    pairs, counts = set(), {k: 0 for k, _ in keyed}
    for i, (a, s) in enumerate(keyed):
        for b, t in keyed[:i]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                counts[a] += 1
                counts[b] += 1
                if s != t:
                    pairs.add((min(a, b), max(a, b)))
    return pairs, counts


@pytest.mark.parametrize("settings", [{}, {"width": 5, "percent": 80}])
def test_links_are_all_there(make_docs, settings):
    """Every link between different texts, also inside a component, and the copies by their class."""
    rng = np.random.default_rng(5)
    texts = [t for n, w, e in ((40, 100, 4), (30, 60, 2), (5, 5, 1)) for t in near_copies(rng, n, w, e)]
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[8 * i:8 * i + 200]) for i in range(10)] + texts[:8] + texts[3:5] + ["one two", "solo", "", None]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(None, texts[0])]
    pairs, counts = links_by_hand(rows, **settings)
    links, member = jj.similar_links(make_docs(rows), **settings)
    node, classes = {}, {}
    for r in member.collect():
        node[r.doc_id] = r.node
        classes.setdefault(r.node, []).append(r.doc_id)
    got = {(min(a, b), max(a, b)) for x, y in links.collect() for a in classes[x] for b in classes[y]}
    assert got == pairs and all(n == min(c) for n, c in classes.items())
    assert {r.doc_id: r.n_links for r in jj.link_counts(links, member).collect()} == counts


def test_a_large_cluster_of_near_copies(make_docs):
    """Eight hundred near copies of one page, all different, are one component."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(800):
        w = list(base)
        w[int(rng.integers(0, 150))] = f"e{i}"
        rows.append((i, " ".join(w)))
    out = jj.similar_components(make_docs(rows)).collect()
    assert {r.component_id for r in out} == {0} and len(out) == 800


def test_empty_table(make_docs):
    empty = make_docs([]).limit(0)
    assert jj.similar_components(empty).count() == 0
    assert jj.one_of_each(empty).columns == empty.columns


def test_one_of_each_group_stays(make_docs, edges):
    docs = make_docs([(10, "a b c d e f g"), (11, "a b c d e f g"), (12, "x y z"), *[(e[0], e[1]) for e in edges]])
    out = jj.one_of_each(docs)
    assert out.columns == docs.columns
    # 6 copies 5; empty texts and rows without a key stay
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([10, 12, 1, 2, 3, 4, 5, 7, None, None, 8], key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = jj.op5_jaccard_join(spark, sf_dir).collect()
    assert sorted(map(tuple, out), key=str) == by_hand(rows)


def test_percent_below_fifty_is_refused(make_docs):
    with pytest.raises(ValueError):
        jj.similar_components(make_docs([(1, "a b c"), (2, "a b c d")]), percent=49)
