import random
import re
from collections import Counter
from zlib import crc32

import pytest

from cohortlake.llm import spelling as sp


def apart(a, b):
    """True if one inserted, deleted or replaced letter makes a into b; plain comparison of all ways."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows, least=7):
    out = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def plain_variants(counts, times=10):
    form, out = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if apart(w, x)]
        top = min(near, key=lambda x: (-counts[x], x), default=None)
        if top is not None and counts[top] >= times * n:
            form[w] = top
        out[w] = len(near)
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, out[w], counts.get(form.get(w))))
    return sorted(rows, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_words(n, seed, letters="abä", least=7, most=11):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("letters,n", [("abä", 700), ("ab", 300), ("abcdefgÿ", 500)])
def test_index_finds_what_plain_comparison_finds(letters, n):
    words = some_words(n, 1, letters)
    want = {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if apart(x, y)}
    assert set(sp.near_in_block(words, words)) == want
    few = words[::7]
    assert set(sp.near_in_block(few, words)) == {(i, b) for i, x in enumerate(few) for b, y in enumerate(words) if apart(x, y)}


def test_index_of_lengths_apart():
    words = ["a" * n for n in (7, 8, 9, 12, 70, 71)] + ["b" * 2000, "b" * 1999 + "c"]
    assert set(sp.near_in_block(words, words)) == {(0, 1), (1, 0), (1, 2), (2, 1), (4, 5), (5, 4), (6, 7), (7, 6)}
    assert set(sp.near_in_block(["x" * 9], ["x" * 9])) == set()


@pytest.mark.parametrize("block", [16, 4096])
def test_variants_of_a_dense_vocabulary(spark, monkeypatch, block):
    """Few letters: most words have neighbours, and many share their ends, so buckets are cut into parts."""
    monkeypatch.setattr(sp, "BLOCK_WORDS", block)
    r = random.Random(5)
    counts = {w: r.choice([2, 2, 3, 20, 30, 300, 3000, 40_000]) for w in some_words(400, 2)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert got(sp.spelling_variants(words)) == plain_variants(counts)


def test_forms_follow_to_the_last_root(spark):
    counts = {"aaaaaaab": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaaaac": 2000, "caaaaaaaac": 20_000, "zzzzzzz": 9}
    rows = {r.word: r for r in sp.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert rows["aaaaaaab"].form == "aaaaaaaa" or counts[rows["aaaaaaab"].form] > 20
    assert {rows[w].root for w in list(counts)[:5]} == {"caaaaaaaac"}
    assert tuple(rows["zzzzzzz"]) == ("zzzzzzz", None, "zzzzzzz", 9, 0, None)


def test_counts_of_edges(make_docs, edges):
    rows = [r[:2] for r in edges] + [(i, "Straßen STRAßEN straßen naïveté Naïveté ×÷×÷×÷× ab-cdefghi Ābcdefgh") for i in range(200)]
    docs = make_docs([(*r, "en", "s") for r in rows])
    want = plain_counts(rows)
    assert dict(map(tuple, sp.word_counts(docs).collect())) == want and len(want) > 5
    assert got(sp.spelling_variants(sp.word_counts(docs))) == plain_variants(want)


def test_counts_hand_on_often(make_docs, monkeypatch):
    monkeypatch.setattr(sp, "COUNTED_WORDS", 3)
    rows = [(i, f"lettersone lettertwo words{'abc'[i % 3]}three") for i in range(100)]
    assert dict(map(tuple, sp.word_counts(make_docs(rows)).collect())) == plain_counts(rows)


def test_no_words(make_docs):
    assert sp.spelling_variants(sp.word_counts(make_docs([]))).collect() == []
    assert sp.spelling_variants(sp.word_counts(make_docs([(1, None), (2, ""), (3, "short words")]))).collect() == []


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        sp.near_words(spark.createDataFrame([("ab", 2)], "word string, n long"), 2)
