from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def by_hand(text):
    t = text or ""
    words = t.encode().split()
    c = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if c[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if x.strip(SPACE):
            dup += x in seen
            seen.add(x)
    return len(words), sum(len(w.decode()) for w in words), sum(t.count(s) for s in "#*$%&|<>"), dup, len(inside)


@given(st.text(alphabet="ab# \n\té$", max_size=80))
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_plain_rule(text):
    assert quality.text_counts(text.encode())[:5] == by_hand(text)


def test_figures_of_edge_rows(make_docs, edges):
    out = quality.quality_figures(make_docs(edges), keep=["doc_id"]).collect()
    assert len(out) == len(edges)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((e[0], *by_hand(e[1])) for e in edges)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_empty_table(make_docs):
    empty = make_docs([]).limit(0)
    assert quality.quality_figures(empty, keep=["doc_id"]).count() == 0
    assert quality.quality_kept(empty).columns == empty.columns


def words(seed, n, tail=""):
    return " ".join(f"{chr(97 + (seed * 7 + i) % 26)}{chr(97 + (i * i + seed) % 26)}r{i % 89}{tail}" for i in range(n))


def test_thresholds_follow_language_and_source(make_docs):
    clean = [(i, words(i, 80), "en", "plain") for i in range(400)]
    # a source whose texts all hold some symbols is judged by its own habits
    code = [(1000 + i, words(i, 80) + " " + "#" * 60, "en", "code") for i in range(120)]
    junk = [(2000 + i, words(i, 80, "%%%"), "en", "plain") for i in range(20)]
    small = [(3000, words(1, 80), "en", "tiny"), (3001, words(1, 80, "%%%"), "xx", None)]
    kept = {r.doc_id for r in quality.quality_kept(make_docs(clean + code + junk + small)).collect()}
    assert kept == {r[0] for r in clean + code} | {3000}


def test_fences_differ_by_group_and_several_metrics_reject(make_docs):
    """Long words are natural in one language and junk in another; symbols are natural in one source only."""
    de = [(i, words(i, 80, "lang" * (1 + i % 3)), "de", "web") for i in range(300)]
    en = [(1000 + i, words(i, 80, "x" * (i % 2)), "en", "web") for i in range(300)]
    code = [(2000 + i, words(i, 80) + " " + "#" * (20 + i % 60), "en", "code") for i in range(200)]
    junk = [(3000 + i, words(i, 80, "langlanglang"), "en", "web") for i in range(15)]
    junk += [(4000 + i, words(i, 80) + " " + "#" * 50, "en", "web") for i in range(15)]
    junk += [(5000 + i, " ".join("ab"[j % 2] + "cd"[j // 2 % 2] for j in range(2)) + " " + words(i, 80).replace("r", "")[:160] + " a b" * 2, "de", "web") for i in range(5)]
    docs = make_docs(de + en + code + junk)
    kept = {r.doc_id for r in quality.quality_kept(docs).collect()}
    assert kept >= {r[0] for r in de + en + code} and not kept & {r[0] for r in junk}
    counts = quality.with_counts(docs, "text", [docs["lang"].alias("l"), docs["source"].alias("s")])
    limits = {(r.lang, r.source): r for r in quality.thresholds(counts, "l", "s").collect()}
    assert limits["de", "web"].word_length_high > 2 * limits["en", "web"].word_length_high
    assert limits["en", "code"].symbols_high > 3 * limits["en", "web"].symbols_high


def test_even_groups_keep_their_clean_documents(spark):
    """Word lengths close to each other, around any median: the sketch's steps must not make a fence of their own."""
    import random

    r = random.Random(3)
    rows = []
    for g in range(40):
        middle = 440 + 3 * g
        rows += [(f"s{g}", middle + int(r.gauss(0, 16))) for _ in range(300)] + [(f"s{g}", middle + 400) for _ in range(20)]
    counts = spark.createDataFrame([("en", s, 100, v, 0, 0, 0, 10) for s, v in rows],
                                   "l string, s string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    kept = quality.judged(counts, quality.thresholds(counts, "l", "s"), "l", "s").where("kept").count()
    assert kept == 40 * 300


def test_columns_named_like_figures_are_refused(make_docs):
    with pytest.raises(ValueError):
        quality.quality_figures(make_docs([(1, "a")]), keep=["doc_id", "n_words"])


def test_kept_documents_keep_all_columns(make_docs, edges):
    docs = make_docs([(i, words(i, 80), "en", "s") for i in range(5)] + edges)
    out = quality.quality_kept(docs)
    assert out.columns == docs.columns
    assert {1, 2, 3, 4}.isdisjoint({r.doc_id for r in out.collect() if r.doc_id and r.source is None})


def test_sketch_buckets_hold_their_values(spark):
    from pyspark.sql import functions as F

    v = [*range(200), 1000, 12345, 10**9]
    df = spark.createDataFrame([(x,) for x in v], "v long").withColumn("_bucket", quality.bucket(F.col("v")))
    rows = df.withColumn("low", quality.bucket_value(F.col("_bucket"))).orderBy("v").collect()
    assert all(r.low <= r.v <= r.low * (1 + 2 / 2**quality.SKETCH_BITS) + 1 for r in rows)
    assert [r._bucket for r in rows] == sorted(r._bucket for r in rows)
    assert all(r.low == r.v for r in rows if r.v < 64)


def test_query_equals_sql(spark, sf_dir):
    from cohortlake.llm.registry import ORACLES
    from tests.oracle import connect, differences

    assert differences(quality.op1_quality_rules(spark, sf_dir), connect(sf_dir), ORACLES["op1_quality_rules"]) == []
