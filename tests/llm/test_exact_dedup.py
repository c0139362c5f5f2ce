import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import exact_dedup as ed
from tests.llm.conftest import EDGES


def plain(rows):
    """One row (key, keep, size, kept, sha) per document; of repeated keys one is kept."""
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    out = []
    for t, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        marked = False
        for k in keys:
            out.append((k, keep, len(keys), k == keep and not marked, sha))
            marked |= k == keep
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def digests(texts):
    return np.array([np.frombuffer(hashlib.sha256(t.encode()).digest(), "<u8") for t in texts])


@pytest.mark.parametrize("n", [1, 2, 1000, 20_000])
def test_hash_numbers_its_keys_without_gaps(n):
    keys = digests(f"k{i}" for i in range(n))
    levels, numbers = ed.perfect_hash(keys)
    assert sorted(numbers) == list(range(n))
    assert (ed.hash_slots(levels, keys) == numbers).all()
    others = ed.hash_slots(levels, digests(f"other{i}" for i in range(500)))
    assert others.max() < n


def test_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        ed.perfect_hash(digests(["a", "a"]))


@pytest.mark.parametrize("earlier", ["doc_id <= 6", "false", "true", "null", "doc_id % 2 = 0"])
def test_edges(make_docs, edges, earlier):
    docs = make_docs([r[:4] for r in edges])
    assert got(ed.exact_groups(docs, F.expr(earlier))) == plain([r[:2] for r in EDGES])


@pytest.mark.parametrize("shard", [4, 4096])
def test_many_shards_and_blocks(spark, monkeypatch, shard):
    """History far smaller than the new rows, a text on a third of all rows, and members in every shard."""
    monkeypatch.setattr(ed, "SHARD_DIGESTS", shard)
    monkeypatch.setattr(ed, "HOT_ROWS", 100)
    rows = [(i, f"text {i % 700}" if i % 3 else "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for earlier in ("doc_id < 60", "doc_id < 2000"):
        assert got(ed.exact_groups(docs, F.expr(earlier))) == plain(rows)


def test_no_rows(make_docs):
    assert ed.exact_groups(make_docs([]), F.lit(True)).collect() == []


def test_string_keys_and_ties(spark):
    rows = [("b", "x"), ("ä", "x"), ("a", "x"), (None, "x"), ("z", None), ("z", ""), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for earlier in ("doc_id < 'b'", "doc_id >= 'b'"):
        assert got(ed.exact_groups(docs, F.expr(earlier))) == plain(rows)


def test_slots_reject_other_bytes(spark):
    """A digest that falls on a slot of another one is no member."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    index = ed.digest_index(ed.by_digest(ed.digests_of(docs.where("doc_id < 25"), "doc_id", "text")))
    found = ed.looked_up(index, ed.by_digest(ed.digests_of(docs, "doc_id", "text")))
    slots = {r.best.key: r.slot for r in found.collect()}
    assert sorted(s for k, s in slots.items() if k < 25) == list(range(25))
    assert {s for k, s in slots.items() if k >= 25} == {-1}


def test_without_repeats_keeps_new_texts_once(make_docs):
    old, new = make_docs([(1, "a"), (2, "b")]), make_docs([(3, "a"), (4, "c"), (5, "c"), (5, "c"), (6, None), (7, "")])
    index = ed.digest_index(ed.by_digest(ed.digests_of(old, "doc_id", "text")))
    out = ed.without_repeats(new, index)
    assert out.columns == new.columns
    assert sorted(r.doc_id for r in out.collect()) == [5, 7]
