import numpy as np
import pyarrow as pa

from cohortlake.llm.common import SLICE_BYTES, U64, run_hashes, span_hashes, text_slices, word_hashes, words_of_many


def test_words_hash_by_content_wherever_they_stand():
    texts = ["a bb a\n\tccc é".encode(), b"", b"  ", b"ccc a"]
    hashes, begin = words_of_many(texts)
    assert begin.tolist() == [0, 5, 5, 5, 7]
    assert hashes[0] == hashes[2] == hashes[6] and hashes[3] == hashes[5]
    assert len({*hashes[:2].tolist(), *hashes[3:5].tolist()}) == 4


def test_lower_takes_ascii_letters_only():
    a, b = word_hashes("ABC É".encode(), lower=True), word_hashes("abc é".encode(), lower=True)
    assert a[0] == b[0] and a[1] != b[1]


def test_long_texts_are_cut_between_words():
    text = b" ".join(b"%d" % (i % 977) for i in range(SLICE_BYTES // 2))
    whole, _ = words_of_many([text[: SLICE_BYTES // 2]])
    assert (word_hashes(text)[: len(whole) - 1] == whole[:-1]).all()
    assert len(word_hashes(text)) == len(text.split())
    assert len(word_hashes(b"x" * (3 * SLICE_BYTES))) == 1


def test_run_and_span_hashes_agree_on_equal_content():
    v = np.array([5, 6, 7, 5, 6, 7, 8], U64)
    r = run_hashes(v, 3)
    assert r[0] == r[3] and len(set(r.tolist())) == 4
    s = span_hashes(v, np.array([0, 3, 1]), np.array([3, 6, 3]))
    assert s[0] == s[1] != s[2]
    assert len(run_hashes(v, 8)) == 0


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * 10, None, "y" * 100, "", "z"])], names=["i", "t"])
    for most in (1, 50, 10**6):
        parts = list(text_slices(batch, 1, most))
        assert [i for p, _ in parts for i in p.column(0).to_pylist()] == list(range(5))
        assert [t for _, ts in parts for t in ts] == [b"x" * 10, None, b"y" * 100, b"", b"z"]
    assert len(list(text_slices(batch, 1, 10**6))) == 1 and list(text_slices(batch.slice(0, 0), 1)) == []
