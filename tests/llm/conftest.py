import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names operators use."""

    def make(rows):
        full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], DOCS)
        clash = "_key _text _of _site _lines row key n_words size copies spans token node label kept n target _bucket"
        for name in clash.split():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


LONG_TEXT = " ".join(f"w{i}" for i in range(60_000)) + " " + "x" * 300_000
EDGES = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \t\n\x0b\x0c\r ", "en", None), (4, "one", "en", "s"),
    (5, LONG_TEXT, "de", "t"), (6, LONG_TEXT, "de", "t"), (6, LONG_TEXT, "de", "t"), (7, "Äé\u2003ß 𝔘 " * 40, None, "s"),
    (None, "no key here but words " * 20, "en", "s"), (None, "no key here but words " * 20, "en", "s"), (8, "a\x00b c", "en", ""),
]


@pytest.fixture
def edges():
    return EDGES
