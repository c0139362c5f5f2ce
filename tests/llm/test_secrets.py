import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlake.llm import secrets as sc
from tests.oracle import connect, differences

TEXTS = [None, "", "password=abcdefgh", "PassWord = 'abc' token:  abcdefghij secret:xyz=12345", "api_key: \"AKIAABCDEFGHIJKL12\" apikey=aaaaaaaaaa",
         "AKIAABC AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "f" * 31, "x" + "a1" * 20 + "g" + "b2" * 16, "token=token=abcdefgh",
         "𝔘é password='zzzzzzzz' 𝔘 " * 3, "ghp_" + "a1B2" * 9, "-----BEGIN RSA PRIVATE KEY-----", "passwordpassword=12345678\npasswd :=x api-key=12345678",
         "xoxb-1234567890-abc sk_live_" + "k" * 20, "secret" + " " * 50 + "=" + "q" * 9, "deadbeef " * 30_000, "token=abcdefgh " * 700]


def by_hand(text):
    out = []
    for i, r in enumerate(sc.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, m.end()))
    return ",".join(f"{sc.RULES[i].kind}:{s}:{e}" for s, i, e in sorted(out))


def test_spans_equal_the_plain_rule(make_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "nothing"), (None, TEXTS[2]), (None, None)]
    out = sc.secret_spans(make_docs(rows)).collect()
    got = Counter((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)) for r in out)
    assert got == Counter((i, by_hand(t)) for i, t in rows)


def test_time_grows_in_line_with_the_matches(make_docs):
    """Twenty times the matches of a text take far less than the square of the time."""
    unit, took = "token=abcdefgh ", {}
    for n in (2000, 2000, 40_000):  # the first call compiles
        start = time.perf_counter()
        spans = sc.secret_spans(make_docs([(1, unit * n)])).select(F.size("spans"), F.element_at("spans", -1)["end"]).first()
        took[n] = time.perf_counter() - start
        assert tuple(spans) == (n, len(unit) * n - 1)
    assert took[40_000] < 20 * took[2000] + 20


def holds(query, text):
    low = text.lower()
    return all(any(all(t in low for t in s) for s in c) for c in query)


@given(st.sampled_from(sc.RULES), st.data())
@settings(max_examples=200, deadline=None)
def test_whatever_matches_meets_its_trigram_query(rule, data):
    text = data.draw(st.from_regex(re.compile(rule.pattern, re.ASCII)))
    assert holds(sc.trigram_query(rule.pattern), text)


def test_queries_are_as_strict_as_the_patterns_allow():
    assert sc.trigram_query("[0-9a-f]+") == [] and sc.trigram_query("ab?c*") == []
    assert sc.trigram_query("AKIA[A-Z0-9]+") == [frozenset([frozenset(["aki", "kia"])])]
    assert not holds(sc.trigram_query(sc.RULES[0].pattern), "pass word tok en")
    assert len(sc.trigram_query("(abc|abd)x+def")) == 2


def test_documents_come_back_with_their_row(make_docs):
    docs = make_docs([(1, "password=abcdefgh"), (2, None)])
    out = sc.secret_spans(docs, keep_row=True).select("row.*")
    assert out.columns == docs.columns and out.count() == 2


def test_empty_table(make_docs):
    assert sc.secret_spans(make_docs([]).limit(0)).count() == 0


def test_query_equals_sql_without_python(spark, sf_dir):
    from cohortlake.llm.registry import ORACLES

    df = sc.op8_secret_scans(spark, sf_dir)
    assert differences(df, connect(sf_dir), ORACLES["op8_secret_scans"]) == []
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())
